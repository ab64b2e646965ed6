"""Molecules: UMI counts, deduplication and multi-gene filters.

Observations are rows (cb, umi, gene); ``molecules`` sums their reads, after
which every rule works on one row per molecule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators.storage import stored

CELL_GENE = ["cb", "gene"]


def molecules(obs: DataFrame, reads: str | None = None) -> DataFrame:
    """(cb, umi, gene, reads)."""
    n = F.sum(reads) if reads else F.count(F.lit(1))
    return obs.groupBy("cb", "umi", "gene").agg(n.cast("long").alias("reads"))


def count_exact(mols: DataFrame) -> DataFrame:
    """(cb, gene, value): distinct UMIs."""
    return mols.groupBy(*CELL_GENE).agg(F.count(F.lit(1)).alias("value"))


def count_reads(mols: DataFrame) -> DataFrame:
    """(cb, gene, value): no deduplication."""
    return mols.groupBy(*CELL_GENE).agg(F.sum("reads").alias("value"))


def edges(mols: DataFrame, size: int) -> DataFrame:
    """Ordered pairs of UMIs one base apart in a cell and gene: (cb, gene, umi, reads, other, other_reads)."""
    near = mols.select(*CELL_GENE, "umi", "reads", F.explode(S.neighbours(F.col("umi"), size)).alias("other"))
    there = mols.select(*CELL_GENE, F.col("umi").alias("other"), F.col("reads").alias("other_reads"))
    return near.join(there, [*CELL_GENE, "other"])


#: Stands for null in arrays.
NONE = -(1 << 63)


def _targets(group: np.ndarray, umi: np.ndarray, reads: np.ndarray, size: int) -> np.ndarray:
    """Where each UMI goes; rows are sorted by group (from 0) and UMI, which are unique together."""
    if not len(umi):
        return umi
    width = max(2 * size, int(umi[-1]).bit_length(), int(umi.max()).bit_length())
    if group[0] != group[-1] and (umi.min() < 0 or width + int(group[-1]).bit_length() > 62):
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        return np.concatenate([_targets(group[i:j], umi[i:j], reads[i:j], size) for i, j in zip(at, at[1:])])
    code = (group - group[0]) << width
    keys, n, target = code + umi, reads.copy(), umi.copy()
    for i in range(size):
        for d in (1, 2, 3):
            other = umi ^ (d << (2 * i))
            at = np.searchsorted(keys, code + other)
            at[at == len(keys)] = 0
            theirs = reads[at]
            up = (keys[at] == code + other) & ((theirs > n) | ((theirs == n) & (other > target)))
            n, target = np.where(up, theirs, n), np.where(up, other, target)
    return target


CORRECTED = "cb long, gene long, umi long, reads long, target long"


def _correct(size: int, per_row: bool):
    """Sorted molecules of whole cells and genes: their targets, or the number of these."""

    def done(cb, gene, umi, reads) -> pa.RecordBatch:
        new = np.concatenate([[True], (cb[1:] != cb[:-1]) | (gene[1:] != gene[:-1])])
        group, target = np.cumsum(new) - 1, umi.copy()
        known = np.flatnonzero((cb != NONE) & (gene != NONE) & (umi != NONE))  # what is null has no neighbours
        target[known] = _targets(group[known], umi[known], reads[known], size)
        array = lambda x: pa.array(x, pa.int64(), mask=x == NONE)
        if per_row:
            return pa.RecordBatch.from_arrays([array(x) for x in (cb, gene, umi, reads, target)], ["cb", "gene", "umi", "reads", "target"])
        order = np.lexsort((target, group))
        g, t = group[order], target[order]
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])]) & (t != NONE)
        value = np.bincount(g[first], minlength=int(new.sum()))
        return pa.RecordBatch.from_arrays([array(cb[new]), array(gene[new]), pa.array(value.astype(np.int64))], [*CELL_GENE, "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cb, gene, umi, reads = (batch.column(c).fill_null(NONE).to_numpy(zero_copy_only=False) for c in ("cb", "gene", "umi", "reads"))
            # the last cell and gene may go on in the next batch
            cut = int(np.flatnonzero((cb != cb[-1]) | (gene != gene[-1]))[-1]) + 1 if (cb[0], gene[0]) != (cb[-1], gene[-1]) else 0
            if held and (cut or (held[-1][0][-1], held[-1][1][-1]) != (cb[0], gene[0])):
                same = (held[-1][0][-1], held[-1][1][-1]) == (cb[0], gene[0])
                end = int(np.flatnonzero((cb == cb[0]) & (gene == gene[0]))[-1]) + 1 if same else 0
                if end:
                    held.append((cb[:end], gene[:end], umi[:end], reads[:end]))
                yield done(*(np.concatenate(x) for x in zip(*held)))
                held, cb, gene, umi, reads, cut = [], cb[end:], gene[end:], umi[end:], reads[end:], max(cut - end, 0)
            if cut:
                yield done(cb[:cut], gene[:cut], umi[:cut], reads[:cut])
            if len(cb) > cut:
                held.append((cb[cut:], gene[cut:], umi[cut:], reads[cut:]))
        if held:
            yield done(*(np.concatenate(x) for x in zip(*held)))

    return run


def _in_tasks(rows: DataFrame, size: int, per_row: bool) -> DataFrame:
    rows = rows.repartition(*CELL_GENE).sortWithinPartitions(*CELL_GENE, "umi")
    return rows.mapInArrow(_correct(size, per_row), CORRECTED if per_row else "cb long, gene long, value long")


def _by_joins(mols: DataFrame, size: int) -> DataFrame:
    up = edges(mols, size).filter(F.struct("other_reads", "other") > F.struct("reads", "umi"))
    best = up.groupBy(*CELL_GENE, "umi").agg(F.max_by("other", F.struct("other_reads", "other")).alias("target"))
    return mols.join(best, [*CELL_GENE, "umi"], "left").select(*CELL_GENE, "umi", "reads", F.coalesce("target", "umi").alias("target"))


def _corrected(mols: DataFrame, size: int, large: int, per_row: bool) -> DataFrame:
    count = lambda rows: rows.groupBy(*CELL_GENE).agg(F.count_distinct("target").alias("value"))
    rows = mols.select(*(F.col(c).cast("long") for c in (*CELL_GENE, "umi", "reads")))
    if 4**size <= large:
        return _in_tasks(rows, size, per_row)
    rows = stored(rows)
    big = stored(rows.groupBy(*CELL_GENE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select(*CELL_GENE))
    if big.isEmpty():
        return _in_tasks(rows, size, per_row)
    spread = _by_joins(rows.join(big, CELL_GENE, "left_semi"), size)
    return _in_tasks(rows.join(big, CELL_GENE, "left_anti"), size, per_row).unionByName(spread if per_row else count(spread))


def corrected_cr(mols: DataFrame, size: int, large: int | None = None) -> DataFrame:
    """(cb, gene, umi, reads, target): each UMI goes to its neighbour of most reads, then largest value, if that is above itself.

    Molecules are dealt by cell and gene once and looked up in sorted arrays;
    cells and genes of more than ``large`` UMIs (LARGE) meet their neighbours by
    joins.
    """
    return _corrected(mols, size, LARGE if large is None else large, True)


def count_cr(mols: DataFrame, size: int, large: int | None = None) -> DataFrame:
    """(cb, gene, value): distinct UMIs after one correction step."""
    return _corrected(mols, size, LARGE if large is None else large, False)


def _greedy(size: int, rule: str, add: int):
    def count(umi: np.ndarray, reads: np.ndarray) -> int:
        order = np.lexsort((umi, -reads))
        place = {u: i for i, u in enumerate(umi[order].tolist())}
        n = reads[order].tolist()
        gone = [False] * len(place)
        flips = [d << (2 * i) for i in range(size) for d in (1, 2, 3)]
        for u, hub in place.items():
            if gone[hub]:
                continue
            todo = [u]
            while todo:
                here = todo.pop()
                for f in flips:
                    leaf = place.get(here ^ f)
                    if leaf is None or leaf == hub or gone[leaf]:
                        continue
                    if rule == "all":
                        gone[leaf] = True
                        todo.append(here ^ f)
                    elif n[leaf] <= n[hub] and n[hub] >= 2 * n[leaf] + add:
                        gone[leaf] = True
        return len(place) - sum(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Molecules of whole (cell, gene) groups, sorted, with a tail carried between batches."""
        held: list[tuple] = []
        key = None
        out: list[tuple] = []

        def close():
            if held:
                out.append((*key, count(np.array([h[0] for h in held]), np.array([h[1] for h in held]))))

        def emit():
            cb, gene, value = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cb, gene, value)], [*CELL_GENE, "value"])

        for batch in batches:
            for cb, gene, umi, reads in zip(*(batch.column(c).to_pylist() for c in ("cb", "gene", "umi", "reads"))):
                if (cb, gene) != key:
                    close()
                    held, key = [], (cb, gene)
                held.append((umi, reads))
            yield emit()
            out.clear()
        close()
        yield emit()

    return run


#: Tags of a cell and gene beyond which they are collapsed by joins instead of in one task's loop.
LARGE = 50_000


def _grouped(mols: DataFrame, size: int, rule: str, add: int, large: int) -> DataFrame:
    rows = mols.select(*(F.col(c).cast("long") for c in ("cb", "gene", "umi", "reads")))
    if 4**size <= large:
        return _looped(rows, size, rule, add)
    rows = stored(rows)
    big = rows.groupBy(*CELL_GENE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select(*CELL_GENE)
    if big.isEmpty():
        return _looped(rows, size, rule, add)
    big = stored(big)
    spread = (components if rule == "all" else hubs)(*((rows.join(big, CELL_GENE, "left_semi"), size) + (() if rule == "all" else (add,))))
    return _looped(rows.join(big, CELL_GENE, "left_anti"), size, rule, add).unionByName(count_exact(spread))


def _looped(rows: DataFrame, size: int, rule: str, add: int) -> DataFrame:
    rows = rows.repartition(*CELL_GENE).sortWithinPartitions(*CELL_GENE)
    return rows.mapInArrow(_greedy(size, rule, add), "cb long, gene long, value long")


def components(mols: DataFrame, size: int) -> DataFrame:
    """One row (cb, gene, umi) for each group of UMIs connected by single mismatches, its smallest UMI.

    Labels spread by joins: each UMI takes the smallest label around it, then
    the label of its label, until none changes; a group is dealt by UMI, so no
    task holds a whole cell and gene.
    """
    key = [*CELL_GENE, "umi"]
    near = stored(edges(mols, size).select(*key, "other"))
    labels = stored(mols.select(*key, F.col("umi").alias("label")).distinct())
    while True:
        there = labels.select(*CELL_GENE, F.col("umi").alias("other"), F.col("label").alias("theirs"))
        least = near.join(there, [*CELL_GENE, "other"]).groupBy(*key).agg(F.min("theirs").alias("theirs"))
        step = labels.join(least, key, "left").select(*key, F.col("label").alias("was"), F.least("label", F.coalesce("theirs", "label")).alias("label"))
        step = stored(step)
        jump = step.select(*CELL_GENE, F.col("umi").alias("label"), F.col("label").alias("further"))
        labels = stored(step.join(jump, [*CELL_GENE, "label"]).select(*key, F.col("further").alias("label"), "was"))
        if labels.filter("label <> was").isEmpty():
            return labels.filter("label = umi").select(*key)
        labels = labels.drop("was")


def hubs(mols: DataFrame, size: int, add: int = 0) -> DataFrame:
    """The UMIs (cb, gene, umi) that stay when each, strongest first, takes the weaker ones around it.

    A UMI goes if one that stays has at least twice its reads plus ``add``; it
    stays once all of those are gone.  Rounds of joins decide all UMIs whose
    stronger neighbours are decided; reads halve from step to step and equal
    ones go by UMI, so the rounds are few.
    """
    key = [*CELL_GENE, "umi"]
    stronger = (F.col("reads") <= F.col("other_reads")) & (F.col("other_reads") >= 2 * F.col("reads") + add)
    first = F.struct(-F.col("other_reads"), F.col("other")) < F.struct(-F.col("reads"), F.col("umi"))
    over = stored(edges(mols, size).filter(stronger & first).select(*key, "other"))
    free = mols.select(*key).distinct().join(over.select(*key).distinct(), key, "left_anti")
    stays, left = [stored(free)], over
    while True:
        taken = left.join(stays[-1].withColumnRenamed("umi", "other"), [*CELL_GENE, "other"], "left_semi").select(*key).distinct()
        taken = stored(taken)
        rest = left.join(taken, key, "left_anti")
        open_ = stored(rest.join(taken.withColumnRenamed("umi", "other"), [*CELL_GENE, "other"], "left_anti"))
        freed = stored(rest.select(*key).distinct().join(open_.select(*key).distinct(), key, "left_anti"))
        stays.append(freed)
        if open_.isEmpty() and freed.isEmpty():
            break
        left = open_
    out = stays[0]
    for more in stays[1:]:
        out = out.unionByName(more)
    return out


def count_components(mols: DataFrame, size: int, large: int = LARGE) -> DataFrame:
    """(cb, gene, value): groups of UMIs connected by single mismatches.

    Cells and genes of more than ``large`` UMIs go through :func:`components`.
    """
    return _grouped(mols, size, "all", 0, large)


def count_directional(mols: DataFrame, size: int, add: int = 0, large: int = LARGE) -> DataFrame:
    """(cb, gene, value): hubs left after each took the weaker UMIs around it, strongest first.

    Cells and genes of more than ``large`` UMIs go through :func:`hubs`.
    """
    return _grouped(mols, size, "directional", add, large)


def filter_multi_gene(mols: DataFrame, method: str = "multi") -> DataFrame:
    """Molecules kept where a UMI of a cell is seen in several genes.

    ``multi`` keeps the genes of most reads (none if that is one read), ``all``
    drops such UMIs, ``cr`` keeps a strict winner only.
    """
    umi = Window.partitionBy("cb", "umi")
    rows = mols.withColumns({"_genes": F.count(F.lit(1)).over(umi), "_max": F.max("reads").over(umi)})
    if method == "multi":
        keep = F.col("reads") >= F.when(F.col("_max") == 1, 2).otherwise(F.col("_max"))
    elif method == "all":
        keep = F.lit(False)
    elif method == "cr":
        rows = rows.withColumn("_top", F.sum((F.col("reads") == F.col("_max")).cast("int")).over(umi))
        keep = (F.col("reads") == F.col("_max")) & (F.col("_top") == 1)
    else:
        raise ValueError(f"unknown method {method}")
    return rows.filter((F.col("_genes") == 1) | keep).select(*mols.columns)


def filter_cr_corrected(mols: DataFrame, size: int) -> DataFrame:
    """(cb, umi, gene): UMIs corrected within their gene, then given to the strict winner.

    The winner on corrected reads must not have fewer uncorrected reads of that
    UMI than another gene.
    """
    own = F.struct("cb", "umi", "gene", F.col("reads").alias("_own"), F.when(F.col("target").eqNullSafe(F.col("umi")), F.col("reads")).alias("_now"))
    gone = F.struct("cb", F.col("target").alias("umi"), "gene", F.lit(None).cast("long").alias("_own"), F.col("reads").alias("_now"))
    # a row of each molecule with its own reads and one of what has moved; all meet by cell and UMI
    rows = corrected_cr(mols, size).select(F.explode(F.when(F.col("target") != F.col("umi"), F.array(own, gone)).otherwise(F.array(own))).alias("m")).select("m.*")
    sums = rows.groupBy("cb", "umi", "gene").agg(F.sum("_own").alias("_own"), F.sum("_now").alias("_now"))
    umi = Window.partitionBy("cb", "umi")
    sums = sums.withColumns({"_most": F.max("_now").over(umi), "_max": F.max("_own").over(umi)})
    sums = sums.withColumn("_top", F.sum((F.col("_now") == F.col("_most")).cast("int")).over(umi))
    keep = (F.col("_now") == F.col("_most")) & (F.col("_top") == 1) & (F.coalesce("_own", F.lit(0)) >= F.coalesce("_max", F.lit(0)))
    return sums.filter(keep).select("cb", "umi", "gene")


def cell_stats(mols: DataFrame, counts: DataFrame) -> DataFrame:
    """(cb, n_reads, n_umis, n_genes) of cells with molecules."""
    reads = mols.groupBy("cb").agg(F.sum("reads").alias("n_reads"))
    umis = counts.groupBy("cb").agg(F.sum("value").alias("n_umis"), F.count(F.lit(1)).alias("n_genes"))
    return reads.join(umis.filter("n_umis > 0"), "cb")


def share_multi(unique: DataFrame, sets: DataFrame, method: str = "uniform") -> DataFrame:
    """(cb, gene, value): unique counts plus molecules of several genes, shared out.

    ``unique`` is (cb, gene, value), ``sets`` (cb, molecule, gene).  Cells
    without a unique gene are left out.  ``uniform`` gives equal parts,
    ``prop_unique`` parts in proportion to unique counts, ``rescue`` to unique
    counts plus the uniform parts; where all weights are 0 the parts are equal.
    """
    mol = Window.partitionBy("cb", "molecule")
    rows = sets.join(unique.select("cb").distinct(), "cb").join(unique, ["cb", "gene"], "left")
    rows = rows.select("cb", "molecule", "gene", F.coalesce("value", F.lit(0)).cast("double").alias("u"), (1 / F.count(F.lit(1)).over(mol)).alias("even"))
    if method == "uniform":
        share = F.col("even")
    else:
        base = F.col("u")
        if method == "rescue":
            base = base + F.sum("even").over(Window.partitionBy("cb", "gene"))
        rows = rows.withColumn("w", base).withColumn("total", F.sum("w").over(mol))
        share = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(F.col("even"))
    parts = rows.select("cb", "gene", share.alias("value"))
    both = unique.select("cb", "gene", F.col("value").cast("double").alias("value")).unionByName(parts)
    return both.groupBy("cb", "gene").agg(F.sum("value").alias("value"))


#: Entries of gene sets of one cell beyond which its rounds are joins instead of one task's arrays.
LARGE_CELL = 1_000_000


def share_multi_em(unique: DataFrame, sets: DataFrame, rounds: int = 100, tolerance: float = 1e-6, large: int = LARGE_CELL) -> DataFrame:
    """(cb, gene, value) by expectation-maximisation within each cell.

    Molecules of one cell and gene set are one class, so a cell is as large as
    its different sets.  Cells of up to ``large`` entries are arrays of one
    task; larger ones go through :func:`em_rounds`.
    """
    fixed = stored(unique.select(F.col("cb").cast("long").alias("cb"), F.col("gene").cast("long").alias("gene"), F.col("value").cast("double").alias("u")))
    sets = sets.select(F.col("cb").cast("long").alias("cb"), "molecule", F.col("gene").cast("long").alias("gene"))
    classes = sets.groupBy("cb", "molecule").agg(F.sort_array(F.collect_list("gene")).alias("genes")).groupBy("cb", "genes").agg(F.count(F.lit(1)).alias("n"))
    # cells are chosen among classes, of which there are fewer than molecules
    classes = stored(classes.join(fixed.select("cb").distinct(), "cb"))
    big = classes.groupBy("cb").agg(F.sum(F.size("genes")).alias("k")).filter(F.col("k") > large).select("cb")
    if big.isEmpty():
        return _em_arrays(fixed, classes, rounds, tolerance)
    big = stored(big)
    part = lambda df, how: df.join(big, "cb", how)
    small = _em_arrays(part(fixed, "left_anti"), part(classes, "left_anti"), rounds, tolerance)
    return small.unionByName(em_rounds(part(fixed, "left_semi"), part(classes, "left_semi"), rounds, tolerance))


def _em_arrays(fixed: DataFrame, classes: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    entry = classes.select("cb", F.xxhash64("genes").alias("class"), F.col("n").cast("double").alias("u"), F.explode("genes").alias("gene"))
    both = fixed.select("cb", F.lit(None).cast("long").alias("class"), "u", "gene").unionByName(entry)

    def run(table: pa.Table) -> pa.Table:
        genes, place = np.unique(table.column("gene").to_numpy(), return_inverse=True)
        of = table.column("class")
        multi = of.is_valid().to_numpy()
        u = table.column("u").to_numpy()
        fixed = np.bincount(place[~multi], u[~multi], len(genes))
        _, m = np.unique(of.filter(pa.array(multi)).to_numpy(), return_inverse=True)
        g, n = place[multi], u[multi]
        size = np.bincount(m)
        theta = fixed.copy()
        for _ in range(rounds):
            total = np.bincount(m, theta[g], len(size))
            part = np.where(total[m] > 0, theta[g] / np.where(total[m] > 0, total[m], 1), 1 / size[m]) if len(m) else np.zeros(0)
            new = fixed + np.bincount(g, n * part, len(genes))
            moved, theta = np.abs(new - theta).sum(), new
            if moved < tolerance:
                break
        cb = table.column("cb")[0].as_py()
        return pa.table([pa.array([cb] * len(genes), pa.int64()), pa.array(genes.astype(np.int64)), pa.array(theta)], ["cb", "gene", "value"])

    return both.groupBy("cb").applyInArrow(run, "cb long, gene long, value double")


#: Entries of a block of classes, and counts (cells times genes) that go through the driver at once.
BLOCK, STATE = 200_000, 100_000

BLOCKS = "cb long, gene binary, class binary, n binary"


def _blocks(classes: DataFrame) -> DataFrame:
    """Classes (cb, genes, n) packed by cell: of each entry its gene, of each class its size and number."""

    def pack(cb: int, genes: list, n: list) -> pa.RecordBatch:
        size = np.array([len(g) for g in genes], np.int32)
        flat = np.concatenate([np.asarray(g, np.int64) for g in genes])
        return pa.RecordBatch.from_arrays([pa.array([cb], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (flat, size, np.array(n, np.float64)))], ["cb", "gene", "class", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, genes, held, entries = None, [], [], 0
        for batch in batches:
            for cb, g, n in zip(*(batch.column(c).to_pylist() for c in ("cb", "genes", "n"))):
                if held and (cb != of or entries >= BLOCK):
                    yield pack(of, genes, held)
                    genes, held, entries = [], [], 0
                of = cb
                genes.append(g)
                held.append(n)
                entries += len(g)
        if held:
            yield pack(of, genes, held)

    # dealt at random, as the classes of a cell are to be spread; sorted, so that a cell's lie together
    rows = classes.filter(F.size("genes") > 0).repartition(F.xxhash64("cb", "genes")).sortWithinPartitions("cb")
    return rows.mapInArrow(run, BLOCKS)


def _shares(theta: dict):
    """What a round gives to the genes of each cell: theta is cb -> (genes in order, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for cb, gene, size, n in zip(*(batch.column(c).to_pylist() for c in ("cb", "gene", "class", "n"))):
                if cb not in theta.value:
                    continue
                names, value = theta.value[cb]
                at, size, n = np.searchsorted(names, np.frombuffer(gene, np.int64)), np.frombuffer(size, np.int32), np.frombuffer(n)
                held = value[at]
                total = np.add.reduceat(held, np.concatenate([[0], np.cumsum(size)[:-1]]))
                # per entry: the share of its class, equal parts where all counts are 0
                weight = np.repeat(np.where(total > 0, n / np.where(total > 0, total, 1), 0), size)
                even = np.repeat(np.where(total > 0, 0, n / size), size)
                part = np.bincount(at, weight * held + even, len(names))
                sums[cb] = sums[cb] + part if cb in sums else part
        for cb, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([cb], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["cb", "part"])

    return run


def em_rounds(fixed: DataFrame, classes: DataFrame, rounds: int = 100, tolerance: float = 1e-6, state: int | None = None) -> DataFrame:
    """(cb, gene, value) of unique counts (cb, gene, u) and classes (cb, genes, n), for cells too large for one task.

    The classes of a cell lie in blocks of ``BLOCK`` entries over many tasks
    and are never moved again.  A round sends the counts of the cells to the
    tasks and adds up what comes back; the driver holds those of some cells at
    once, ``state`` counts or one cell.  A cell whose counts have moved by less
    than ``tolerance`` stays as it is.
    """
    spark, state = fixed.sparkSession, state or STATE
    blocks = stored(_blocks(classes))
    every = fixed.select("cb", "gene", "u").unionByName(classes.select("cb", F.explode("genes").alias("gene"), F.lit(0.0).alias("u")))
    every = stored(every.groupBy("cb", "gene").agg(F.sum("u").alias("u")))
    out = None
    group: list[int] = []
    held = 0
    sizes = every.groupBy("cb").agg(F.count(F.lit(1)).alias("k")).orderBy("cb").collect()  # one row a large cell
    for i, r in enumerate(sizes):
        group.append(r.cb)
        held += r.k
        if i + 1 < len(sizes) and held + sizes[i + 1].k <= state:
            continue
        done = stored(_em_together(spark, every.filter(F.col("cb").isin(group)), blocks.filter(F.col("cb").isin(group)), rounds, tolerance))
        out = done if out is None else out.unionByName(done)
        group, held = [], 0
    return every.select("cb", "gene", F.col("u").alias("value")) if out is None else out


def _em_together(spark, every: DataFrame, blocks: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    rows = every.toArrow().sort_by([("cb", "ascending"), ("gene", "ascending")])
    cb, gene, u = (rows.column(c).to_numpy() for c in ("cb", "gene", "u"))
    at = np.flatnonzero(np.concatenate([[True], cb[1:] != cb[:-1], [True]]))
    of = {int(cb[i]): slice(i, j) for i, j in zip(at, at[1:])}
    value, open_ = u.astype(np.float64), list(of)
    for _ in range(rounds):
        theta = spark.sparkContext.broadcast({c: (gene[of[c]], value[of[c]]) for c in open_})
        parts: dict = {c: [] for c in open_}
        for r in blocks.mapInArrow(_shares(theta), "cb long, part binary").collect():
            parts[r.cb].append(r.part)
        theta.destroy()
        still = []
        for c in open_:
            # in one order, whatever the order of the tasks
            new = u[of[c]] + sum((np.frombuffer(p) for p in sorted(parts[c])), np.zeros(of[c].stop - of[c].start))
            moved = np.abs(new - value[of[c]]).sum()
            value[of[c]] = new
            if moved >= tolerance:
                still.append(c)
        open_ = still
        if not open_:
            break
    return spark.createDataFrame(pa.table([pa.array(cb), pa.array(gene), pa.array(value)], ["cb", "gene", "value"]))


#: How molecules of several genes are dealt with, by name.
FILTERS = ("none", "multi", "all", "cr", "cr_full")
METHODS = ("exact", "none", "1mm_cr", "1mm_all", "directional", "umitools")


def count_matrix(obs: DataFrame, size: int, *, method: str = "exact", filtering: str = "none", ambiguous: DataFrame | None = None) -> DataFrame:
    """(cb, gene, value) of observations (cb, umi, gene) of ``size`` bases.

    ``ambiguous`` are observations (cb, umi, gene) of reads whose barcode was
    chosen among several listed ones; they are counted with the others.  Genes
    are filtered first, then tags are collapsed; ``cr_full`` decides the gene on
    collapsed tags and counts those left, whatever the method.
    """
    if filtering not in FILTERS or method not in METHODS:
        raise ValueError(f"filtering must be one of {FILTERS}, method one of {METHODS}")
    mols = molecules(obs if ambiguous is None else obs.select("cb", "umi", "gene").unionByName(ambiguous.select("cb", "umi", "gene")))
    if filtering == "cr_full":
        return count_exact(filter_cr_corrected(mols, size))
    if filtering != "none":
        mols = filter_multi_gene(mols, filtering)
    return collapsed(mols, size, method)


def collapsed(mols: DataFrame, size: int, method: str = "exact") -> DataFrame:
    """(cb, gene, value): molecules (cb, gene, umi, reads) counted by one of ``METHODS``."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "exact":
        return count_exact(mols)
    if method == "none":
        return count_reads(mols)
    if method == "1mm_cr":
        return count_cr(mols, size)
    if method == "1mm_all":
        return count_components(mols, size)
    return count_directional(mols, size, -1 if method == "umitools" else 0)
