"""Transcript models: exon offsets, concordant reads, 3' distances, molecules and their shares."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.intervals import contain_join


def with_offsets(exons: DataFrame) -> DataFrame:
    """Exons (transcript, chr, start, end) with ``exon_no`` from 0 and ``offset``, the bases before it."""
    w = Window.partitionBy("transcript").orderBy("start", "end")
    before = F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return exons.withColumns({"exon_no": F.row_number().over(w) - 1, "offset": F.coalesce(before, F.lit(0)).cast("long")})


def spans(exons: DataFrame) -> DataFrame:
    """(transcript, chr, start, end, length, n_exons, max_end): ``max_end`` is the furthest end so far along the chromosome.

    The windows run over annotation, whose size does not follow the reads.
    """
    rows = exons.groupBy("transcript", "chr").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).cast("long").alias("length"),
        F.count(F.lit(1)).alias("n_exons"),
    )
    w = Window.partitionBy("chr").orderBy("start", "end", "transcript").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("max_end", F.max("end").over(w))


def concordant(blocks: DataFrame, exons: DataFrame, width: int = 4096) -> DataFrame:
    """(read_id, transcript, t_start, t_end, to_end): reads whose blocks follow a transcript's exons.

    ``blocks`` is (read_id, block_no, n_blocks, chr, start, end); every block
    lies in one exon, inner ends meet exon ends, and the exons are consecutive.
    Positions are in the transcript; ``to_end`` is the distance to its 3' end.
    """
    ex = with_offsets(exons).select(
        "chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "transcript", "exon_no", "offset",
        F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("transcript")).alias("t_length"),
    )
    at_start = (F.col("block_no") == 0) | (F.col("start") == F.col("r_start"))
    at_end = (F.col("block_no") == F.col("n_blocks") - 1) | (F.col("end") == F.col("r_end"))
    hits = contain_join(blocks, ex, width=width).filter(at_start & at_end)
    inside = lambda c: F.col("offset") + F.col(c) - F.col("r_start")
    rows = hits.groupBy("read_id", "transcript").agg(
        F.count(F.lit(1)).alias("k"), F.first("n_blocks").alias("n"), (F.max("exon_no") - F.min("exon_no") + 1).alias("run"),
        F.min(inside("start")).alias("t_start"), F.max(inside("end")).alias("t_end"), F.first("t_length").alias("t_length"),
    )
    rows = rows.filter((F.col("k") == F.col("n")) & (F.col("run") == F.col("n")))
    return rows.select("read_id", "transcript", "t_start", "t_end", (F.col("t_length") - F.col("t_end")).alias("to_end"))


def distance_histogram(hits: DataFrame, bins: int = 10_000) -> DataFrame:
    """(bin, n): how many hits end ``bin`` bases before the 3' end; further ones are left out."""
    return hits.filter(F.col("to_end") < bins).groupBy(F.col("to_end").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def smoothed(histogram: DataFrame, half: int = 50) -> DataFrame:
    """(bin, n, mean): sums over ``half`` bins to either side, by min(2 * half + 1, bin + half).

    The window has no partition: a histogram has a fixed number of rows.
    """
    w = Window.orderBy("bin").rangeBetween(-half, half)
    share = F.sum("n").over(w) / F.least(F.lit(2 * half + 1), F.col("bin") + half)
    return histogram.select("bin", "n", share.alias("mean"))


def distance_function(histogram: DataFrame, bins: int = 10_000, half: int = 50, past: int = 1000) -> np.ndarray:
    """Shares of the distances up to the valley behind the first peak from ``past`` on.

    The histogram, at most ``bins`` rows, is smoothed on the driver; the last
    ``half + 1`` bins have no mean and count as empty.
    """
    counts = np.zeros(bins)
    for r in histogram.filter(F.col("bin") < bins).collect():
        counts[r["bin"]] = r["n"]
    total = np.concatenate([[0.0], np.cumsum(counts)])
    at = np.arange(max(bins - half - 1, 0))
    mean = np.zeros(bins)
    mean[at] = (total[at + half + 1] - total[np.maximum(at - half, 0)]) / np.minimum(2 * half + 1, at + half)
    end = past
    for up in (1, -1):
        while end + 1 < bins and up * (mean[end + 1] - mean[end]) > 0:
            end += 1
    mean = mean[:end]
    return mean / mean.sum() if mean.sum() > 0 else mean


def length_factors(lengths: DataFrame, shares: np.ndarray) -> DataFrame:
    """(transcript, factor): minus the logarithm of the share of distances that a transcript's length can show, else 0.

    ``shares`` has a fixed number of rows, and so has what is broadcast.
    """
    upto = np.cumsum(shares)
    rows = [(i + 1, -float(np.log(x))) for i, x in enumerate(upto[:-1]) if x > 0]
    table = lengths.sparkSession.createDataFrame(rows, "length long, factor double")
    return lengths.join(F.broadcast(table), "length", "left").select("transcript", F.coalesce("factor", F.lit(0.0)).alias("factor"))


def weighted_hits(hits: DataFrame, factors: DataFrame, shares: np.ndarray) -> DataFrame:
    """``hits`` (transcript, to_end, ...) within the function's range, with ``log_weight``."""
    rows = [(i, float(np.log(x)) if x > 0 else float("-inf")) for i, x in enumerate(shares)]
    table = hits.sparkSession.createDataFrame(rows, "to_end long, _log double")
    near = hits.join(F.broadcast(table), "to_end").join(factors, "transcript")
    return near.withColumn("log_weight", F.col("_log") + F.col("factor")).drop("_log", "factor")


def in_clusters(hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Hits of cells (cb_idx) with their cluster; cells in none are left out."""
    return hits.join(clusters, "cb_idx")


def common_transcripts(hits: DataFrame) -> DataFrame:
    """(cluster, umi, transcript, log_weight): transcripts that every read of a molecule fits, their weights summed.

    ``hits`` is (cluster, umi, read_id, transcript, log_weight).
    """
    each = hits.groupBy("cluster", "umi", "transcript", "read_id").agg(F.sum("log_weight").alias("w"))
    each = each.groupBy("cluster", "umi", "transcript").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("log_weight"))
    reads = hits.groupBy("cluster", "umi", "read_id").agg(F.lit(1)).groupBy("cluster", "umi").agg(F.count(F.lit(1)).alias("n"))
    both = each.join(reads, ["cluster", "umi"])
    return both.filter(F.col("k") == F.col("n")).select("cluster", "umi", "transcript", "log_weight")


#: Shares of the molecules below which a value is frozen, and how far below the tolerance it moves then.
FROZEN, STILL = 1e-8, 0.1


def transcript_shares(common: DataFrame, factors: DataFrame | None = None, rounds: int = 10_000, tolerance: float = 1e-5) -> DataFrame:
    """(cluster, transcript, value): expected molecules of each transcript by expectation-maximisation.

    ``common`` is (cluster, umi, transcript, log_weight).  A molecule is shared
    by its transcripts' weights times their current values.  Values under 1e-8
    of the molecules, and values that move by less than a tenth of ``tolerance``,
    are frozen.  ``factors`` (transcript, factor) are undone at the end, and the
    sum is that of the molecules.  Molecules with the same transcripts and
    weights are first counted as one class, so a cluster's task sees its
    classes, not its molecules.
    """
    one = common.join(factors, "transcript", "left") if factors is not None else common.withColumn("factor", F.lit(0.0))
    item = F.struct(F.col("transcript").cast("long").alias("t"), F.col("log_weight").cast("double").alias("w"), F.coalesce("factor", F.lit(0.0)).alias("f"))
    sets = one.groupBy("cluster", "umi").agg(F.array_sort(F.collect_list(item)).alias("set"), F.max(F.col("log_weight").cast("double")).alias("top"))
    sets = sets.withColumn("set", F.transform("set", lambda x: F.struct(x["t"].alias("t"), (x["w"] - F.col("top")).alias("w"), x["f"].alias("f"))))
    classes = sets.groupBy(F.col("cluster").cast("long").alias("cluster"), "set").agg(F.count(F.lit(1)).alias("n"))
    classes = classes.select("cluster", "n", *(F.col(f"set.{c}").alias(c) for c in "twf"))

    def run(table: pa.Table) -> pa.Table:
        flat = {c: np.concatenate(table.column(c).to_numpy()) for c in "twf"}
        size = np.array([len(x) for x in table.column("t").to_numpy()])
        row, n = np.repeat(np.arange(len(size)), size), table.column("n").to_numpy().astype(float)
        names, first, col = np.unique(flat["t"], return_index=True, return_inverse=True)
        k, molecules = len(names), n.sum()
        alone = np.bincount(col, np.where(size[row] == 1, n[row], 0.0), k)
        old = np.bincount(col, n[row] / size[row], k)
        many = size[row] > 1
        r, c, w = row[many], col[many], np.exp(flat["w"][many])
        frozen, new = np.zeros(k, bool), old
        for _ in range(rounds):
            part = w * old[c]
            total = np.bincount(r, part, len(n))[r]
            share = np.divide(part, total, out=np.zeros_like(part), where=total > 0) * n[r] * ~frozen[c]
            new = alone + np.bincount(c, share, k)
            open_ = ~frozen & (old != 0)
            move = np.abs(new - old)[open_] / old[open_]
            moved = np.zeros(k)
            moved[open_] = move
            gone, still = open_ & (new < FROZEN * molecules), open_ & (moved < tolerance * STILL)
            frozen |= gone | still
            alone[gone] = 0.0
            alone[still] = new[still]
            if move.max(initial=0.0) < tolerance:
                break
            old, new = new, old
        value = new * np.exp(flat["f"][first])
        value *= molecules / value.sum() if value.sum() > 0 else 1.0
        cluster = table.column("cluster")[0].as_py()
        return pa.table([pa.array([cluster] * k, pa.int64()), pa.array(names.astype(np.int64)), pa.array(value)], ["cluster", "transcript", "value"])

    return classes.groupBy("cluster").applyInArrow(run, "cluster long, transcript long, value double")
