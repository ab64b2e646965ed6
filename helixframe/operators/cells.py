"""Which barcodes are cells: knee, top n, ambient Monte Carlo; and their summary."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.ranking import adjust_p, global_rank
from helixframe.operators.storage import stored


def top_cells(cells: DataFrame, n: int) -> DataFrame:
    return cells.orderBy(F.col("n_umis").desc(), "cb").limit(n).select("cb")


def knee_threshold(cells: DataFrame, expected: int = 3000, share: float = 0.99, ratio: float = 10.0) -> DataFrame:
    """One row (threshold): a tenth of the count at the rank of ``expected * (1 - share)``.

    A barcode is a cell from that count on.  Only the top of the order is kept.
    """
    rank = math.floor(expected * (1 - share) + 0.5)
    top = cells.orderBy(F.col("n_umis").desc()).limit(rank + 1).agg(F.min("n_umis").alias("robust"))
    return top.select(F.ceil(F.coalesce("robust", F.lit(0)) / ratio).alias("threshold"))


def knee_cells(cells: DataFrame, **options) -> DataFrame:
    return cells.join(F.broadcast(knee_threshold(cells, **options)), F.col("n_umis") >= F.col("threshold")).select("cb")


def good_turing(counts: np.ndarray) -> np.ndarray:
    """Smoothed probabilities of observed counts (log-linear fit beyond where raw ratios are reliable)."""
    freq, times = np.unique(counts[counts > 0], return_counts=True)
    total = counts.sum()
    if len(freq) < 5:
        return counts / max(total, 1)
    gaps = np.diff(np.concatenate([[0], freq, [2 * freq[-1] - freq[-2]]])).astype(float)
    z = 2 * times / (gaps[:-1] + gaps[1:])
    slope, level = np.polyfit(np.log(freq), np.log(z), 1)
    smooth = lambda r: np.exp(level + slope * np.log(r))
    fitted = (freq + 1) * smooth(freq + 1) / smooth(freq)
    by_freq = dict(zip(freq.tolist(), times.tolist()))
    star, raw = fitted.copy(), True
    for i, r in enumerate(freq.tolist()):
        after = by_freq.get(r + 1)
        if raw and after:
            x = (r + 1) * after / times[i]
            spread = 1.96 * math.sqrt((r + 1.0) ** 2 * after / times[i] ** 2 * (1 + after / times[i]))
            if abs(x - fitted[i]) > spread:
                star[i] = x
                continue
        raw = False
    unseen = by_freq.get(1, 0) / total
    scale = (1 - unseen) / (times * star).sum()
    value = dict(zip(freq.tolist(), (star * scale).tolist()))
    missing = int((counts == 0).sum())
    rest = unseen / missing if missing else 0.0
    return np.array([value[c] if c else rest for c in counts.tolist()])


#: Fixed value: the seed of the walks.
SEED = 19760110


def empty_drops(counts: DataFrame, *, lower: int = 100, simulations: int = 10_000, fdr: float = 0.01, expected: int = 3000,
                seed: int = SEED) -> DataFrame:
    """(cb, n_umis, kind): knee cells, and barcodes whose genes differ from the ambient profile.

    ``counts`` is (cb, gene, value).  The ambient profile is the sum over
    barcodes of at most ``lower`` molecules, smoothed by Good-Turing; it has one
    number a gene and is all that reaches the driver.  Each simulation is a
    multinomial walk through all totals asked for, run as its own Spark row.
    """
    cells = counts.groupBy("cb").agg(F.sum("value").alias("n_umis"))
    knee = knee_cells(cells, expected=expected).withColumn("kind", F.lit("knee"))
    low = cells.filter(F.col("n_umis") <= lower)
    profile = counts.join(low.select("cb"), "cb", "left_semi").groupBy("gene").agg(F.sum("value").alias("n"))
    genes = counts.select("gene").distinct().join(profile, "gene", "left").select("gene", F.coalesce("n", F.lit(0)).alias("n")).orderBy("gene").toPandas()
    found = cells.join(knee, "cb").select("cb", "n_umis", "kind")
    if not genes["n"].sum():
        return found
    p = good_turing(genes["n"].to_numpy())
    spark = counts.sparkSession
    log_p = spark.createDataFrame(list(zip(genes["gene"].tolist(), np.log(np.maximum(p, 1e-300)).tolist())), f"gene {counts.schema['gene'].dataType.simpleString()}, log_p double")
    rest = cells.join(knee.select("cb"), "cb", "left_anti").filter(F.col("n_umis") > lower)
    log_factorial = spark.sparkContext.broadcast(np.cumsum(np.log(np.maximum(np.arange(int(counts.agg(F.max("value")).first()[0]) + 2), 1))))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("value").to_numpy()
            part = v * b.column("log_p").to_numpy() - log_factorial.value[v]
            yield pa.RecordBatch.from_arrays([b.column("cb"), pa.array(part)], ["cb", "part"])

    kind = counts.schema["cb"].dataType.simpleString()
    terms = counts.join(rest.select("cb"), "cb", "left_semi").join(log_p, "gene").select("cb", F.col("value").cast("long"), "log_p")
    observed = terms.mapInArrow(likelihood, f"cb {kind}, part double").groupBy("cb").agg(F.sum("part").alias("observed"))
    totals = [r[0] for r in rest.select("n_umis").distinct().orderBy("n_umis").collect()]  # totals, not barcodes
    held = spark.sparkContext.broadcast((p / p.sum(), np.log(np.maximum(p, 1e-300)), np.array(totals, np.int64)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob, logs, at = held.value
        for b in batches:
            for i in b.column("id").to_pylist():
                draw = np.random.Generator(np.random.MT19937(seed * (i + 1))).choice(len(prob), int(at[-1]), p=prob)
                order = np.argsort(draw, kind="stable")
                s = draw[order]
                first = np.concatenate([[True], s[1:] != s[:-1]])
                nth = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) + 1
                step = np.empty(len(s))
                step[order] = logs[s] - np.log(nth)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.cumsum(step)[at - 1])], ["n_umis", "simulated"])

    if not totals:
        return found
    walks = spark.range(simulations).mapInArrow(walk, "n_umis long, simulated double")
    # each barcode meets the sorted walks of its total, not every walk: a total has one array of ``simulations`` numbers
    walks = walks.groupBy("n_umis").agg(F.sort_array(F.collect_list("simulated")).alias("walks"))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("walks").to_numpy(zero_copy_only=False), b.column("observed").to_pylist())
            n = np.array([np.searchsorted(w, x, "right") for w, x in rows])
            yield pa.RecordBatch.from_arrays([b.column("n_umis"), b.column("observed"), pa.array((n + 1) / (simulations + 1))], ["n_umis", "observed", "p"])

    seen = stored(rest.join(observed, "cb"))  # sums of fractions are joined by value, so they are taken once
    distinct = seen.select("n_umis", "observed").distinct().join(walks, "n_umis")
    chance = distinct.mapInArrow(below, "n_umis long, observed double, p double")
    each = seen.join(chance, ["n_umis", "observed"]).select("cb", "n_umis", "p")
    rescued = adjust_p(each).filter(F.col("p_adj") <= fdr).select("cb", "n_umis", F.lit("rescued").alias("kind"))
    return found.unionByName(rescued)


def summary(cells: DataFrame, counts: DataFrame, called: DataFrame) -> DataFrame:
    """One row of run metrics: saturation, reads, molecules, genes and integer means over called cells."""
    inside = cells.join(called.select("cb"), "cb", "left_semi")
    over = inside.agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_umis").alias("umis_in_cells"), F.floor(F.avg("n_umis")).alias("mean_umis"),
        F.floor(F.avg("n_reads")).alias("mean_reads"), F.floor(F.avg("n_genes")).alias("mean_genes"),
        F.floor(F.percentile("n_umis", 0.5)).alias("median_umis"), F.floor(F.percentile("n_genes", 0.5)).alias("median_genes"),
    )
    every = cells.agg(F.sum("n_reads").alias("reads"), F.sum("n_umis").alias("umis"))
    genes = counts.join(called.select("cb"), "cb", "left_semi").agg(F.count_distinct("gene").alias("genes_detected"))
    rows = every.join(F.broadcast(over)).join(F.broadcast(genes))
    return rows.withColumn("saturation", F.round(1 - F.col("umis") / F.col("reads"), 6))


def umi_rank(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Cells with ranks from ``first`` to ``last`` (1-based, by molecules, then barcode)."""
    from helixframe.operators.ranking import global_rank

    return global_rank(cells, [F.col("n_umis").desc(), F.col("cb")]).filter(F.col("rank").between(first, last))


def read_stats(reads: DataFrame) -> DataFrame:
    """Counters of each barcode over reads (cb, region, antisense); -1 holds reads without a listed barcode."""
    n = lambda test: F.sum(test.cast("long"))
    region = lambda name: n(F.col("region") == name).alias(name)
    return reads.groupBy(F.coalesce("cb", F.lit(-1)).alias("cb")).agg(
        F.count(F.lit(1)).alias("reads"), region("exonic"), region("intronic"), region("intergenic"), n(F.col("antisense")).alias("antisense")
    )


#: The flags of a read that the table of barcodes counts, in its order.
READ_FLAGS = (
    "cbPerfect", "cbMMunique", "cbMMmultiple", "genomeU", "genomeM", "featureU", "featureM", "exonic", "intronic", "exonicAS", "intronicAS", "mito",
    "countedU", "countedM",
)


def read_table(reads: DataFrame, counts: DataFrame) -> DataFrame:
    """The twenty columns of each barcode: its reads, those with each flag, and its molecules and genes.

    ``reads`` is (cb, the flags as booleans), with a null ``cb`` for reads without a
    listed barcode; ``counts`` (cb, gene, value).  Molecules of several genes
    are not counted by cell and give 0.
    """
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    rows = reads.groupBy("cb").agg(F.count(F.lit(1)).alias("cbMatch"), *map(n, READ_FLAGS))
    umis = counts.groupBy("cb").agg(F.sum("value").alias("nUMIunique"), F.count(F.lit(1)).alias("nGenesUnique"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = (F.lit(0).cast("long").alias(c) for c in ("nUMImulti", "nGenesMulti"))
    return rows.join(umis, "cb", "left").select("cb", "cbMatch", *READ_FLAGS, zero("nUMIunique"), zero("nGenesUnique"), *none)


def read_counts(assigned: DataFrame) -> DataFrame:
    """(cell, gene, value): reads of one gene, for libraries without molecule tags."""
    return assigned.filter("status = 'gene'").groupBy("cell", "gene").agg(F.count(F.lit(1)).alias("value"))


def ambient(counts: DataFrame, first: int, last: int) -> DataFrame:
    """(gene, value) summed over the barcodes of rank ``first`` to ``last``, from 1 by descending count."""
    cells = counts.groupBy("cb").agg(F.sum("value").alias("n_umis"))
    return counts.join(umi_rank(cells, first, last).select("cb"), "cb").groupBy("gene").agg(F.sum("value").alias("value"))


def filtered_matrix(counts: DataFrame, called: DataFrame) -> DataFrame:
    """(gene, col, value) of the called cells, their columns numbered from 1 in order of barcode."""
    return counts.join(global_rank(called, [F.col("cb")], "col"), "cb").select("gene", "col", "value")
