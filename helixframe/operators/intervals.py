"""Joins and sweeps over half-open intervals on chromosomes.

Overlap joins are equi-joins on fixed bins.  A pair is reported only in the bin
that holds the later of its two starts, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    first, last = F.floor(start / width), F.floor((end - 1) / width)
    return F.explode(F.sequence(first, F.greatest(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, *, chrom: str = "chr", start: str = "start", end: str = "end",
                 r_start: str = "r_start", r_end: str = "r_end", width: int = 4096) -> DataFrame:
    """Inner join of rows whose intervals overlap; both sides share column ``chrom``."""
    a = left.filter(F.col(end) > F.col(start)).withColumn("_bin", _bins(F.col(start), F.col(end), width))
    b = right.filter(F.col(r_end) > F.col(r_start)).withColumn("_bin", _bins(F.col(r_start), F.col(r_end), width))
    hit = (F.col(r_start) < F.col(end)) & (F.col(r_end) > F.col(start))
    once = F.floor(F.greatest(start, r_start) / width) == F.col("_bin")
    return a.join(b, [chrom, "_bin"]).filter(hit & once).drop("_bin")


def contain_join(inner: DataFrame, outer: DataFrame, *, chrom: str = "chr", start: str = "start", end: str = "end",
                 r_start: str = "r_start", r_end: str = "r_end", width: int = 4096) -> DataFrame:
    """Pairs in which the left interval lies within the right one."""
    a = inner.withColumn("_bin", F.floor(F.col(start) / width))
    b = outer.filter(F.col(r_end) > F.col(r_start)).withColumn("_bin", _bins(F.col(r_start), F.col(r_end), width))
    inside = (F.col(r_start) <= F.col(start)) & (F.col(r_end) >= F.col(end))
    return a.join(b, [chrom, "_bin"]).filter(inside).drop("_bin")


def as_of_join(points: DataFrame, blocks: DataFrame, *, chrom: str = "chr", at: str = "pos", start: str = "start",
               width: int = 1 << 16) -> DataFrame:
    """Each point with the block of the greatest start at or before it (nulls without one).

    Blocks are gathered by bins of ``width`` positions, and each bin carries the
    last block of the bins before; a point looks into its own bin only, so that
    no chromosome is sorted in one task and a crowded bin of points can be split.
    """
    extra = [c for c in blocks.columns if c != chrom]
    block = F.struct(F.col(start).alias("at"), F.struct(*extra).alias("row"))
    own = blocks.groupBy(chrom, F.floor(F.col(start) / width).alias("_bin")).agg(F.sort_array(F.collect_list(block)).alias("_own"))
    asked = points.select(chrom, F.floor(F.col(at) / width).alias("_bin")).distinct()
    before = Window.partitionBy(chrom).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.element_at("_own", -1), ignorenulls=True).over(before)
    bins = asked.join(own, [chrom, "_bin"], "full").select(chrom, "_bin", "_own", carried.alias("_before"))
    rows = points.withColumn("_bin", F.floor(F.col(at) / width)).join(bins, [chrom, "_bin"], "left")
    mine = F.try_element_at(F.filter("_own", lambda b: b["at"] <= F.col(at)), F.lit(-1))
    out = rows.withColumn("_block", F.coalesce(mine, "_before"))
    return out.select(chrom, *(c for c in points.columns if c != chrom), *(F.col(f"_block.row.{c}") for c in extra))


def _with_past(df: DataFrame, keys: list[str], order: list[str], width: int, **running) -> DataFrame:
    """Adds ``_bin`` and, for each name, what an aggregate gives over all rows of the keys before a row.

    It runs within bins of the first order column; one row a bin runs along the
    keys.  ``running``: name = (F.max or F.sum, column).
    """
    rows = df.withColumn("_bin", F.floor(F.col(order[0]) / width))
    along = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*keys, "_bin").agg(*(agg(F.col(c)).alias(f"_in{name}") for name, (agg, c) in running.items()))
    bins = bins.select(*keys, "_bin", *(agg(F.col(f"_in{name}")).over(along).alias(f"_to{name}") for name, (agg, _) in running.items()))
    out = rows.join(bins, [*keys, "_bin"])
    both = {F.max: F.greatest, F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    values = {name: both[agg](agg(F.col(c)).over(inside), F.col(f"_to{name}")) for name, (agg, c) in running.items()}
    return out.withColumns(values).drop(*(f"_to{name}" for name in running))


def _numbered(rows: DataFrame, keys: list[str], order: list[str], width: int, new: Column, name: str) -> DataFrame:
    """Adds how many rows up to this one are ``new``."""
    out = _with_past(rows.withColumn("_new", new), keys, order, width, _so_far=(F.sum, "_new"))
    return out.withColumn(name, F.col("_so_far") + F.col("_new")).drop("_new", "_so_far", "_bin")


def overlap_clusters(df: DataFrame, keys: list[str], *, start: str = "start", end: str = "end", name: str = "cluster", width: int = 1 << 20) -> DataFrame:
    """Number the groups of rows that are linked by overlap, in order of position (from 1)."""
    order = [start, end, "_tie"]  # equal rows keep one order in both sweeps
    rows = _with_past(df.withColumn("_tie", F.monotonically_increasing_id()), keys, order, width, _past=(F.max, end)).drop("_bin")
    new = F.when(F.col(start) <= F.col("_past"), 0).otherwise(1)
    return _numbered(rows, keys, order, width, new, name).drop("_past", "_tie")


def merge_islands(df: DataFrame, keys: list[str], *, start: str = "start", end: str = "end", width: int = 1 << 20) -> DataFrame:
    """Unions of intervals of a key that overlap or touch."""
    marked = overlap_clusters(df, keys, start=start, end=end, name="_island", width=width)
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def mate_clusters(df: DataFrame, keys: list[str], *, pos: str = "pos", mate: str = "mate_pos", order: str = "record",
                  width: int = 1 << 20) -> DataFrame:
    """Adds ``cluster`` (from 1): records that a sweep along the keys keeps together.

    A record begins a new cluster if it lies past every mate seen since its
    cluster began; while a cluster has no mate (``mate`` null) it goes on.  Once a
    cluster has one, that is the furthest mate so far, so of the records between
    two with a mate only the first past it begins a cluster.
    """
    rows = df.withColumn("_mated", F.col(mate).isNotNull().cast("int"))
    rows = _with_past(rows, keys, [pos, order], width, _past=(F.max, mate), _group=(F.sum, "_mated")).drop("_bin", "_mated")
    beyond = rows.filter((F.col("_group") > 0) & (F.col(pos) > F.col("_past")))
    first = beyond.groupBy(*keys, "_group").agg(F.min(F.struct(pos, order)).alias("_first"))
    out = rows.join(first, [*keys, "_group"], "left")
    new = F.coalesce((F.struct(pos, order) == F.col("_first")).cast("int"), F.lit(0))
    out = _numbered(out, keys, [pos, order], width, new, "cluster")
    return out.withColumn("cluster", F.col("cluster") + 1).drop("_past", "_group", "_first")


def coverage(df: DataFrame, *, chrom: str = "chr", start: str = "start", end: str = "end", weight: Column | None = None,
             width: int = 1 << 20) -> DataFrame:
    """Runs (chr, start, end, value) of constant non-zero summed weight.

    Weights should be integers (scale fractions first), so that equal values
    are equal.  Prefix sums are taken per bin of ``width`` positions; only bin
    totals are ordered along a whole chromosome.
    """
    w = F.lit(1) if weight is None else weight
    ends = F.explode(F.array(F.struct(F.col(start).alias("pos"), w.alias("d")), F.struct(F.col(end).alias("pos"), (-w).alias("d"))))
    steps = df.filter(F.col(end) > F.col(start)).select(chrom, ends.alias("e")).groupBy(chrom, F.col("e.pos").alias("pos"))
    steps = steps.agg(F.sum("e.d").alias("d")).filter("d <> 0").withColumn("_bin", F.floor(F.col("pos") / width))
    along = Window.partitionBy(chrom).orderBy("_bin")
    bins = steps.groupBy(chrom, "_bin").agg(F.sum("d").alias("t"), F.min("pos").alias("first"))
    bins = bins.select(
        chrom, "_bin", F.coalesce(F.sum("t").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lead("first").over(along).alias("after"),
    )
    inside = Window.partitionBy(chrom, "_bin").orderBy("pos")
    runs = steps.join(bins, [chrom, "_bin"]).select(
        chrom, F.col("pos").alias(start), F.coalesce(F.lead("pos").over(inside), "after").alias(end),
        (F.col("base") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("value"),
    )
    return runs.filter(F.col("value") != 0)
