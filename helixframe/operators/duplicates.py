"""Duplicate marking of paired records in order of position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.intervals import mate_clusters

KEY = ["unclip1", "unclip2", "flag1", "flag2", "cigar1", "cigar2", "mate2"]


def marked(records: DataFrame, *, mark_multi: bool = False, mate2_bases: int = 0, width: int = 1 << 20) -> DataFrame:
    """Adds ``duplicate``.

    ``records`` is (record, name, chr, pos, mate_pos, flag, n_loci, score,
    unclip, cigar, seq), ``record`` the order at one position.  Every record of a
    read with one place (and, with ``mark_multi``, of one with several) is a
    duplicate at first.  Clusters of records are made by the mates of reads with
    one place; within a cluster, pairs that agree in unclipped starts, flags,
    CIGARs and the first ``mate2_bases`` bases of mate 2 are one molecule, and
    that of the best score (then of the first name by length and letters) is
    not a duplicate.  A record whose mate is not in its cluster stays marked.
    """
    one = F.col("n_loci") == 1
    rows = records.withColumn("_mate", F.when(one & (F.col("mate_pos") > F.col("pos")), F.col("mate_pos")))
    rows = mate_clusters(rows, ["chr"], mate="_mate", width=width).filter(one)
    side = F.when(F.col("flag").bitwiseAND(F.lit(0x80)) > 0, 2).otherwise(1)
    seq = F.substring("seq", 1, mate2_bases) if mate2_bases else F.lit("")
    cols = {"unclip": F.col("unclip"), "flag": F.col("flag"), "cigar": F.col("cigar")}
    of = lambda c, i: F.max(F.when(side == i, c))
    pairs = rows.groupBy("chr", "cluster", "name").agg(
        *(of(c, i).alias(f"{k}{i}") for k, c in cols.items() for i in (1, 2)), of(seq, 2).alias("mate2"), of(F.col("score"), 1).alias("score"),
        F.count(F.lit(1)).alias("_n"), F.count_distinct(side).alias("_sides"),
    ).filter("_n = 2 and _sides = 2")
    best = Window.partitionBy("chr", "cluster", *KEY).orderBy(F.col("score").desc(), F.length("name"), "name")
    kept = pairs.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("chr", "cluster", "name")
    free = rows.join(kept, ["chr", "cluster", "name"]).select("record", F.lit(True).alias("_free"))
    first = one | F.lit(mark_multi)
    return records.join(free, "record", "left").withColumn("duplicate", first & F.col("_free").isNull()).drop("_free")
