"""Chimeric pairs of a read's segments and their junctions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S

#: Bases between segments of one strand from which on they are chimeric.
FAR = 1_000_000


def chimeric_pairs(segments: DataFrame, far: int = FAR) -> DataFrame:
    """(read_id, first, second): segments of a read on other chromosomes or strands, or far apart.

    ``segments`` is (read_id, seg, chr, start, end, is_reverse); the pairs of a
    read, which has a few segments, come from a join on the read.
    """
    a = segments.select("read_id", F.struct("seg", "chr", "start", "end", "is_reverse").alias("first"))
    b = segments.select("read_id", F.struct("seg", "chr", "start", "end", "is_reverse").alias("second"))
    apart = F.greatest(F.col("second.start") - F.col("first.end"), F.col("first.start") - F.col("second.end"), F.lit(0))
    unlike = (F.col("first.chr") != F.col("second.chr")) | (F.col("first.is_reverse") != F.col("second.is_reverse")) | (apart > far)
    return a.join(b, "read_id").filter((F.col("first.seg") < F.col("second.seg")) & unlike)


@dataclass(frozen=True)
class Gates:
    """Thresholds of chimeric pairs (fixed values: the usual defaults, with segments of 12 bases at least)."""

    segment: int = 12
    overhang: int = 20
    score: int = 0
    drop: int = 20
    separation: int = 10
    read_gap: int = 0
    places: int = 10
    other_junction: int = -1
    far: int = 589_824


def _in_read(side: str) -> tuple[Column, Column]:
    """Begin and end of a segment in the read as it was sequenced."""
    c = lambda x: F.col(f"{side}.{x}")
    return F.when(c("is_reverse"), c("read_len") - c("read_end")).otherwise(c("read_start")), F.when(c("is_reverse"), c("read_len") - c("read_start")).otherwise(c("read_end"))


def _shared(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.greatest(F.lit(0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))


def best_partners(segments: DataFrame, g: Gates = Gates()) -> DataFrame:
    """(read_id, donor, acceptor, overlap, score): each read's best segment with the partner that fits it best, if it passes all gates.

    ``segments`` is (read_id, seg, chr, start, end, is_reverse, read_start,
    read_end, read_len, score, plus, minus, other): read places half-open on
    the forward strand of the genome, and whether the segment has introns with
    a motif of the forward strand, of the reverse one, and without a motif.

    The main segment has the highest score (the smallest ``seg`` on ties) and
    no more than ``places`` rivals, or one.  Neither segment has an intron
    without a motif, and motifs must not tell different strands.  Beyond what
    both cover of the read, each is longer than ``segment``; between them lie
    ``read_gap`` bases at most.  A pair scores both scores less the overlap; it
    must reach ``score``, come within ``drop`` of the read's length and exceed
    by more than ``separation`` the best pair whose partner shares no base of
    the read with its own.  Without an overlap both have ``overhang`` bases.
    The two lie on different chromosomes or strands or further apart than
    ``far``.  The donor comes first in the read.  A read's segments are joined
    with its main one only.
    """
    fields = ["seg", "chr", "start", "end", "is_reverse", "read_start", "read_end", "read_len", "score", "plus", "minus", "other"]
    rows = segments.select("read_id", F.struct(*fields).alias("b"), F.count(F.lit(1)).over(Window.partitionBy("read_id")).alias("n"))
    main = rows.groupBy("read_id").agg(F.min_by("b", F.struct(-F.col("b.score"), F.col("b.seg"))).alias("a"))
    pair = rows.join(main, "read_id").filter((F.col("a.seg") != F.col("b.seg")) & ((F.col("n") <= g.places) | (F.col("n") == 2)))
    one, two = _in_read("a"), _in_read("b")
    known = lambda s: F.col(f"{s}.plus") | F.col(f"{s}.minus")
    same_way = lambda s: F.col(f"{s}.is_reverse") != F.col(f"{s}.plus")
    overlap = _shared(one, two)
    size = lambda x: x[1] - x[0]
    room = (one[0] >= g.segment) | (one[1] - 1 + g.segment < F.col("a.read_len"))
    ok = (
        room & (size(one) >= g.segment) & ~F.col("a.other") & ~F.col("b.other") & ~(F.col("a.plus") & F.col("a.minus"))
        & (~known("a") | ~known("b") | (same_way("a") == same_way("b"))) & (F.least(size(one), size(two)) > g.segment + overlap)
        & (one[1] + g.read_gap >= two[0]) & (two[1] + g.read_gap >= one[0])
    )
    fit = pair.filter(ok).select("read_id", "a", "b", overlap.alias("overlap"), (F.col("a.score") + F.col("b.score") - overlap).alias("score"))
    best = fit.groupBy("read_id").agg(F.min_by(F.struct("a", "b", "overlap", "score"), F.struct(-F.col("score"), F.col("b.seg"))).alias("best"))
    best = best.select("read_id", "best.*")
    rivals = fit.select("read_id", F.col("b").alias("c"), F.col("score").alias("next"))
    rivals = best.join(rivals, "read_id").filter((F.col("c.seg") != F.col("b.seg")) & (_shared(_in_read("b"), _in_read("c")) == 0)).groupBy("read_id").agg(F.max("next").alias("next"))
    rows = best.join(rivals, "read_id", "left")
    apart = F.greatest(F.col("b.start") - F.col("a.end"), F.col("a.start") - F.col("b.end"), F.lit(0))
    unlike = (F.col("a.chr") != F.col("b.chr")) | (F.col("a.is_reverse") != F.col("b.is_reverse")) | (apart > g.far)
    long = (F.col("overlap") > 0) | (F.least(size(one), size(two)) >= g.overhang)
    clear = F.coalesce(F.col("next") + g.separation < F.col("score"), F.lit(True))
    rows = rows.filter((F.col("score") >= g.score) & (F.col("score") + g.drop >= F.col("a.read_len")) & clear & long & unlike)
    first = one[0] <= two[0]
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return rows.select("read_id", pick("a", "b").alias("donor"), pick("b", "a").alias("acceptor"), "overlap", "score")


def typed(pairs: DataFrame, g: Gates = Gates()) -> DataFrame:
    """Pairs with ``type`` (see :func:`junction_type`) that still pass once a junction without a motif has cost its penalty."""
    worth = F.col("score") + F.when(F.col("type") == 0, 1 + g.other_junction).otherwise(0)
    return pairs.filter((worth >= g.score) & (worth + g.drop >= F.col("donor.read_len")))


def junction_type(same: Column, donor: Column, acceptor: Column) -> Column:
    """Motif code of the two bases at either side, 0 unless chromosome and strand are the ``same``."""
    return F.when(same, S.splice_motif(donor, acceptor)).otherwise(0)


def repeat_length(same_chr: Column, ahead: Column, behind: Column, most: int = 20) -> Column:
    """Bases that agree going on from the donor (``ahead``) and back from the acceptor (``behind``).

    ``behind`` is read from its end.  N agrees with nothing; on different
    chromosomes there is no repeat.
    """
    back = F.reverse(behind)
    n = F.least(F.length(ahead), F.length(back), F.lit(most))
    base = lambda s, i: F.substring(s, i, F.lit(1))
    unlike = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (base(ahead, i) != base(back, i)) | ~base(ahead, i).isin(*"ACGT"))
    return F.when(~same_chr | (n == 0), 0).otherwise(F.coalesce(F.try_element_at(unlike, F.lit(1)) - 1, n))


def junction_lines(rows: DataFrame) -> DataFrame:
    """Fourteen tab-separated columns a junction: donor, acceptor, type, repeats, read, starts and CIGARs."""
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    cols = [
        "donor_chr", "donor_pos", sign("donor_reverse"), "acceptor_chr", "acceptor_pos", sign("acceptor_reverse"), "type", "repeat_donor",
        "repeat_acceptor", "name", F.col("donor_start") + 1, "donor_cigar", F.col("acceptor_start") + 1, "acceptor_cigar",
    ]
    return rows.select(F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in cols)).alias("value"))
