"""Alignment tables: selection, ranking, counters, duplicates, lift-over, variants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators.intervals import as_of_join, overlap_clusters


def within_score_range(aln: DataFrame, span: int = 1) -> DataFrame:
    """Alignments at most ``span`` below their read's best score."""
    best = F.max("score").over(Window.partitionBy("read_id"))
    return aln.withColumn("_best", best).filter(F.col("score") >= F.col("_best") - span).drop("_best")


def quality_filter(aln: DataFrame, *, score_share: float = 0.66, match_share: float = 0.66, mismatches: int = 10, mismatch_share: float = 0.3) -> DataFrame:
    """Alignments whose score, matches and mismatches suffice for the read's length.

    The score threshold is truncated to an integer, that of matches is not.
    """
    span = F.col("read_len") - 1
    return aln.filter(
        (F.col("score") >= (span * score_share).cast("int")) & (F.col("n_match") >= span * match_share)
        & (F.col("n_mismatch") <= mismatches) & (F.col("n_mismatch") <= F.col("read_len") * mismatch_share)
    )


def drop_many_loci(aln: DataFrame, most: int = 10) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("read_id"))
    return aln.withColumn("n_loci", n).filter(F.col("n_loci") <= most)


def loci_status(aln: DataFrame, most: int = 10) -> DataFrame:
    """(read_id, n_loci, status): the places of every read, all counted, and ``too_many_loci`` beyond ``most``, ``multi`` or ``unique``.

    The mapping quality of a read with too many places is that of ``n_loci``.
    """
    n = aln.groupBy("read_id").agg(F.count(F.lit(1)).alias("n_loci"))
    return n.withColumn("status", F.when(F.col("n_loci") > most, "too_many_loci").when(F.col("n_loci") > 1, "multi").otherwise("unique"))


def ranked(aln: DataFrame) -> DataFrame:
    """Adds ``hit`` (1 is primary) and ``mapq``."""
    w = Window.partitionBy("read_id").orderBy(F.col("score").desc(), "n_junction", "chr", "start", "is_reverse")
    n = F.count(F.lit(1)).over(Window.partitionBy("read_id"))
    return aln.withColumns({"hit": F.row_number().over(w), "mapq": S.mapping_quality(n)})


def mapping_counters(aln: DataFrame, most: int = 10) -> DataFrame:
    """One row: reads, unique, multi, too many loci, unmapped; ``aln`` has one row a read with n_loci."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    loci = F.col("n_loci")
    return aln.agg(
        F.count(F.lit(1)).alias("reads"), n(loci == 1).alias("unique_reads"), n((loci > 1) & (loci <= most)).alias("multi_reads"),
        n(loci > most).alias("many_reads"), n(loci == 0).alias("unmapped"),
    )


def cigar_counters(aln: DataFrame) -> DataFrame:
    """One row: matched, inserted and deleted bases, and numbers of insertions, deletions and splices."""
    c = S.parse_cigar(F.col("cigar"))
    times = lambda op: F.size(F.filter(F.col("c"), lambda x: x["op"] == op))
    return aln.select(c.alias("c")).agg(
        F.sum(S.cigar_sum(F.col("c"), "M")).alias("m_bases"), F.sum(S.cigar_sum(F.col("c"), "I")).alias("i_bases"),
        F.sum(S.cigar_sum(F.col("c"), "D")).alias("d_bases"), F.sum(times("I")).alias("insertions"), F.sum(times("D")).alias("deletions"),
        F.sum(times("N")).alias("splices"),
    )


def mark_duplicates(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``duplicate``: all pairs of a key but that of the best score (then smallest id)."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "pair_id")
    return pairs.withColumn("duplicate", F.row_number().over(w) > 1)


def lift(points: DataFrame, chain: DataFrame) -> DataFrame:
    """Adds ``lifted``: the position on the new assembly, null where there is none.

    ``points`` is (id, chr, pos, is_end), ``chain`` (chr, s1, s2, len).  A start
    outside every block moves to the next block, an end to the block before.
    """
    w = Window.partitionBy("chr").orderBy("s1")
    blocks = chain.select("chr", "s1", "s2", "len", F.lead("s2").over(w).alias("next2"))
    head = chain.groupBy("chr").agg(F.min_by("s2", "s1").alias("_first2"))
    rows = as_of_join(points, blocks, start="s1").join(F.broadcast(head), "chr", "left")
    inside = F.col("pos") < F.col("s1") + F.col("len")
    lifted = (
        F.when(F.col("s1").isNotNull() & inside, F.col("s2") + F.col("pos") - F.col("s1"))
        .when(F.col("is_end"), F.col("s2") + F.col("len") - 1)
        .when(F.col("s1").isNull(), F.col("_first2")).otherwise(F.col("next2"))
    )
    return rows.select(*points.columns, lifted.alias("lifted"))


def substitute_variants(variants: DataFrame) -> DataFrame:
    """Variants (chr, pos, ref_len, alt) that do not reach into one kept before, in order of position.

    A greedy rule along a chromosome: a variant is kept if it starts at or after
    the end of the last kept one.  Only variants that overlap, directly or by
    others, bear on each other, so the rule runs within each such group, along
    sorted rows of many groups.
    """

    names = variants.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end = None, -1
        for batch in batches:
            ok = []
            for *group, pos, size in zip(*(batch.column(c).to_pylist() for c in ("chr", "_group", "pos", "ref_len"))):
                if group != of:
                    of, end = group, -1
                ok.append(end is not None and pos >= end)
                if ok[-1]:
                    end = None if size is None else pos + size
            yield batch.filter(pa.array(ok, pa.bool_())).select(names)

    last = F.col("pos") + F.greatest(F.col("ref_len"), F.lit(1)) - 1  # groups part where no base is shared
    groups = overlap_clusters(variants.withColumn("_last", last), ["chr"], start="pos", end="_last", name="_group").drop("_last")
    rows = groups.repartition("chr", "_group").sortWithinPartitions("chr", "_group", "pos", F.col("alt").asc_nulls_last())
    return rows.mapInArrow(keep, variants.schema)


def transform_blocks(chromosomes: DataFrame, variants: DataFrame) -> DataFrame:
    """(chr, old_start, new_start, len): stretches between insertions and deletions, on the old and the new sequence.

    ``chromosomes`` is (chr, length), ``variants`` (chr, pos, ref_len, alt) as
    kept.  The bases that an allele and its replacement share in number belong
    to the stretch before.  The windows run over insertions and deletions.
    """
    shift = F.length("alt") - F.col("ref_len")
    cuts = variants.filter(shift != 0).select("chr", "pos", (F.col("pos") + F.col("ref_len")).alias("old_start"), shift.alias("shift"), F.least(F.length("alt"), F.col("ref_len")).alias("kept"))
    first = chromosomes.select("chr", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("old_start"), F.lit(0).alias("shift"), F.lit(0).alias("kept"))
    rows = first.unionByName(cuts.withColumn("pos", F.col("pos").cast("long")))
    w = Window.partitionBy("chr").orderBy("pos")
    moved = F.sum("shift").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("chr", "old_start", (F.col("old_start") + moved).alias("new_start"), F.lead(F.col("pos") + F.col("kept")).over(w).alias("until"))
    rows = rows.join(chromosomes.select("chr", F.col("length").alias("_end")), "chr")
    return rows.select("chr", "old_start", "new_start", (F.coalesce("until", "_end") - F.col("old_start")).alias("len"))


def transformed(chromosomes: DataFrame, variants: DataFrame, suffix: str = "") -> DataFrame:
    """(chr, seq): sequences (chr, seq) with the kept variants put in; ``suffix`` is added to the names."""
    item = F.struct("pos", "ref_len", "alt")
    of = variants.groupBy("chr").agg(F.sort_array(F.collect_list(item)).alias("v"))
    rows = chromosomes.join(of, "chr", "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("v", lambda x: (x["pos"] + x["ref_len"]).cast("long")))
    text = lambda at, n: F.substring("seq", at.cast("int") + 1, n.cast("int"))
    parts = F.zip_with("v", F.slice(ends, F.lit(1), F.size("v")), lambda x, end: F.concat(text(end, x["pos"] - end), x["alt"]))
    tail = text(F.element_at(ends, -1), F.length("seq"))
    new = F.when(F.col("v").isNull(), F.col("seq")).otherwise(F.concat(F.array_join(parts, ""), tail))
    return rows.select(F.concat("chr", F.lit(suffix)).alias("chr"), new.alias("seq"))


def allele(base, ref, first, second):
    """1 reference, 2 first, 3 second allele, 4 none of them."""
    return F.when(base == ref, 1).when(base == first, 2).when(base == second, 3).otherwise(4)


def lift_annotation(lines: DataFrame, chain: DataFrame) -> DataFrame:
    """(line_no, value, lifted): annotation lines on the new assembly; those that cannot be lifted stay as they are.

    ``lines`` is (line_no, value), ``chain`` (chr, new_chr, s1, s2, len).  Empty
    lines and comments are left out.  A line with fewer than five fields, or
    whose end would lie before its start, is not lifted; one of a chromosome
    without a chain fails the query.
    """
    f = F.split("value", r"\s+")
    rows = lines.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    rest = F.regexp_extract("value", r"^\s*\S+\s+\S+\s+\S+\s+\S+\s+\S+(.*)$", 1)
    parsed = rows.select("line_no", "value", f.alias("f"), rest.alias("rest"), f[0].alias("chr")).join(
        F.broadcast(chain.groupBy("chr").agg(F.first("new_chr").alias("new_chr"))), "chr", "left"
    )  # a chain file has a few chromosomes
    known = F.when(F.col("new_chr").isNull(), F.raise_error(F.concat(F.lit("no chain for chromosome "), "chr"))).otherwise(F.col("new_chr"))
    number = lambda i: F.coalesce(F.get("f", F.lit(i)).try_cast("long"), F.lit(0))
    parsed = parsed.withColumn("new_chr", known).withColumn("_full", F.size("f") >= 5)
    ends = parsed.select(
        F.col("line_no").alias("id"), "chr", F.explode(F.array(F.struct(number(3).alias("pos"), F.lit(False).alias("is_end")), F.struct(number(4).alias("pos"), F.lit(True).alias("is_end")))).alias("e")
    ).select("id", "chr", "e.pos", "e.is_end")
    at = lift(ends, chain.select("chr", "s1", "s2", "len"))
    at = at.groupBy("id").agg(F.max(F.when(~F.col("is_end"), F.col("lifted"))).alias("start"), F.max(F.when(F.col("is_end"), F.col("lifted"))).alias("end"))
    out = parsed.join(at, F.col("line_no") == F.col("id"), "left")
    ok = F.col("_full") & F.coalesce(F.col("end") >= F.col("start"), F.lit(False))
    new = F.concat(F.concat_ws("\t", "new_chr", F.get("f", F.lit(1)), F.get("f", F.lit(2)), F.col("start").cast("string"), F.col("end").cast("string")), F.col("rest"))
    return out.select("line_no", F.when(ok, new).otherwise(F.col("value")).alias("value"), ok.alias("lifted"))


def allele_swaps(reads: DataFrame, sites: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(codes, swaps) of the allele test of mapped reads.

    ``reads`` is (read_id, n_loci, seq in the direction of the genome),
    ``sites`` (read_id, read_pos, allele1, allele2, allele) of each variant site
    that a read covers.  ``codes`` (read_id, code) has 2 for reads of several
    places, 7 for more than ``most`` sites and 3 for a base that is neither
    allele nor the reference; ``swaps`` (read_id, combo, seq) the other reads once for each
    combination of alleles but their own, to be aligned again.
    """
    item = F.struct("read_pos", "allele1", "allele2", "allele")
    of = sites.groupBy("read_id").agg(F.sort_array(F.collect_list(item)).alias("sites"))
    rows = reads.join(of, "read_id")
    code = F.when(F.col("n_loci") > 1, 2).when(F.size("sites") > most, 7).when(F.exists("sites", lambda x: x["allele"] > 3), 3)
    rows = rows.withColumn("code", code)
    open_ = rows.filter("code is null")
    combos = F.sequence(F.lit(0), F.expr("shiftleft(1, size(sites)) - 1"))
    own = F.forall(F.transform("sites", lambda x, i: x["allele"] == F.call_function("getbit", F.col("combo"), i) + 1), lambda ok: ok)
    each = open_.select("read_id", "seq", "sites", F.explode(combos).alias("combo")).filter(~own)
    put = lambda seq, x: F.concat(F.substring(seq, F.lit(1), x["x"]["read_pos"]), x["base"], F.substring(seq, x["x"]["read_pos"] + 2, F.length(seq)))
    chosen = F.transform("sites", lambda x, i: F.struct(x.alias("x"), F.when(F.call_function("getbit", F.col("combo"), i) == 1, x["allele2"]).otherwise(x["allele1"]).alias("base")))
    swaps = each.select("read_id", "combo", F.aggregate(chosen, F.col("seq"), put).alias("seq"))
    return rows.filter("code is not null").select("read_id", "code"), swaps


def allele_codes(first: DataFrame, codes: DataFrame, swaps: DataFrame, again: DataFrame) -> DataFrame:
    """(read_id, code): 1 passed; 4 a swapped read has no place, 5 several, 6 another one; with ``codes`` as they are.

    ``first`` is (read_id, place) of the reads, ``again`` (read_id, combo,
    place) of the swapped ones, a row for each place; the first combination
    that does not come back decides.
    """
    n = again.groupBy("read_id", "combo").agg(F.count(F.lit(1)).alias("n"), F.first("place").alias("new"))
    rows = swaps.select("read_id", "combo").join(n, ["read_id", "combo"], "left").join(first.select("read_id", "place"), "read_id")
    bad = F.when(F.col("n").isNull(), 4).when(F.col("n") > 1, 5).when(F.col("new") != F.col("place"), 6)
    out = rows.groupBy("read_id").agg(F.min_by(bad, F.when(bad.isNotNull(), F.col("combo"))).alias("code"))
    return codes.unionByName(out.select("read_id", F.coalesce("code", F.lit(1)).alias("code")))
