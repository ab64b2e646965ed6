"""Alignment records: flags, tags, mates, template lengths, SAM lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators.intervals import contain_join


def flag(reverse: Column, hit: Column, *, paired: Column | None = None, proper: Column | None = None, mate_reverse: Column | None = None,
         mate: Column | None = None, set_bits: int = 0, keep_bits: int = 0xFFFF) -> Column:
    """SAM flag: 16 reverse, 256 any hit but the first; with mates 1, 2, 32 and 64 or 128."""
    bit = lambda test, value: F.when(test, value).otherwise(0)
    out = bit(reverse, 16) + bit(hit > 1, 256)
    if paired is not None:
        out = out + bit(paired, 1) + bit(proper, 2) + bit(mate_reverse, 32) + F.when(mate == 1, 64).otherwise(128)
    return out.bitwiseAND(F.lit(keep_bits)).bitwiseOR(F.lit(set_bits))


def cigar_text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")


def tag(name: str, value: Column) -> Column:
    """An integer tag; null where the value is."""
    return F.concat(F.lit(f"{name}:i:"), value.cast("string"))


def sam_lines(hits: DataFrame, fields: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(read_id, hit, line) of ranked alignments, and the columns to ``keep``.

    Needs read_id, hit, n_loci, mapq, chr_name, start (0-based), is_reverse,
    cigar (text), seq, qual, score, n_mismatch; null sequences are ``*``.
    ``fields`` is the text of the optional fields (see
    ``tags.optional_fields``), by default NH, HI, AS and nM.  Order the lines
    by (chr, start) or (read_id, hit) where they are written.
    """
    if fields is None:
        fields = F.concat_ws("\t", tag("NH", F.col("n_loci")), tag("HI", F.col("hit")), tag("AS", F.col("score")), tag("nM", F.col("n_mismatch")))
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    turned = F.when(F.col("is_reverse"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    line = F.concat_ws(
        "\t", F.col("read_id").cast("string"), flag(F.col("is_reverse"), F.col("hit")).cast("string"), "chr_name", (F.col("start") + 1).cast("string"),
        F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.coalesce(turned, F.lit("*")),
        F.when(F.col("is_reverse"), F.reverse(star("qual"))).otherwise(star("qual")),
        F.when(fields != "", fields),
    )
    return hits.select("read_id", "hit", line.alias("line"), *keep)


def header_lines(chromosomes: DataFrame) -> DataFrame:
    """@SQ lines of (chr_name, length), in the order of column ``chr``."""
    return chromosomes.orderBy("chr").select(F.concat(F.lit("@SQ\tSN:"), "chr_name", F.lit("\tLN:"), F.col("length").cast("string")).alias("line"))


def unmapped_lines(reads: DataFrame, mapped: DataFrame) -> DataFrame:
    """Lines of the reads (read_id, seq, qual) without any alignment."""
    left = reads.join(mapped.select("read_id"), "read_id", "left_anti")
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    line = F.concat_ws("\t", F.col("read_id").cast("string"), F.lit("4\t*\t0\t0\t*\t*\t0\t0"), star("seq"), star("qual"), F.lit("NH:i:0\tHI:i:0\tuT:A:1"))
    return left.select("read_id", line.alias("line"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """(name, flag, chr_name, start, mapq, cigar, seq, qual, tags) of a column ``value`` of SAM text."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("@")).filter(F.size(f) >= 11).select(f.alias("f"))
    at = lambda i: F.element_at("f", i)
    pairs = F.transform(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.expr("1").alias("_"), t.alias("t")))
    tags = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], F.regexp_replace(p["t"], r"^..:.:", ""))))
    return rows.select(
        at(1).alias("name"), at(2).cast("int").alias("flag"), at(3).alias("chr_name"), (at(4).cast("long") - 1).alias("start"), at(5).cast("int").alias("mapq"),
        at(6).alias("cigar"), at(10).alias("seq"), at(11).alias("qual"), tags.alias("tags"),
    )


def distinct_first(aln: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row, in ``order``, of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return aln.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def pair_mates(mates: DataFrame, max_gap: int = 589_824, proper_span: int = 0) -> DataFrame:
    """Pairs of alignments of mates 1 and 2 of a read: same chromosome, opposite strands, facing each other.

    ``mates`` is (read_id, mate, chr, start, end, is_reverse).  Returns read_id,
    chr, start1, start2, ``tlen`` (of mate 1: negative if it lies to the right)
    and ``proper`` (within ``proper_span``, 0 meaning any).
    """
    one = mates.filter("mate = 1").select("read_id", "chr", F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("is_reverse").alias("rev1"))
    two = mates.filter("mate = 2").select("read_id", "chr", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("is_reverse").alias("rev2"))
    rows = one.join(two, ["read_id", "chr"]).filter("rev1 <> rev2")
    left = F.when(F.col("rev1"), F.col("start2")).otherwise(F.col("start1"))
    right = F.when(F.col("rev1"), F.col("end1")).otherwise(F.col("end2"))
    gap = F.greatest("start1", "start2") - F.least("end1", "end2")
    rows = rows.filter((left < right) & (gap <= max_gap))
    span = F.greatest("end1", "end2") - F.least("start1", "start2")
    tlen = F.when(F.col("start1") <= F.col("start2"), span).otherwise(-span)
    proper = F.lit(True) if not proper_span else span <= proper_span
    return rows.select("read_id", "chr", "start1", "start2", tlen.alias("tlen"), proper.alias("proper"))


def covered_sites(blocks: DataFrame, sites: DataFrame, width: int = 4096) -> DataFrame:
    """Sites (chr, locus, ...) inside alignment blocks (read_id, chr, start, end, ...), with ``block_pos`` from the block's start."""
    points = sites.withColumns({"start": F.col("locus"), "end": F.col("locus") + 1})
    spans = blocks.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    hits = contain_join(points, spans, width=width)
    return hits.withColumn("block_pos", F.col("locus") - F.col("r_start")).drop("start", "end", "r_start", "r_end")
