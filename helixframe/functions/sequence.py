"""Column expressions on bases, qualities, barcodes and mapping scores."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_bases(seq: Column) -> Column:
    """Upper-case bases, one for each character; everything but A, C, G, T is N."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def clip(seq: Column, five: int, three: int) -> Column:
    """Without ``five`` bases at the start and ``three`` at the end; empty if nothing is left."""
    left = F.length(seq) - five - three
    return F.when(left > 0, F.substring(seq, F.lit(five + 1), left)).otherwise("")


def mate_name(name: Column) -> Column:
    """A read name up to its first blank, without a mate suffix."""
    return F.regexp_replace(F.element_at(F.split(name, " "), 1), r"(/[12]|\.R[12]|_[12])$", "")


def shift_quality(qual: Column, base: int = 33, add: int = 0) -> Column:
    """Qualities moved to Phred+33, each cut to the printable range."""
    if base == 33 and add == 0:
        return qual
    shift = 33 - base + add
    code = lambda c: F.char(F.least(F.lit(126), F.greatest(F.lit(33), F.ascii(c) + shift)))
    return F.array_join(F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), code), "")


def count_n(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def pack_bases(seq: Column, size: int) -> Column:
    """Two bits a base, the first in the highest; null unless all ``size`` bases are A, C, G or T."""
    code = F.lit(0).cast("long")
    for i in range(1, size + 1):
        code = code * 4 + F.instr(F.lit("ACGT"), F.substring(seq, i, 1)) - 1
    return F.when(F.length(seq).eqNullSafe(F.lit(size)) & (count_n(clean_bases(seq)) == 0), code)


def unpack_bases(code: Column, size: int) -> Column:
    return F.concat(*(F.substring(F.lit("ACGT"), F.shiftright(code, 2 * (size - 1 - i)).bitwiseAND(F.lit(3)) + 1, F.lit(1)) for i in range(size)))


def one_apart(a: Column, b: Column) -> Column:
    """Whether two packed sequences differ in exactly one base."""
    x = a.bitwiseXOR(b)
    folded = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555).cast("long"))
    return F.bit_count(folded) == 1


def neighbours(code: Column, size: int) -> Column:
    """All packed sequences one base apart."""
    return F.array(*(code.bitwiseXOR(F.lit(d << (2 * i)).cast("long")) for i in range(size) for d in (1, 2, 3)))


def is_homopolymer(seq: Column) -> Column:
    return F.replace(seq, F.substring(seq, 1, 1), F.lit("")) == ""


def valid_umi(seq: Column) -> Column:
    """Neither an N nor one base throughout."""
    return (count_n(seq) == 0) & ~is_homopolymer(seq)


def barcode_parts(seq: Column, qual: Column, cb_start: int = 1, cb_len: int = 16, umi_start: int = 17, umi_len: int = 10) -> Column:
    """Cell barcode and UMI of a barcode read at 1-based offsets; null where the read is too short."""
    need = max(cb_start + cb_len, umi_start + umi_len) - 1
    parts = F.struct(
        F.substring(seq, cb_start, cb_len).alias("cb"), F.substring(qual, cb_start, cb_len).alias("cb_qual"),
        F.substring(seq, umi_start, umi_len).alias("umi"), F.substring(qual, umi_start, umi_len).alias("umi_qual"),
    )
    return F.when(F.length(seq) >= need, parts)


def parse_position(spec: str) -> tuple[int, int]:
    """(offset from 0, length) of ``startAnchor_startDistance_endAnchor_endDistance``; anchors at the read's start only."""
    parts = spec.split("_")
    if len(parts) != 4 or not all(re.fullmatch(r"-?\d+", p) for p in parts):
        raise ValueError(f"position {spec!r} is not startAnchor_startDistance_endAnchor_endDistance")
    a, start, b, end = map(int, parts)
    if (a, b) != (0, 0):
        raise ValueError(f"position {spec!r} is not anchored at the read's start")
    if start < 0 or end < start:
        raise ValueError(f"position {spec!r} ends before its start")
    return start, end - start + 1


def complex_parts(seq: Column, qual: Column, cb: list[str], umi: str) -> Column:
    """As :func:`barcode_parts` for a barcode of several segments, joined in the order given."""
    segments, (at, size) = [parse_position(p) for p in cb], parse_position(umi)
    need = max(start + n for start, n in [*segments, (at, size)])
    joined = lambda s: F.concat(*(F.substring(s, start + 1, n) for start, n in segments))
    parts = F.struct(
        joined(seq).alias("cb"), joined(qual).alias("cb_qual"), F.substring(seq, at + 1, size).alias("umi"), F.substring(qual, at + 1, size).alias("umi_qual")
    )
    return F.when(F.length(seq) >= need, parts)


def with_clips(cigar: Column, five: Column, three: Column, is_reverse: Column) -> Column:
    """A CIGAR text with clipped bases put back as S at its ends; neighbouring S are joined.

    ``five`` and ``three`` are clips of the read as sequenced, which change
    sides on the reverse strand.
    """
    left, right = F.when(is_reverse, three).otherwise(five), F.when(is_reverse, five).otherwise(three)
    head = F.coalesce(F.regexp_extract(cigar, r"^(\d+)S", 1).try_cast("int"), F.lit(0))
    # of a CIGAR of one S the clip is at its start
    body = F.regexp_replace(cigar, r"^\d+S", "")
    tail = F.coalesce(F.regexp_extract(body, r"(\d+)S$", 1).try_cast("int"), F.lit(0))
    core = F.regexp_replace(body, r"\d+S$", "")
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(clip(head + left), core, clip(tail + right))


def unclipped_start(start: Column, cigar: Column) -> Column:
    """Start of an alignment with the bases clipped before it (S or H) counted in; ``cigar`` as parsed."""
    lead = F.filter(F.slice(cigar, 1, 1), lambda c: c["op"].isin("S", "H"))
    return start - F.aggregate(lead, F.lit(0), lambda t, c: t + c["len"])


def mapping_quality(loci: Column, unique: int = 255) -> Column:
    return F.when(loci == 1, unique).when(loci == 2, 3).when(loci.isin(3, 4), 1).otherwise(0)


def span_penalty(span: Column, scale: float = -0.25, floor: float = -0.5) -> Column:
    """Score that a longer genomic span costs."""
    return F.ceil(F.log2(span) * scale + floor)


#: Filter category and strand (1 +, 2 -, 0 none) of junction motif codes 0 to 6.
MOTIF_CATEGORY = (0, 1, 1, 2, 2, 3, 3)
MOTIF_STRAND = (0, 1, 2, 1, 2, 1, 2)


def motif_category(motif: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MOTIF_CATEGORY)), motif + 1)


def motif_strand(motif: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MOTIF_STRAND)), motif + 1)


def cigar_sum(cigar: Column, ops: str) -> Column:
    """Total length of some operations of an array of (op, len)."""
    kept = F.filter(cigar, lambda c: c["op"].isin(*ops))
    return F.aggregate(kept, F.lit(0), lambda t, c: t + c["len"])


def parse_cigar(text: Column) -> Column:
    """``"5M2I"`` as an array of (op, len)."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)),
        lambda c: F.struct(F.right(c, F.lit(1)).alias("op"), F.rtrim(c, F.lit("MIDNSHP=X")).cast("int").alias("len")),
    )


def cigar_introns(start: Column, cigar: Column) -> Column:
    """(first, last) intronic base of each N of an alignment that starts at ``start``."""
    step = lambda s, c: F.struct(
        (s["at"] + F.when(c["op"].isin("M", "D", "N", "=", "X"), c["len"]).otherwise(0)).alias("at"),
        F.when(c["op"] == "N", F.concat(s["out"], F.array(F.struct(s["at"].alias("first"), (s["at"] + c["len"] - 1).alias("last")))))
        .otherwise(s["out"]).alias("out"),
    )
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return F.aggregate(cigar, F.struct(start.cast("long").alias("at"), none.alias("out")), step, lambda s: s["out"])


#: Motif codes of donor and acceptor bases, and the primer of 5' libraries.
MOTIFS = {"GTAG": 1, "CTAC": 2, "GCAG": 3, "CTGC": 4, "ATAC": 5, "GTAT": 6}
PRIMER = "AAGCAGTGGTATCAACGCAGAGTACATGGG"


def splice_motif(donor: Column, acceptor: Column) -> Column:
    """Motif code of an intron's first and last two bases, 0 for none of the known ones."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in MOTIFS.items() for x in pair)), F.concat(donor, acceptor)), F.lit(0))


def primer_clips(seq: Column, most: int = 3, tail: int = 8) -> tuple[Column, Column]:
    """Bases to clip at the start (the primer with up to ``most`` mismatches) and at the end (A's, if there are ``tail``)."""
    unlike = sum((F.substring(seq, i + 1, 1) != b).cast("int") for i, b in enumerate(PRIMER))
    five = F.when((F.length(seq) >= len(PRIMER)) & (unlike <= most), len(PRIMER)).otherwise(0)
    run = F.least(F.length(seq) - F.length(F.rtrim(seq, F.lit("A"))), F.length(seq) - five)
    return five, F.when(run >= tail, run).otherwise(0)


def adapter_offset(seq: Column, adapter: str, share: float, n_differs: bool = False) -> Column:
    """Where an adapter begins that may run past the end: most matches, then fewest mismatches, then first.

    Mismatches may be ``share`` of the matches; N counts as neither, or as a
    mismatch if ``n_differs``.  Without such a place it is the length of the
    sequence.
    """

    def places(column: pd.Series) -> pd.Series:
        y = np.frombuffer(adapter.encode(), np.uint8)
        out = []
        for s in column:
            x = np.frombuffer((s or "").encode(), np.uint8)
            same, other = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for i, base in enumerate(y[: len(x)]):
                part = x[i:]
                hit = part == base
                same[: len(part)] += hit
                other[: len(part)] += ~hit & ((part != 0x4E) | n_differs)
            good = np.flatnonzero((same > 0) & (other <= share * same))
            out.append(int(good[(same[good] * (len(y) + 1) - other[good]).argmax()]) if len(good) else len(x))
        return pd.Series(out, dtype="int32")

    return F.pandas_udf(places, "int")(seq)
