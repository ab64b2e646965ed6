"""Optional fields of alignment records from CIGARs, motifs and bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions import sequence as S


def edit_distance(n_mismatch: Column, cigar: Column) -> Column:
    """NM: mismatches and all inserted and deleted bases; ``cigar`` as parsed."""
    return n_mismatch + S.cigar_sum(cigar, "ID")


def transcript_strand(motifs: Column) -> Column:
    """XS: + or - if the junctions that imply a strand imply one; null without any or with both."""
    has = lambda s: F.coalesce(F.exists(motifs, lambda m: S.motif_strand(m) == s), F.lit(False))
    return F.when(has(1) & ~has(2), "+").when(has(2) & ~has(1), "-")


def junction_motifs(motifs: Column, annotated: Column) -> Column:
    """jM: motif code of each junction, 20 more if it is annotated; null without junctions."""
    codes = F.zip_with(motifs, annotated, lambda m, known: m + F.when(F.coalesce(known, F.lit(False)), 20).otherwise(0))
    return F.when(F.size(motifs) > 0, codes)


def junction_places(start: Column, cigar: Column) -> Column:
    """jI: first and last intronic base (from 1) of each junction, one after another; null without junctions."""
    introns = S.cigar_introns(start, cigar)
    return F.when(F.size(introns) > 0, F.flatten(F.transform(introns, lambda j: F.array(j["first"] + 1, j["last"] + 1))))


def mismatch_text(cigar: Column, read: Column, reference: Column) -> Column:
    """MD: matches, mismatched and deleted reference bases.

    ``cigar`` is parsed, ``read`` the aligned read with its soft clips and
    ``reference`` the bases from the alignment's start on, introns included.
    """
    uses = lambda op, kinds, n: F.when(op.isin(*kinds), n).otherwise(0)
    kind = "struct<r:int,g:int,out:array<struct<op:string,read:string,ref:string>>>"
    text = lambda s, at, n: F.substring(s, at + 1, n)

    def step(state: Column, c: Column) -> Column:
        op, n = c["op"], c["len"]
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit("M").alias("op"), text(read, state["r"] + i, F.lit(1)).alias("read"), text(reference, state["g"] + i, F.lit(1)).alias("ref")))
        gone = F.array(F.struct(F.lit("D").alias("op"), F.lit("").alias("read"), text(reference, state["g"], n).alias("ref")))
        more = F.when(op.isin("M", "=", "X"), each).when(op == "D", gone).otherwise(F.slice(each, 1, 0))
        return F.struct(
            (state["r"] + uses(op, "MIS=X", n)).alias("r"), (state["g"] + uses(op, "MDN=X", n)).alias("g"), F.concat(state["out"], more).alias("out")
        ).cast(kind)

    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.array().cast("array<struct<op:string,read:string,ref:string>>").alias("out")).cast(kind)
    bases = F.aggregate(F.filter(cigar, lambda c: c["len"] > 0), start, step, lambda s: s["out"])

    def write(state: Column, b: Column) -> Column:
        same = (b["op"] == "M") & (b["read"] == b["ref"])
        mark = F.concat(state["text"], state["run"].cast("string"), F.when(b["op"] == "D", "^").otherwise(""), b["ref"])
        return F.struct(F.when(same, state["run"] + 1).otherwise(0).alias("run"), F.when(same, state["text"]).otherwise(mark).alias("text"))

    first = F.struct(F.lit(0).alias("run"), F.lit("").alias("text"))
    return F.aggregate(bases, first, write, lambda s: F.concat(s["text"], s["run"].cast("string")))


def _numbers(kind: str, values: Column) -> Column:
    """An array as a field's text; null where it is null or empty."""
    return F.when(F.size(values) > 0, F.concat(F.lit(kind), F.array_join(F.transform(values, lambda v: v.cast("string")), ",")))


def optional_fields(names: list[str], *, first_hit: int = 1) -> Column:
    """The tab-separated optional fields of a record, in the order of ``names``; fields without a value are left out.

    Columns read, by field: NH n_loci, HI hit (counted from ``first_hit``), AS
    score, nM n_mismatch, NM n_mismatch and parsed (the CIGAR as parsed), XS
    motifs, jM motifs and annotated, jI start (0-based) and parsed, MD parsed,
    aligned (the read on the forward strand) and reference, RG group, vA
    alleles and vG places (1-based) of the variants that the record covers, vW
    wasp (code of the remapping filter).
    """
    c = F.col
    whole = lambda tag, v: F.concat(F.lit(f"{tag}:i:"), v.cast("string"))
    field = {
        "NH": lambda: whole("NH", c("n_loci")), "HI": lambda: whole("HI", c("hit") - 1 + first_hit), "AS": lambda: whole("AS", c("score")),
        "nM": lambda: whole("nM", c("n_mismatch")), "NM": lambda: whole("NM", edit_distance(c("n_mismatch"), c("parsed"))),
        "XS": lambda: F.concat(F.lit("XS:A:"), transcript_strand(c("motifs"))), "jM": lambda: _numbers("jM:B:c,", junction_motifs(c("motifs"), c("annotated"))),
        "jI": lambda: _numbers("jI:B:i,", junction_places(c("start"), c("parsed"))), "MD": lambda: F.concat(F.lit("MD:Z:"), mismatch_text(c("parsed"), c("aligned"), c("reference"))),
        "RG": lambda: F.concat(F.lit("RG:Z:"), c("group")), "vA": lambda: _numbers("vA:B:c,", c("alleles")), "vG": lambda: _numbers("vG:B:i,", c("places")), "vW": lambda: whole("vW", c("wasp")),
    }
    unknown = [n for n in names if n not in field]
    if unknown:
        raise ValueError(f"no such fields: {unknown}")
    return F.concat_ws("\t", *(field[n]() for n in names))


#: Why a read has no place.
UNMAPPED = {"other": 0, "too_short": 1, "too_many_mismatches": 2, "too_many_loci": 3}


def unmapped_field(reason: Column) -> Column:
    """uT: the code of the reason, 0 for any that is not known."""
    codes = F.create_map(*(F.lit(x) for pair in UNMAPPED.items() for x in pair))
    return F.concat(F.lit("uT:A:"), F.coalesce(F.try_element_at(codes, reason), F.lit(0)).cast("string"))
