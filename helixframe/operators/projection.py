"""Alignments in the coordinates of transcripts: positions, rebuilt CIGAR, primary hit, mapping quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators.filters import PROJECTIONS, projectable
from helixframe.operators.intervals import contain_join
from helixframe.operators.records import cigar_text, flag
from helixframe.operators.seeds import TILE
from helixframe.operators.transcripts import with_offsets


def _op(kind: str, size: Column) -> Column:
    return F.struct(F.lit(kind).alias("op"), size.cast("int").alias("len"))


def merged(cigar: Column) -> Column:
    """A parsed CIGAR without introns and empty operations, neighbours of one kind joined."""
    step = lambda out, c: F.when((F.size(out) > 0) & (F.element_at(out, -1)["op"] == c["op"]),
                                 F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(_op_like(out, c)))).otherwise(F.concat(out, F.array(c)))
    kept = F.filter(cigar, lambda c: (c["op"] != "N") & (c["len"] > 0))
    return F.aggregate(kept, F.array().cast("array<struct<op:string,len:int>>"), step)


def _op_like(out: Column, c: Column) -> Column:
    return F.struct(c["op"].alias("op"), (F.element_at(out, -1)["len"] + c["len"]).alias("len"))


def stretches(cigar: Column, start: Column) -> Column:
    """[(start, end)]: what a parsed CIGAR covers between introns."""
    step = lambda s, c: F.struct(
        F.when(c["op"].isin("M", "D", "N", "=", "X"), s["at"] + c["len"]).otherwise(s["at"]).alias("at"),
        F.when(c["op"] == "N", s["at"] + c["len"]).otherwise(s["begin"]).alias("begin"),
        F.when(c["op"] == "N", F.concat(s["out"], F.array(F.struct(s["begin"].alias("start"), s["at"].alias("end"))))).otherwise(s["out"]).alias("out"),
    )
    first = F.struct(start.cast("long").alias("at"), start.cast("long").alias("begin"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    return F.aggregate(cigar, first, step, lambda s: F.concat(s["out"], F.array(F.struct(s["begin"].alias("start"), s["at"].alias("end")))))


def clip_sizes(cigar: Column) -> tuple[Column, Column]:
    """Soft-clipped bases at either end of a parsed CIGAR."""
    size = lambda c: F.when(c["op"] == "S", c["len"]).otherwise(0)
    return size(F.element_at(cigar, 1)), F.when(F.size(cigar) > 1, size(F.element_at(cigar, -1))).otherwise(0)


def _differing(a: Column, b: Column) -> Column:
    """Places where two texts of one length have different bases, N agreeing with all."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.size(F.filter(pairs, lambda p: (p["x"] != p["y"]) & p["x"].isin("A", "C", "G", "T") & p["y"].isin("A", "C", "G", "T")))


def extended(aln: DataFrame, parts: DataFrame, *, most: int = 10, share: float = 0.3, tile: int = TILE) -> DataFrame:
    """Alignments with their clipped ends laid on the genome, if the mismatches stay within both limits.

    ``aln`` has chr, start, end, cigar (parsed), n_mismatch and seq as it lies
    on the forward strand; ``parts`` are the genome's tiles.  An end without
    genome below it drops the alignment, as no exon can hold it.
    """
    left, right = clip_sizes(F.col("cigar"))
    rows = aln.withColumns({"_l": left, "_r": right, "_n": F.length("seq")})
    rows = rows.withColumns({"_a": F.col("start") - F.col("_l"), "_b": F.col("end")}).filter("_a >= 0")
    for at, n, name in (("_a", "_l", "_ga"), ("_b", "_r", "_gb")):
        part = parts.select("chr", F.col("tile").alias("_tile"), F.col("bases").alias("_bases"))
        rows = rows.withColumn("_tile", F.floor(F.col(at) / tile)).join(part, ["chr", "_tile"], "left")
        rows = rows.withColumn(name, F.coalesce(F.substring("_bases", (F.col(at) - F.col("_tile") * tile + 1).cast("int"), F.col(n)), F.lit(""))).drop("_tile", "_bases")
    rows = rows.filter((F.length("_ga") == F.col("_l")) & (F.length("_gb") == F.col("_r")))
    wrong = F.when(F.col("_l") > 0, _differing(F.substring("seq", F.lit(1), F.col("_l")), F.col("_ga"))).otherwise(0)
    wrong = wrong + F.when(F.col("_r") > 0, _differing(F.substring(F.col("seq"), F.col("_n") - F.col("_r") + 1, F.col("_r")), F.col("_gb"))).otherwise(0)
    rows = rows.withColumn("n_mismatch", F.col("n_mismatch") + wrong)
    rows = rows.filter(F.col("n_mismatch") <= F.least(F.lit(most), F.floor(share * (F.col("_n") - 1))))
    cigar = merged_keeping_introns(F.transform("cigar", lambda c: F.struct(F.when(c["op"] == "S", "M").otherwise(c["op"]).alias("op"), c["len"].alias("len"))))
    return rows.withColumns({"cigar": cigar, "start": F.col("_a"), "end": F.col("end") + F.col("_r")}).drop("_l", "_r", "_n", "_a", "_b", "_ga", "_gb")


def merged_keeping_introns(cigar: Column) -> Column:
    step = lambda out, c: F.when((F.size(out) > 0) & (F.element_at(out, -1)["op"] == c["op"]),
                                 F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(_op_like(out, c)))).otherwise(F.concat(out, F.array(c)))
    return F.aggregate(F.filter(cigar, lambda c: c["len"] > 0), F.array().cast("array<struct<op:string,len:int>>"), step)


def projected(aln: DataFrame, exons: DataFrame, *, mode: str = "ban_indels_extend", parts: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """One row for each alignment and transcript whose exons it follows.

    ``aln`` is (aln_id, read_id, chr, start, end, cigar as text, is_reverse,
    n_mismatch, ...); modes that lay clipped ends on the genome also need seq
    (forward strand) and the genome's tiles.  ``exons`` is (transcript, chr,
    start, end, strand).  Deletions and insertions lie within one exon, introns
    between two that follow each other.

    Columns: aln_id, read_id, transcript, t_start (0-based), cigar (text, as
    the transcript reads), is_reverse (against the transcript), n_mismatch.  An
    alignment without exons that fit gives no row.
    """
    rows = projectable(aln.withColumn("cigar", S.parse_cigar(F.col("cigar"))), mode)
    if not PROJECTIONS[mode][1] and parts is not None:
        clipped = F.exists("cigar", lambda c: c["op"] == "S")
        rows = rows.filter(~clipped).unionByName(extended(rows.filter(clipped), parts, tile=tile))
    # an alignment meets the exons that hold its first stretch, each of which brings all of its transcript's exons
    per = Window.partitionBy("transcript")
    model = with_offsets(exons.select("transcript", "chr", "start", "end", "strand"))
    model = model.withColumns({"strand": F.first("strand").over(per), "t_length": F.sum(F.col("end") - F.col("start")).over(per)})
    all_of = F.sort_array(F.collect_list(F.struct("exon_no", "start", "end", "offset")).over(Window.partitionBy("transcript", "chr")))
    model = model.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "transcript", "exon_no", "strand", "t_length", all_of.alias("_exons"))
    slim = rows.withColumn("_first", stretches(F.col("cigar"), F.col("start"))[0])
    slim = slim.select("aln_id", "read_id", "chr", "start", F.col("_first.end").alias("end"), cigar_text(F.col("cigar")).alias("_text"), "is_reverse", "n_mismatch")
    # an array of one, exploded, is made once a row; an alias would be put into each of its uses
    once = lambda value: F.explode(F.array(value))
    both = contain_join(slim, model).withColumn("cigar", once(S.parse_cigar(F.col("_text"))))
    both = both.withColumn("_blocks", once(stretches(F.col("cigar"), F.col("start"))))
    both = both.withColumn("_n", once(F.size("_blocks")))
    n = F.col("_n")

    def holds(e: Column, b: Column, i: Column) -> Column:
        edges = ((i == 0) | (b["start"] == e["start"])) & ((i == n - 1) | (b["end"] == e["end"]))
        return (e["start"] <= b["start"]) & (e["end"] >= b["end"]) & edges

    inside = lambda e, at: e["offset"] + at - e["start"]
    hit = lambda b, i: F.transform(F.filter("_exons", lambda e: holds(e, b, i)), lambda e: F.struct(
        e["exon_no"].alias("no"), inside(e, b["start"]).alias("a"), inside(e, b["end"]).alias("b")))
    both = both.withColumn("_hits", once(F.transform("_blocks", hit)))
    both = both.filter(F.try_element_at(F.col("_hits")[0], F.lit(1))["no"] == F.col("exon_no")).withColumn("_hits", F.flatten("_hits"))
    of = lambda f: F.transform("_hits", lambda h: h[f])
    both = both.filter((F.size("_hits") == n) & (F.array_max(of("no")) - F.array_min(of("no")) + 1 == n))
    both = both.withColumns({"t_start": F.array_min(of("a")), "to_end": F.col("t_length") - F.array_max(of("b"))})
    turned = F.col("strand") == "-"
    cigar = merged(F.col("cigar"))
    return both.select("aln_id", "read_id", "transcript", F.when(turned, F.col("to_end")).otherwise(F.col("t_start")).alias("t_start"),
                       cigar_text(F.when(turned, F.reverse(cigar)).otherwise(cigar)).alias("cigar"), (F.col("is_reverse") != turned).alias("is_reverse"), "n_mismatch")


def primary_and_quality(rows: DataFrame, loci: DataFrame, order: list[str], *, unique: int = 255) -> DataFrame:
    """Adds n_hits, ``hit`` (1 is primary), mapq and flag to projected rows.

    The primary is drawn by a hash of the read's id among its hits in the given
    order; the quality is that of the larger of their number and the read's
    places ``n_loci`` (loci: read_id, n_loci).
    """
    read = Window.partitionBy("read_id")
    ranked = rows.withColumns({"n_hits": F.count(F.lit(1)).over(read), "_at": F.row_number().over(read.orderBy(*order)) - 1})
    ranked = ranked.withColumn("hit", F.pmod(F.col("_at") - F.pmod(F.xxhash64("read_id"), F.col("n_hits")), F.col("n_hits")) + 1).join(loci, "read_id")
    ranked = ranked.withColumn("mapq", S.mapping_quality(F.greatest("n_hits", "n_loci"), unique))
    return ranked.drop("_at", "n_loci")


def transcript_records(aln: DataFrame, exons: DataFrame, *, mode: str = "ban_indels_extend", parts: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Records of single reads in transcript coordinates: :func:`projected` with n_hits, hit, mapq and flag.

    ``aln`` has ``n_loci`` beside the columns that :func:`projected` needs.
    """
    loci = aln.groupBy("read_id").agg(F.max("n_loci").alias("n_loci"))
    rows = primary_and_quality(projected(aln, exons, mode=mode, parts=parts, tile=tile), loci, ["aln_id", "transcript"])
    return rows.withColumn("flag", flag(F.col("is_reverse"), F.col("hit")))


def transcript_pairs(aln: DataFrame, exons: DataFrame, *, mode: str = "ban_indels_extend", parts: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Records of pairs: both mates of an alignment on one transcript, two rows a hit.

    ``aln`` has pair_no and mate (1 or 2) beside the columns of single reads;
    aln_id tells all rows apart, the mates of a pair share read_id and pair_no.
    """
    at = projected(aln, exons, mode=mode, parts=parts, tile=tile).join(aln.select("aln_id", "pair_no", "mate"), "aln_id")
    mine = lambda m: at.filter(F.col("mate") == m).select("read_id", "pair_no", "transcript", *(F.col(c).alias(f"{c}{m}") for c in ("t_start", "cigar", "is_reverse", "n_mismatch")))
    both = mine(1).join(mine(2), ["read_id", "pair_no", "transcript"]).filter("is_reverse1 <> is_reverse2")
    loci = aln.groupBy("read_id").agg(F.max("n_loci").alias("n_loci"))
    both = primary_and_quality(both, loci, ["pair_no", "transcript"])
    mate = lambda m: F.struct(F.lit(m).alias("mate"), *(F.col(f"{c}{m}").alias(c) for c in ("t_start", "cigar", "is_reverse", "n_mismatch")), F.col(f"is_reverse{3 - m}").alias("mate_reverse"))
    rows = both.select("read_id", "pair_no", "transcript", "n_hits", "hit", "mapq", F.explode(F.array(mate(1), mate(2))).alias("m")).select("*", "m.*").drop("m")
    bits = flag(F.col("is_reverse"), F.col("hit"), paired=F.lit(True), proper=F.lit(True), mate_reverse=F.col("mate_reverse"), mate=F.col("mate"))
    return rows.withColumn("flag", bits).drop("mate_reverse")
