"""Gene assignment of alignments by interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.intervals import contain_join, overlap_join
from helixframe.operators.molecules import collapsed

#: Counts of a library that follows the gene's strand, the opposite one, or either.
STRANDS = ("unstranded", "forward", "reverse")


def strand_fits(gene_reverse: Column, read_reverse: Column, strand: str) -> Column:
    if strand == "unstranded":
        return F.lit(True)
    return gene_reverse == read_reverse if strand == "forward" else gene_reverse != read_reverse


def overlapping_genes(aln: DataFrame, genes: DataFrame, width: int = 4096) -> DataFrame:
    """(read_id, gene, same): each gene with an interval that the read overlaps, once, and whether strands agree.

    ``aln`` is (read_id, chr, start, end, is_reverse), ``genes`` (chr, r_start, r_end, gene, gene_reverse).
    """
    pairs = overlap_join(aln, genes, width=width)
    return pairs.select("read_id", "gene", (F.col("gene_reverse") == F.col("is_reverse")).alias("same")).distinct()


def three_column_counts(aln: DataFrame, genes: DataFrame, width: int = 4096) -> DataFrame:
    """(feature, any_strand, same_strand, other_strand) of reads with one locus, plus the four N_ rows.

    ``aln`` has one row a read with ``n_loci`` (0: unmapped).  Each column
    assigns on its own: no gene, one gene, or several (ambiguous).
    """
    one = aln.filter("n_loci = 1")
    hits = overlapping_genes(one, genes, width).groupBy("read_id").agg(
        F.collect_set("gene").alias("any"), F.collect_set(F.when(F.col("same"), F.col("gene"))).alias("same"),
        F.collect_set(F.when(~F.col("same"), F.col("gene"))).alias("other"),
    )
    named = lambda c: (
        F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, "N_noFeature").when(F.size(c) == 1, F.element_at(c, 1).cast("string")).otherwise("N_ambiguous")
    )
    three = one.select("read_id").join(hits, "read_id", "left").select(*(named(c).alias(c) for c in ("any", "same", "other")))
    rest = aln.filter("n_loci <> 1").select(F.when(F.col("n_loci") == 0, "N_unmapped").otherwise("N_multimapping").alias("feature"))
    rest = rest.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).select("feature", *(F.col("n").alias(c) for c in ("any", "same", "other")))
    long = three.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("feature")) for c in ("any", "same", "other")))).alias("x"))
    count = lambda c: F.sum((F.col("x.c") == c).cast("long"))
    found = long.groupBy(F.col("x.feature").alias("feature")).agg(*(count(c).alias(c) for c in ("any", "same", "other")))
    return found.unionByName(rest).select(
        "feature", F.col("any").alias("any_strand"), F.col("same").alias("same_strand"), F.col("other").alias("other_strand")
    )


def concordant_genes(blocks: DataFrame, merged: DataFrame, width: int = 4096) -> DataFrame:
    """(read_id, gene): genes of which one merged exon holds each block of the read.

    ``blocks`` is (read_id, chr, start, end), ``merged`` (chr, r_start, r_end, gene, gene_reverse).
    """
    n = blocks.groupBy("read_id").agg(F.count_distinct("start", "end").alias("_n"))
    held = contain_join(blocks, merged, width=width).select("read_id", "gene", "gene_reverse", "start", "end").distinct()
    held = held.groupBy("read_id", "gene", "gene_reverse").agg(F.count(F.lit(1)).alias("_k"))
    return held.join(n, "read_id").filter("_k = _n").select("read_id", "gene", "gene_reverse")


def assign_single_blocks(reads: DataFrame, merged: DataFrame, strand: str = "unstranded", width: int = 4096) -> DataFrame:
    """(read_id, gene) of reads whose rows, each of one block, lie within exons of one gene alone on that strand.

    One join and one aggregation: reads without a gene, or with several, are
    left out rather than named.
    """
    held = contain_join(reads, merged, width=width).filter(strand_fits(F.col("gene_reverse"), F.col("is_reverse"), strand))
    sets = held.groupBy("read_id").agg(F.min("gene").alias("gene"), F.max("gene").alias("_last"))
    return sets.filter("gene = _last").select("read_id", "gene")


def assign(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, status, gene): ``gene`` only where exactly one is hit."""
    sets = hits.groupBy("read_id").agg(F.count_distinct("gene").alias("_n"), F.min("gene").alias("_g"))
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 0, "no_feature").when(n == 1, "gene").otherwise("ambiguous")
    return reads.select("read_id").distinct().join(sets, "read_id", "left").select("read_id", status.alias("status"), F.when(n == 1, F.col("_g")).alias("gene"))


def tags(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """(read_id, gx, gn): id and name of a read's one gene, ``-`` otherwise."""
    rows = assigned.join(names.select("gene", "name"), "gene", "left")
    return rows.select("read_id", F.coalesce(F.col("gene").cast("string"), F.lit("-")).alias("gx"), F.coalesce("name", F.lit("-")).alias("gn"))


def regions(aln: DataFrame, exons: DataFrame, bodies: DataFrame, width: int = 4096) -> DataFrame:
    """(read_id, region, antisense): exonic, intronic or intergenic by any overlap; antisense if only the other strand has a body."""
    ex = overlap_join(aln, exons, width=width).select("read_id", F.lit(True).alias("_exon")).distinct()
    body = overlap_join(aln, bodies, width=width).groupBy("read_id").agg(
        F.bool_or(F.col("gene_reverse") == F.col("is_reverse")).alias("_sense"), F.bool_or(F.col("gene_reverse") != F.col("is_reverse")).alias("_anti")
    )
    rows = aln.select("read_id").distinct().join(ex, "read_id", "left").join(body, "read_id", "left")
    region = F.when(F.col("_exon"), "exonic").when(F.col("_sense").isNotNull(), "intronic").otherwise("intergenic")
    return rows.select("read_id", region.alias("region"), F.coalesce(F.col("_anti") & ~F.col("_sense"), F.lit(False)).alias("antisense"))


def velocyto(records: DataFrame) -> DataFrame:
    """(cb, gene, spliced, unspliced, ambiguous): molecules by their strongest category.

    ``records`` is (cb, umi, gene, junctions, exonic): any junction makes a read
    spliced, one wholly in exons is ambiguous, the others unspliced; a molecule
    is unspliced before spliced before ambiguous.
    """
    weight = F.when(F.col("junctions") > 0, 2).when(F.col("exonic"), 1).otherwise(3)
    mols = records.groupBy("cb", "gene", "umi").agg(F.max(weight).alias("w"))
    n = lambda k: F.sum((F.col("w") == k).cast("long"))
    return mols.groupBy("cb", "gene").agg(n(2).alias("spliced"), n(3).alias("unspliced"), n(1).alias("ambiguous"))


def splice_states(records: DataFrame, size: int, *, method: str = "exact", keep_ambiguous: bool = True) -> DataFrame:
    """(cb, gene, spliced, unspliced, ambiguous): as :func:`velocyto`, with tags of ``size`` bases collapsed within each category.

    A molecule's category is settled first, by the strongest of its reads;
    ``method`` then collapses the tags of one category, with all of a
    molecule's reads.  Without ``keep_ambiguous`` ambiguous molecules count as
    spliced before tags are collapsed.
    """
    state = F.when(F.col("junctions") > 0, 1).when(F.col("exonic"), 0).otherwise(2)
    mols = records.groupBy("cb", "gene", "umi").agg(F.max(state).alias("s"), F.count(F.lit(1)).alias("reads"))
    kind = F.col("s") if keep_ambiguous else F.greatest("s", F.lit(1))
    counts = collapsed(mols.select("cb", (F.col("gene") * 3 + kind).cast("long").alias("gene"), "umi", "reads"), size, method)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("gene") % 3 == k, F.col("value"))), F.lit(0)).cast("long")
    return counts.groupBy("cb", F.floor(F.col("gene") / 3).alias("gene")).agg(of(1).alias("spliced"), of(2).alias("unspliced"), of(0).alias("ambiguous"))


def gene_spans(exons: DataFrame) -> DataFrame:
    """(gene, chr, start, end) over a gene's exons."""
    return exons.groupBy("gene", "chr").agg(F.min("start").alias("start"), F.max("end").alias("end"))
