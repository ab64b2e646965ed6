"""Output tables as text lines; write them with ``df.write.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def junction_lines(rows: DataFrame) -> DataFrame:
    """Nine tab-separated columns, in order of position."""
    ordered = rows.orderBy("chr", "start", "end", "strand", "motif")
    cols = ["chr", "start", "end", "strand", "motif", F.col("annotated").cast("int"), "n_unique", "n_multi", "overhang"]
    return ordered.select(F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)).alias("value"))


def gene_count_lines(counts: DataFrame) -> DataFrame:
    """The N_ rows first, then the genes."""
    first = F.element_at(F.create_map(*(x for i, n in enumerate(("N_unmapped", "N_multimapping", "N_noFeature", "N_ambiguous")) for x in (F.lit(n), F.lit(i)))), F.col("feature"))
    return counts.orderBy(F.coalesce(first, F.lit(4)), "feature").select(
        F.concat_ws("\t", "feature", *(F.col(c).cast("string") for c in ("any_strand", "same_strand", "other_strand"))).alias("value")
    )


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """1-based coordinates, by cell and then gene (body of a MatrixMarket file)."""
    return matrix.orderBy("cb_idx", "gene_idx").select(
        F.concat_ws(" ", (F.col("gene_idx") + 1).cast("string"), (F.col("cb_idx") + 1).cast("string"), F.col("value").cast("string")).alias("value")
    )


def bedgraph_lines(runs: DataFrame, per: float | None = None) -> DataFrame:
    """Lines of runs (chr, start, end, value): six significant digits, or five decimals of ``value * per``."""
    v = F.col("value").cast("double")
    short = F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6g", v), r"0+$", ""))
    value = short if per is None else F.format_string("%.5f", v * per)
    return runs.orderBy("chr", "start").select(F.concat_ws("\t", "chr", "start", "end", value).alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    """Records of four lines each, as one row."""
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def matrix_files(matrix: DataFrame, features: DataFrame, barcodes: DataFrame, path: str, *, name: str = "matrix.mtx", features_file: bool = True,
                 barcodes_file: bool = True) -> dict[str, int]:
    """Write the matrix ``name``, ``features.tsv`` and ``barcodes.tsv`` as folders below ``path``; returns the dimensions.

    ``matrix`` is (gene_idx, cb_idx, value), ``features`` (gene_idx, gene, name),
    ``barcodes`` (cb_idx, cb_seq); the lists are written whole, in order of index.
    """
    n = {"features": features.count(), "barcodes": barcodes.count(), "entries": matrix.count()}
    kind = "integer" if dict(matrix.dtypes)["value"] in ("int", "bigint") else "real"
    head = [f"%%MatrixMarket matrix coordinate {kind} general", "%", f"{n['features']} {n['barcodes']} {n['entries']}"]
    spark = matrix.sparkSession
    lines = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "at long, value string")
    body = matrix.select(
        "cb_idx", "gene_idx", F.concat_ws(" ", (F.col("gene_idx") + 1).cast("string"), (F.col("cb_idx") + 1).cast("string"), F.col("value").cast("string")).alias("value")
    )
    whole = lines.select(F.col("at").alias("cb_idx"), F.lit(-1).cast("long").alias("gene_idx"), "value").unionByName(body)
    whole.orderBy("cb_idx", "gene_idx").select("value").write.text(f"{path}/{name}")
    kinds = features.orderBy("gene_idx").select(F.concat_ws("\t", "gene", "name", F.lit("Gene Expression")).alias("value"))
    if features_file:
        kinds.write.text(f"{path}/features.tsv")
    if barcodes_file:
        barcodes.orderBy("cb_idx").select(F.col("cb_seq").alias("value")).write.text(f"{path}/barcodes.tsv")
    return n


def key_value_lines(row: DataFrame, names: dict[str, str], separator: str = ",") -> DataFrame:
    """One line (name, value) for each column of a table of one row, in the order of ``names``."""
    items = F.array(*(F.concat(F.lit(label + separator), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c, label in names.items()))
    return row.select(F.posexplode(items).alias("at", "value")).orderBy("at").select("value")


def table_lines(rows: DataFrame, columns: list[str], order: list[str], header: bool = True) -> DataFrame:
    """Tab-separated lines of some columns in an order, with a line of their names first."""
    body = rows.select(F.lit(1).alias("_at"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(order)), F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value"))
    if header:
        top = rows.sparkSession.createDataFrame([("\t".join(columns),)], "value string").withColumn("_at", F.lit(0))
        body = body.unionByName(top, allowMissingColumns=True)
    return body.orderBy("_at", *(f"_k{i}" for i in range(len(order)))).select("value")


#: Lines of the final report and the columns they show.
FINAL_REPORT = {
    "reads": "Number of input reads", "mean_length": "Average input read length", "unique_reads": "Uniquely mapped reads number",
    "unique_share": "Uniquely mapped reads %", "mean_mapped": "Average mapped length", "splices": "Number of splices: Total",
    "multi_reads": "Number of reads mapped to multiple loci", "multi_share": "% of reads mapped to multiple loci",
    "many_reads": "Number of reads mapped to too many loci", "many_share": "% of reads mapped to too many loci",
    "unmapped": "Number of reads unmapped", "unmapped_share": "% of reads unmapped",
}


def final_metrics(reads: DataFrame, most: int = 10) -> DataFrame:
    """One row of the final report of reads (n_loci, read_len, mapped_len, n_junction), shares in percent of two decimals.

    Mapped length and splices are those of reads with one locus.
    """
    loci, one = F.col("n_loci"), F.col("n_loci") == 1
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    row = reads.agg(
        F.count(F.lit(1)).alias("reads"), F.floor(F.avg("read_len")).alias("mean_length"), n(one).alias("unique_reads"),
        F.round(F.avg(F.when(one, F.col("mapped_len"))), 2).alias("mean_mapped"), n(F.when(one, F.col("n_junction"))).alias("splices"),
        n((loci > 1) & (loci <= most)).alias("multi_reads"), n(loci > most).alias("many_reads"), n(loci == 0).alias("unmapped"),
    )
    share = lambda c: F.when(F.col("reads") > 0, F.round(100 * F.col(c) / F.col("reads"), 2)).otherwise(0.0)
    return row.withColumns({f"{c.removesuffix('_reads')}_share": share(c) for c in ("unique_reads", "multi_reads", "many_reads", "unmapped")})


def unmapped_lines(reads: DataFrame, mapped: DataFrame, mate: int | None = None) -> DataFrame:
    """FASTQ records of reads that are not among ``mapped`` (read_no); their names tell the mate, if there is one."""
    rest = reads.join(mapped.select("read_no").distinct(), "read_no", "left_anti")
    name = F.col("name") if mate is None else F.concat("name", F.lit(f" {mate}:N:"))
    return fastq_lines(rest.withColumn("name", name))


def block_lines(blocks: DataFrame) -> DataFrame:
    """The number of blocks, then new start, length and old start of each (chr, old_start, new_start, len)."""
    body = blocks.select(F.lit(1).alias("_at"), "chr", "old_start", F.concat_ws("\t", *(F.col(c).cast("string") for c in ("new_start", "len", "old_start"))).alias("value"))
    head = blocks.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("_at"), F.concat(F.col("n").cast("string"), F.lit("\t-1")).alias("value"))
    return body.unionByName(head, allowMissingColumns=True).orderBy("_at", "chr", "old_start").select("value")
