"""Complete output sets: ordered files under one header, matrices of junctions and splice states, reports.

Every file is a folder of parts, range-sorted so that the parts in the order of
their names are the file.  Spark's committer moves a task's part only once, so
a task that runs twice does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.records import sam_lines
from helixframe.operators.storage import stored
from helixframe.sinks.text import FINAL_REPORT, matrix_files

RATE = {"unique_reads": "unique_share", "multi_reads": "multi_share", "many_reads": "many_share"}


def write_ordered(body: DataFrame, order: list[str], head: list[str], path: str, compression: str = "none") -> None:
    """Write column ``value`` of ``body`` below the lines of ``head``, sorted by the columns of ``order``; ``compression`` is a codec's name."""
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    lines = body.select(F.lit(1).alias("_at"), F.lit(0).alias("_n"), *keys, "value")
    top = body.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "_n int, value string").withColumn("_at", F.lit(0))
    whole = lines.unionByName(top, allowMissingColumns=True)
    whole.orderBy("_at", "_n", *(f"_k{i}" for i in range(len(order)))).select("value").write.text(path, compression=compression)


def sam_set(hits: DataFrame, chromosomes: DataFrame, path: str, *, sort: str = "coordinate", extra: tuple[str, ...] = (), compression: str = "none") -> None:
    """SAM text with its header: ``hits`` as ``records.sam_lines`` takes them, chromosomes (chr, chr_name, length).

    ``sort`` is ``coordinate`` (chromosome in the order of ``chr``, start, then
    read and hit) or ``unsorted`` (read and hit).  ``extra`` are further header
    lines.  The header is one line a chromosome, and these lines are broadcast
    to order the others.  ``compression`` is the codec of the parts.
    """
    if sort not in ("coordinate", "unsorted"):
        raise ValueError("sort must be coordinate or unsorted")
    rows = chromosomes.orderBy("chr").select("chr", "chr_name", "length").collect()
    names = [f"@SQ\tSN:{r.chr_name}\tLN:{r.length}" for r in rows]
    order = ["read_id", "hit"]
    if sort == "coordinate":
        kind = chromosomes.select("chr_name", F.col("chr").alias("_chr")).schema
        places = hits.sparkSession.createDataFrame([(r.chr_name, r.chr) for r in rows], kind)
        hits = hits.withColumn("_start", F.col("start")).join(F.broadcast(places), "chr_name")
        order = ["_chr", "_start", *order]
    lines = sam_lines(hits, keep=tuple(order[:-2])).withColumnRenamed("line", "value")
    write_ordered(lines, order, [f"@HD\tVN:1.4\tSO:{sort}", *names, *extra], path, compression)


def junction_set(matrix: DataFrame, junctions: DataFrame, barcodes: DataFrame, path: str) -> dict[str, int]:
    """The junction matrix (sj, cb_idx, value) with its barcodes and the nine columns of the junction table as features.

    ``junctions`` has sj (from 0) beside the columns of the junction table.
    """
    rows = junctions.select(F.col("sj").alias("gene_idx"), F.lit("").alias("gene"), F.lit("").alias("name"))
    n = matrix_files(matrix.select(F.col("sj").alias("gene_idx"), "cb_idx", "value"), rows, barcodes, path, features_file=False)
    cols = ["chr", "start", "end", "strand", "motif", F.col("annotated").cast("int"), "n_unique", "n_multi", "overhang"]
    value = F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in cols))
    write_ordered(junctions.select("sj", value.alias("value")), ["sj"], [], f"{path}/features.tsv")
    return n


def splice_state_set(matrix: DataFrame, features: DataFrame, barcodes: DataFrame, path: str) -> None:
    """Three matrices in one folder from (gene_idx, cb_idx, spliced, unspliced, ambiguous), with the lists once.

    Each matrix holds its cells of a count above 0.
    """
    matrix = stored(matrix)
    for state in ("spliced", "unspliced", "ambiguous"):
        one = matrix.select("gene_idx", "cb_idx", F.col(state).alias("value")).filter("value > 0")
        matrix_files(one, features, barcodes, path, name=f"{state}.mtx", features_file=state == "spliced", barcodes_file=state == "spliced")


def shared_set(matrix: DataFrame, features: DataFrame, barcodes: DataFrame, path: str, method: str) -> dict[str, int]:
    """``UniqueAndMult-<method>.mtx`` of (gene_idx, cb_idx, value): real values, five decimals at most."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", F.col("value").cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    rows = matrix.select("gene_idx", "cb_idx", short.alias("value"))
    return matrix_files(rows, features, barcodes, path, name=f"UniqueAndMult-{method}.mtx", features_file=False, barcodes_file=False)


def _fixed(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(value, F.lit(0.0)).cast("double"))


def alignment_counters(reads: DataFrame, junctions: DataFrame | None = None, most: int = 10) -> DataFrame:
    """One row of counters of reads (n_loci, read_len, reason, and of the best place mapped_len, n_mismatch, ins, ins_bases, dels, del_bases, chimeric).

    Reads of one locus add to the mapped bases and what is counted on them.
    ``junctions`` (motif, annotated) are the introns of these reads' places.
    """
    loci, one = F.col("n_loci"), F.col("n_loci") == 1
    n = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    on_one = lambda c: n(F.when(one, F.col(c)))
    row = reads.agg(
        F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum("read_len"), F.lit(0)).cast("long").alias("read_bases"), n(one).alias("unique_reads"),
        n((loci > 1) & (loci <= most)).alias("multi_reads"), n(loci > most).alias("many_reads"), on_one("mapped_len").alias("mapped_bases"),
        on_one("n_mismatch").alias("mismatches"), *(on_one(c).alias(c) for c in ("ins", "ins_bases", "dels", "del_bases")), n(F.col("chimeric")).alias("chimeric_reads"),
        *(n((loci == 0) & (F.col("reason") == r)).alias(f"unmapped_{r}") for r in ("too_many_mismatches", "too_short", "other")),
    )
    of = lambda *codes: n(F.col("motif").isin(*codes))
    if junctions is None:
        return row.withColumns({c: F.lit(0).cast("long") for c in ("splices", "annotated", "gtag", "gcag", "atac", "noncanonical")})
    cut = junctions.agg(F.count(F.lit(1)).alias("splices"), n(F.col("annotated")).alias("annotated"), of(1, 2).alias("gtag"), of(3, 4).alias("gcag"), of(5, 6).alias("atac"), of(0).alias("noncanonical"))
    return row.crossJoin(F.broadcast(cut))  # one row each


def report_lines(counters: DataFrame, times: dict[str, str] | None = None) -> DataFrame:
    """(at, value): the lines of the final report in their fixed layout from one row of :func:`alignment_counters`.

    ``times`` gives the texts of the first four lines, which a report of a
    repeatable run leaves out.
    """
    c = F.col
    part = lambda a, b, factor=1.0: F.when(c(b) > 0, factor * c(a) / c(b)).otherwise(0.0)
    share = lambda a: F.concat(_fixed(part(a, "reads", 100.0)), F.lit("%"))
    rate = lambda a: F.concat(_fixed(part(a, "mapped_bases", 100.0)), F.lit("%"))
    count = lambda a: c(a).cast("string")
    unmapped = [x for r in ("too_many_mismatches", "too_short", "other") for x in (
        (f"Number of reads unmapped: {r.replace('_', ' ')}", count(f"unmapped_{r}")), (f"% of reads unmapped: {r.replace('_', ' ')}", share(f"unmapped_{r}")))]
    rows: list[tuple[str, Column | None]] = [
        *((name, F.lit(text)) for name, text in (times or {}).items()), *([("", None)] if times else []),
        (FINAL_REPORT["reads"], count("reads")), (FINAL_REPORT["mean_length"], F.when(c("reads") > 0, F.floor(c("read_bases") / c("reads"))).otherwise(0).cast("string")),
        ("UNIQUE READS:", None), (FINAL_REPORT["unique_reads"], count("unique_reads")), (FINAL_REPORT["unique_share"], share("unique_reads")),
        (FINAL_REPORT["mean_mapped"], _fixed(part("mapped_bases", "unique_reads"))), (FINAL_REPORT["splices"], count("splices")),
        *((f"Number of splices: {name}", count(col)) for name, col in (("Annotated (sjdb)", "annotated"), ("GT/AG", "gtag"), ("GC/AG", "gcag"), ("AT/AC", "atac"), ("Non-canonical", "noncanonical"))),
        ("Mismatch rate per base, %", rate("mismatches")), ("Deletion rate per base", rate("del_bases")), ("Deletion average length", _fixed(part("del_bases", "dels"))),
        ("Insertion rate per base", rate("ins_bases")), ("Insertion average length", _fixed(part("ins_bases", "ins"))),
        ("MULTI-MAPPING READS:", None), (FINAL_REPORT["multi_reads"], count("multi_reads")), (FINAL_REPORT["multi_share"], share("multi_reads")),
        (FINAL_REPORT["many_reads"], count("many_reads")), (FINAL_REPORT["many_share"], share("many_reads")), ("UNMAPPED READS:", None), *unmapped,
        ("CHIMERIC READS:", None), ("Number of chimeric reads", count("chimeric_reads")), ("% of chimeric reads", share("chimeric_reads")),
    ]
    line = lambda name, value: F.lit(name.rjust(49) if name else "") if value is None else F.concat(F.lit(f"{name:>47} |\t"), value)
    return counters.select(F.posexplode(F.array(*(line(*r) for r in rows))).alias("at", "value"))


def summary_lines(cells: DataFrame, called: DataFrame, totals: DataFrame, genes_detected: DataFrame, feature: str = "Gene") -> DataFrame:
    """(at, value): the seventeen lines of a run's summary.

    ``cells`` is (cb, n_reads, n_umis, n_genes) of all barcodes, ``called``
    (cb), ``totals`` one row (reads, valid_barcodes, unique_reads, multi_reads,
    feature_reads), ``genes_detected`` one row (genes).  Means are rounded
    down, medians are the middle value or the mean of the two, rounded down.
    """
    inside = cells.join(called.select("cb"), "cb", "left_semi")
    middle = lambda c: F.coalesce(F.floor(F.percentile(c, 0.5)), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    over = inside.agg(F.count(F.lit(1)).alias("n"), *(total(f"n_{c}").alias(c) for c in ("reads", "umis", "genes")), *(middle(f"n_{c}").alias(f"mid_{c}") for c in ("reads", "umis", "genes")))
    every = cells.agg(total("n_reads").alias("all_reads"), total("n_umis").alias("all_umis"))
    row = totals.select(*(F.col(c).alias(f"t_{c}") for c in totals.columns)).crossJoin(F.broadcast(over)).crossJoin(F.broadcast(every)).crossJoin(F.broadcast(genes_detected))  # one row each
    c = F.col
    part = lambda a, b: _fixed(F.when(b > 0, a / b).otherwise(0.0), 6)
    share = lambda a: part(a, c("t_reads"))
    mean = lambda a: F.when(c("n") > 0, F.floor(c(a) / c("n"))).otherwise(0).cast("string")
    text = lambda a: c(a).cast("string")
    lines = {
        "Number of Reads": text("t_reads"), "Reads With Valid Barcodes": share(c("t_valid_barcodes")),
        "Sequencing Saturation": _fixed(F.when(c("all_reads") > 0, 1 - c("all_umis") / c("all_reads")).otherwise(0.0), 6),
        "Reads Mapped to Genome: Unique+Multiple": share(c("t_unique_reads") + c("t_multi_reads")), "Reads Mapped to Genome: Unique": share(c("t_unique_reads")),
        f"Reads Mapped to {feature}: Unique {feature}": share(c("t_feature_reads")), "Estimated Number of Cells": text("n"),
        f"Unique Reads in Cells Mapped to {feature}": text("reads"), "Fraction of Unique Reads in Cells": part(c("reads"), c("all_reads")),
        "Mean Reads per Cell": mean("reads"), "Median Reads per Cell": text("mid_reads"), "UMIs in Cells": text("umis"), "Mean UMI per Cell": mean("umis"),
        "Median UMI per Cell": text("mid_umis"), f"Mean {feature} per Cell": mean("genes"), f"Median {feature} per Cell": text("mid_genes"), f"Total {feature} Detected": text("genes_detected"),
    }
    return row.select(F.posexplode(F.array(*(F.concat(F.lit(f"{k},"), v) for k, v in lines.items()))).alias("at", "value"))


def cell_read_set(table: DataFrame, whitelist: DataFrame, path: str) -> None:
    """The twenty columns of ``cells.read_table`` as text: first the reads without a listed barcode, then barcodes by index."""
    numbers = [x for x in table.columns if x != "cb"]
    line = lambda name: F.concat_ws("\t", name, *(F.col(x).cast("string") for x in numbers)).alias("value")
    named = table.join(whitelist.select(F.col("cb_idx").alias("cb"), "cb_seq"), "cb").select("cb", line(F.col("cb_seq")))
    none = table.filter("cb is null").select(F.lit(-1).cast("long").alias("cb"), line(F.lit("CBnotInPasslist")))
    empty = table.sparkSession.createDataFrame([(-1, "\t".join(["CBnotInPasslist", *["0"] * len(numbers)]))], "cb long, value string")
    rest = none.unionByName(empty).groupBy("cb").agg(F.max("value").alias("value"))
    write_ordered(named.select(F.col("cb").cast("long").alias("cb"), "value").unionByName(rest), ["cb"], ["\t".join(["CB", *numbers])], path)
