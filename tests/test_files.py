"""Readers and writers of this round on small files, and the run's output folders."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import cells, models
from helixframe.plans import solo
from helixframe.sinks import text as sinks
from helixframe.sources import text as sources


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_variants_haploid_and_diploid(spark, tmp_path):
    rows = ["#head", "c1\t5\t.\tAC\tG,T\t.\t.\t.\tGT\t2|1:9", "c1\t0\t.\tA\tG\t.\t.\t.\tGT\t1|1", "c2\t7\t.\tA\tGG\t.\t.\t.\tGT\t0|1", "c2\t9\t.\tA\tC\t.\t.\t.\tGT\t.|1", "c2\tx\t.\tA\tC", "c3\t3\t.\tA\tC"]
    (tmp_path / "v.vcf").write_text("\n".join(rows) + "\n")
    read = lambda h: sorted(map(tuple, sources.variants(spark, str(tmp_path / "v.vcf"), h).collect()))
    assert read(None) == [("c1", 4, 2, "G"), ("c2", 6, 1, "GG"), ("c2", 8, 1, "C"), ("c3", 2, 1, "C")]
    assert read(0) == [("c1", 4, 2, "T")]
    assert read(1) == [("c1", 4, 2, "G"), ("c2", 6, 1, "GG"), ("c2", 8, 1, "C")]


def test_barcode_list_and_clusters(spark, tmp_path):
    (tmp_path / "w.txt").write_text("CCGT\nAAGT x\nCCGT\n\n")
    listed = sources.whitelist(spark, str(tmp_path / "w.txt"))
    assert sorted(map(tuple, listed.collect())) == [("AAGT", 0), ("CCGT", 1)]
    (tmp_path / "c.txt").write_text("AAGT 4\nTTTT 1\nCCGT x\nAAGT\t5\n")
    assert [tuple(r) for r in sources.clusters(spark, str(tmp_path / "c.txt"), listed).collect()] == [(0, 5)]
    for bad in ("AAGT\nAAG\n", "AANT\n", "A" * 33 + "\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(ValueError):
            sources.whitelist(spark, str(tmp_path / "bad.txt"))


def test_reads_of_several_files_go_in_step(spark, tmp_path):
    for kind, at in (("r", 0), ("b", 4)):
        for part in (1, 2):
            text = "".join(f"@x{part}{i}/1\n{'ACGT' * 4}{'ACGTACGTA'[i + part : i + part + 5] * 2}\n+\n{'I' * 26}\n" for i in range(2))
            (tmp_path / f"{kind}{part}.fq").write_text(text + "@short/1\nAC\n+\nII\n" * (part == 2))
    reads = sources.cell_reads(spark, f"{tmp_path}/r*.fq", f"{tmp_path}/b*.fq").collect()
    got = {(r.file_no, r.read_no): (r.name, r.cb, r.umi) for r in reads}
    assert got[0, 1] == ("x11", "ACGT" * 4, "GTACG" * 2) and got[1, 0] == ("x20", "ACGT" * 4, "GTACG" * 2)
    assert got[1, 2] == ("short", None, None) and len(got) == 5
    five = sources.cell_reads_five(spark, f"{tmp_path}/b*.fq", f"{tmp_path}/r*.fq").collect()
    assert all(r.seq2 == r.seq and (r.cb is None) == (r.name == "short") for r in five)


def test_clips_positions_and_shifts(spark):
    rows = [("10M", 2, 3, False, "2S10M3S"), ("10M", 2, 3, True, "3S10M2S"), ("1S9M4S", 2, 0, False, "3S9M4S"), ("5M3N5M", 0, 0, False, "5M3N5M"), ("2S8M", 0, 1, True, "3S8M")]
    df = spark.createDataFrame(rows, "c string, five int, three int, rev boolean, want string")
    assert all(r.got == r.want for r in df.select("want", S.with_clips(F.col("c"), F.col("five"), F.col("three"), F.col("rev")).alias("got")).collect())
    at = df.select("want", S.unclipped_start(F.lit(100), S.parse_cigar(F.col("want"))).alias("at")).collect()
    assert [r.at for r in at] == [98, 97, 97, 100, 97]
    for bad in ("0_1_0", "1_0_0_3", "0_3_0_1", "a_0_0_1"):
        with pytest.raises(ValueError):
            S.parse_position(bad)
    assert S.parse_position("0_6_0_9") == (6, 4)
    pairs = spark.createDataFrame([("ACGT", "TTGT", 2), ("ACGN", "ACGN", 0), ("", "A", 0), ("AAA", "CAAA", 3)], "a string, b string, n int")
    assert all(r.got == r.n for r in pairs.select("n", models.shift_left(F.col("a"), F.col("b")).alias("got")).collect())


def test_run_folders_and_a_second_filter(spark, tmp_path):
    whitelist = spark.createDataFrame([("AAAA", 0), ("CCCC", 1), ("GGGG", 2)], "cb_seq string, cb_idx long")
    features = spark.createDataFrame([(0, "G1", "one"), (1, "G2", "two")], "gene_idx long, gene string, name string")
    counts = spark.createDataFrame([(0, 0, 40), (0, 1, 10), (2, 1, 30), (1, 0, 1)], "cb long, gene long, value long")
    mols = spark.createDataFrame([(c, u, g, 2) for c, g, n in ((0, 0, 40), (0, 1, 10), (2, 1, 30), (1, 0, 1)) for u in range(n)], "cb long, umi long, gene long, reads long")
    some = lambda n: spark.range(n).withColumnRenamed("id", "read_id")
    places = some(150).withColumn("n_loci", F.when(F.col("read_id") < 120, 1).otherwise(3))
    genes = some(110).withColumn("status", F.when(F.col("read_id") < 100, "gene").otherwise("none"))
    run = solo.Run(some(200), places, some(160), genes, mols, counts, features, whitelist)
    solo.write_run(run, f"{tmp_path}/out", spark.createDataFrame([(0,), (2,)], "cb long"))
    assert lines(spark, f"{tmp_path}/out/raw/matrix.mtx") == ["%%MatrixMarket matrix coordinate integer general", "%", "2 3 4", "1 1 40", "2 1 10", "1 2 1", "2 3 30"]
    assert lines(spark, f"{tmp_path}/out/raw/features.tsv") == ["G1\tone\tGene Expression", "G2\ttwo\tGene Expression"]
    assert lines(spark, f"{tmp_path}/out/raw/barcodes.tsv") == ["AAAA", "CCCC", "GGGG"]
    assert lines(spark, f"{tmp_path}/out/filtered/matrix.mtx")[2:] == ["2 2 3", "1 1 40", "2 1 10", "2 2 30"]
    assert lines(spark, f"{tmp_path}/out/filtered/barcodes.tsv") == ["AAAA", "GGGG"]
    summary = dict(x.split(",") for x in lines(spark, f"{tmp_path}/out/Summary.csv"))
    assert len(summary) == 17 and summary["Estimated Number of Cells"] == "2" and summary["UMIs in Cells"] == "80" and summary["Sequencing Saturation"] == "0.500000"
    assert summary["Number of Reads"] == "200" and summary["Reads With Valid Barcodes"] == "0.800000" and summary["Reads Mapped to Genome: Unique+Multiple"] == "0.750000"
    assert summary["Reads Mapped to Genome: Unique"] == "0.600000" and summary["Reads Mapped to Gene: Unique Gene"] == "0.500000"
    assert summary["Fraction of Unique Reads in Cells"] == "0.987654" and summary["Median UMI per Cell"] == "40" and summary["Total Gene Detected"] == "2"
    assert lines(spark, f"{tmp_path}/out/CellReads.stats") == ["cb_seq\tn_reads\tn_umis\tn_genes", "AAAA\t100\t50\t2", "CCCC\t2\t1\t1", "GGGG\t60\t30\t1"]
    called = lambda m: cells.top_cells(m.groupBy("cb").agg(F.sum("value").alias("n_umis")), 1)
    solo.filter_matrix(spark, f"{tmp_path}/out/raw", f"{tmp_path}/again", called)
    assert lines(spark, f"{tmp_path}/again/matrix.mtx")[2:] == ["2 1 2", "1 1 40", "2 1 10"]
    assert lines(spark, f"{tmp_path}/again/barcodes.tsv") == ["AAAA"]


def test_report_and_unmapped_reads(spark):
    reads = spark.createDataFrame([(1, 50, 48, 1), (1, 50, 50, 0), (0, 50, 0, 0), (12, 50, 0, 0)], "n_loci int, read_len int, mapped_len int, n_junction int")
    report = [r.value for r in sinks.key_value_lines(sinks.final_metrics(reads), sinks.FINAL_REPORT, "\t").collect()]
    assert report[:4] == ["Number of input reads\t4", "Average input read length\t50", "Uniquely mapped reads number\t2", "Uniquely mapped reads %\t50.0"]
    assert report[-1] == "% of reads unmapped\t25.0"
    rows = spark.createDataFrame([(0, "a", "AC", "II"), (1, "b", "GT", "II")], "read_no long, name string, seq string, qual string")
    gone = sinks.unmapped_lines(rows, spark.createDataFrame([(0,)], "read_no long"), 1).collect()
    assert [r.value for r in gone] == ["@b 1:N:\nGT\n+\nII"]


def test_genome_transform_and_blocks(spark):
    from helixframe.operators import alignments

    seq = "ACGTACGTACGTACGTACGT"
    rows = [("c1", 2, 1, "T"), ("c1", 5, 2, "A"), ("c1", 6, 1, "CCC"), ("c1", 10, 1, "GGG"), ("c1", 10, 1, "TTT")]
    variants = alignments.substitute_variants(spark.createDataFrame(rows, "chr string, pos long, ref_len int, alt string"))
    assert sorted(map(tuple, variants.collect())) == [("c1", 2, 1, "T"), ("c1", 5, 2, "A"), ("c1", 10, 1, "GGG")]
    both = spark.createDataFrame([("c1", seq), ("c2", "AAAA")], "chr string, seq string")
    new = {r.chr: r.seq for r in alignments.transformed(both, variants, "_h1").collect()}
    assert new == {"c1_h1": seq[:2] + "T" + seq[3:5] + "A" + seq[7:10] + "GGG" + seq[11:], "c2_h1": "AAAA"}
    blocks = alignments.transform_blocks(both.select("chr", F.length("seq").cast("long").alias("length")), variants)
    assert sorted(map(tuple, blocks.collect())) == [("c1", 0, 0, 6), ("c1", 7, 6, 4), ("c1", 11, 12, 9), ("c2", 0, 0, 4)]
    assert [r.value for r in sinks.block_lines(blocks).collect()] == ["4\t-1", "0\t6\t0", "6\t4\t7", "12\t9\t11", "0\t4\t0"]


def test_projection_modes(spark):
    from helixframe.operators import filters

    rows = spark.createDataFrame([(1, "10M", True), (2, "5M1I5M", True), (3, "3M9N7M", False)], "i int, c string, both boolean").withColumn("cigar", S.parse_cigar(F.col("c")))
    ids = lambda *a, **k: sorted(r.i for r in filters.projectable(rows, *a, **k).collect())
    assert ids() == [1, 3] and ids("keep") == [1, 2, 3] and ids("extend", paired=True) == [1, 2] and ids(paired=True) == [1]


def test_ambiguous_bases_as_mismatches(spark):
    df = spark.createDataFrame([("ACGTAGNTC", 4, 9)], "s string, plain int, strict int")
    row = df.select("*", S.adapter_offset(F.col("s"), "AGATC", 0.3).alias("a"), S.adapter_offset(F.col("s"), "AGATC", 0.2, True).alias("b")).first()
    assert (row.a, row.b) == (row.plain, row.strict)


def test_variants_are_kept_without_a_call_a_group(spark):
    import random

    from helixframe.operators import alignments

    r = random.Random(3)
    rows = sorted({(f"c{r.randrange(3)}", r.randrange(4000), r.choice("ACGT")): r.randint(1, 4) for _ in range(2500)}.items())
    rows = [(c, pos, size, alt) for (c, pos, alt), size in rows]
    kept, end = [], {}
    for c, pos, size, alt in sorted(rows, key=lambda x: (x[0], x[1], x[3])):
        if pos >= end.get(c, -1):
            end[c] = pos + size
            kept.append((c, pos, size, alt))
    found = alignments.substitute_variants(spark.createDataFrame(rows, "chr string, pos long, ref_len int, alt string").repartition(5))
    assert sorted(map(tuple, found.collect())) == kept
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
