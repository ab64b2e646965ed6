"""Functions, readers and lines that no query runs, and counts over a stream."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import chimeric, filters, transcripts
from helixframe.sinks import text as sinks
from helixframe.sources import text as sources
from helixframe.streaming import counts


def test_packed_bases_and_span_cost(spark):
    words = ["ACGT", "TTTT", "AAAA", "ACGA", "ACTT"]
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("c", S.pack_bases(F.col("w"), 4))
    assert [r.b for r in df.select(S.unpack_bases(F.col("c"), 4).alias("b")).collect()] == words
    pairs = df.alias("a").crossJoin(df.alias("b")).select("a.w", F.col("b.w").alias("v"), S.one_apart(F.col("a.c"), F.col("b.c")).alias("one"))
    assert all(r.one == (sum(x != y for x, y in zip(r.w, r.v)) == 1) for r in pairs.collect())
    spans = spark.createDataFrame([(n,) for n in (1, 100, 5000)], "n long")
    assert [r.p for r in spans.select(S.span_penalty(F.col("n")).alias("p")).collect()] == [math.ceil(math.log2(n) * -0.25 - 0.5) for n in (1, 100, 5000)]


def test_heterozygous_sites(spark, tmp_path):
    rows = ["#h", *("\t".join(x) for x in (("c1", "5", ".", "A", "G", ".", ".", ".", "GT", "0|1"), ("c1", "8", ".", "C", "G,T", ".", ".", ".", "GT", "1|2"), ("c1", "9", ".", "C", "G", ".", ".", ".", "GT", "1|1"),
                                           ("c1", "12", ".", "AC", "G", ".", ".", ".", "GT", "0|1"), ("c1", "13", ".", "A", "G")))]
    (tmp_path / "v").write_text("\n".join(rows))
    assert sorted(map(tuple, sources.het_snvs(spark, f"{tmp_path}/v").collect())) == [("c1", 4, "A", "A", "G"), ("c1", 7, "C", "G", "T")]


def test_junction_gene_and_chimeric_lines(spark):
    rows = [("c2", 9, 20, 1, 1, True, 2, 0, 30), ("c1", 50, 70, 2, 2, False, 0, 4, 11)]
    sj = spark.createDataFrame(rows, "chr string, start long, end long, strand int, motif int, annotated boolean, n_unique long, n_multi long, overhang int")
    assert [r.value for r in sinks.junction_lines(sj).collect()] == ["c1\t50\t70\t2\t2\t0\t0\t4\t11", "c2\t9\t20\t1\t1\t1\t2\t0\t30"]
    genes = spark.createDataFrame([("G2", 1, 0, 1), ("N_ambiguous", 5, 5, 5), ("N_unmapped", 7, 7, 7), ("G1", 3, 2, 1)], "feature string, any_strand long, same_strand long, other_strand long")
    assert [r.value.split("\t")[0] for r in sinks.gene_count_lines(genes).collect()] == ["N_unmapped", "N_ambiguous", "G1", "G2"]
    names = "donor_chr string, donor_pos long, donor_reverse boolean, acceptor_chr string, acceptor_pos long, acceptor_reverse boolean, type int, repeat_donor int, repeat_acceptor int, name string, donor_start long, donor_cigar string, acceptor_start long, acceptor_cigar string"
    pair = spark.createDataFrame([("c1", 5, True, "c2", 9, False, 1, 0, 2, "r", 10, "5M", 20, "6M")], names)
    assert chimeric.junction_lines(pair).first().value == "c1\t5\t-\tc2\t9\t+\t1\t0\t2\tr\t11\t5M\t21\t6M"


def test_best_partners_of_hand_made_segments(spark):
    kind = "read_id long, seg int, chr string, start long, end long, is_reverse boolean, read_start int, read_end int, read_len int, score int, plus boolean, minus boolean, other boolean"
    seg = lambda r, n, c, s, rs, re, score, rev=False, plus=False, minus=False, other=False: (r, n, c, s, s + re - rs, rev, rs, re, 100, score, plus, minus, other)
    rows = [
        seg(1, 0, "a", 100, 0, 60, 58), seg(1, 1, "b", 900, 60, 100, 39),
        seg(2, 0, "a", 100, 0, 60, 58), seg(2, 1, "b", 900, 60, 100, 39), seg(2, 2, "c", 50, 60, 100, 39),
        seg(3, 0, "a", 100, 0, 60, 58), seg(3, 1, "a", 900, 60, 100, 39),
        seg(4, 0, "a", 100, 0, 60, 58), seg(4, 1, "b", 900, 0, 40, 39, rev=True),
        seg(5, 0, "a", 100, 0, 60, 58), seg(5, 1, "b", 900, 50, 100, 49),
        seg(6, 0, "a", 100, 0, 60, 58), seg(6, 1, "b", 900, 60, 100, 39, other=True),
        seg(7, 0, "a", 100, 0, 60, 58, plus=True), seg(7, 1, "b", 900, 60, 100, 39, minus=True),
        seg(8, 0, "a", 100, 0, 85, 84), seg(8, 1, "b", 900, 85, 100, 15),
    ]
    got = {r.read_id: (r.donor.seg, r.acceptor.seg, r.overlap, r.score) for r in chimeric.best_partners(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (0, 1, 0, 97), 2: (0, 1, 0, 97), 4: (0, 1, 0, 97), 5: (0, 1, 10, 97)}
    typed = chimeric.best_partners(spark.createDataFrame(rows, kind)).withColumn("type", F.lit(0))
    assert typed.count() == chimeric.typed(typed).count() == 4


def test_first_reads_and_clusters(spark):
    reads = spark.createDataFrame([(0,), (1,), (2,)], "read_no long")
    assert filters.first_reads(reads, 2).count() == 2 and filters.first_reads(reads, -1).count() == 3
    hits = spark.createDataFrame([(1, "t"), (2, "u")], "cb_idx long, transcript string")
    assert [tuple(r) for r in transcripts.in_clusters(hits, spark.createDataFrame([(2, 7)], "cb_idx long, cluster int")).collect()] == [(2, "u", 7)]


def test_molecules_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    kind = "cb long, umi long, gene long"
    for i in range(3):
        spark.createDataFrame([(c, u, c + u) for c in range(3) for u in range(i + 2)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = counts.append_molecules(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("cb", "umi", "gene").agg(F.sum("reads").alias("reads"))
    want = spark.read.parquet(f"{tmp_path}/in").groupBy("cb", "umi", "gene").agg(F.count(F.lit(1)).alias("reads"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    running = counts.running_molecules(stream).writeStream.format("memory").queryName("running").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, want.collect()))
