"""Output sets: headers, order, matrices, per-barcode table."""

from __future__ import annotations

import pytest

from helixframe.sinks import sets


def lines(spark, path):
    return [r.value for r in spark.read.text(path).coalesce(1).collect()]


def parts(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*"))).splitlines()


def test_sam_has_one_header_and_the_order_asked_for(spark, tmp_path):
    rows = [(i, h, 2, 3, "c2" if i % 3 else "c1", (i * 37) % 100, i % 2 == 0, "5M", "ACGTA", "IIIII", 5, 0) for i in range(40) for h in (1, 2)]
    hits = spark.createDataFrame(rows, "read_id long, hit int, n_loci int, mapq int, chr_name string, start long, is_reverse boolean, cigar string, seq string, qual string, score int, n_mismatch int")
    names = spark.createDataFrame([(1, "c2", 500), (0, "c1", 900)], "chr int, chr_name string, length long")
    sets.sam_set(hits.repartition(7), names, f"{tmp_path}/a", extra=("@CO\tx",))
    got = parts(tmp_path / "a")
    assert got[:4] == ["@HD\tVN:1.4\tSO:coordinate", "@SQ\tSN:c1\tLN:900", "@SQ\tSN:c2\tLN:500", "@CO\tx"] and len(got) == 84
    place = [(f[2], int(f[3]), int(f[0])) for f in (x.split("\t") for x in got[4:])]
    assert place == sorted(place) and sum(x.startswith("@") for x in got) == 4
    sets.sam_set(hits, names, f"{tmp_path}/b", sort="unsorted")
    assert [x.split("\t")[0] for x in parts(tmp_path / "b")[3:]] == [str(i) for i in range(40) for _ in (1, 2)]
    with pytest.raises(ValueError):
        sets.sam_set(hits, names, f"{tmp_path}/c", sort="name")


def test_junction_splice_state_and_shared_matrices(spark, tmp_path):
    cells = spark.createDataFrame([("AA", 0), ("CC", 1)], "cb_seq string, cb_idx long")
    genes = spark.createDataFrame([(0, "G1", "one"), (1, "G2", "two")], "gene_idx long, gene string, name string")
    rows = [("c1", 5, 9, 1, 1, True, 3, 0, 12, 0), ("c1", 7, 30, 2, 2, False, 1, 2, 9, 1)]
    sj = spark.createDataFrame(rows, "chr string, start long, end long, strand int, motif int, annotated boolean, n_unique long, n_multi long, overhang int, sj long")
    assert sets.junction_set(spark.createDataFrame([(1, 0, 4)], "sj long, cb_idx long, value long"), sj, cells, f"{tmp_path}/sj") == {"features": 2, "barcodes": 2, "entries": 1}
    assert parts(tmp_path / "sj/matrix.mtx")[2:] == ["2 2 1", "2 1 4"]
    assert parts(tmp_path / "sj/features.tsv") == ["c1\t5\t9\t1\t1\t1\t3\t0\t12", "c1\t7\t30\t2\t2\t0\t1\t2\t9"]
    m = spark.createDataFrame([(0, 0, 2, 0, 1), (1, 1, 0, 3, 0)], "gene_idx long, cb_idx long, spliced long, unspliced long, ambiguous long")
    sets.splice_state_set(m, genes, cells, f"{tmp_path}/v")
    assert [parts(tmp_path / f"v/{s}.mtx")[2:] for s in ("spliced", "unspliced", "ambiguous")] == [["2 2 1", "1 1 2"], ["2 2 1", "2 2 3"], ["2 2 1", "1 1 1"]]
    assert parts(tmp_path / "v/features.tsv")[0] == "G1\tone\tGene Expression" and parts(tmp_path / "v/barcodes.tsv") == ["AA", "CC"]
    shared = spark.createDataFrame([(0, 0, 1.5), (1, 0, 2.0), (1, 1, 1 / 3)], "gene_idx long, cb_idx long, value double")
    sets.shared_set(shared, genes, cells, f"{tmp_path}/m", "EM")
    assert parts(tmp_path / "m/UniqueAndMult-EM.mtx") == ["%%MatrixMarket matrix coordinate real general", "%", "2 2 3", "1 1 1.5", "2 1 2", "2 2 0.33333"]


def test_barcode_table_begins_with_reads_without_a_barcode(spark, tmp_path):
    listed = spark.createDataFrame([("AA", 0), ("CC", 1), ("GG", 2)], "cb_seq string, cb_idx long")
    table = spark.createDataFrame([(2, 5, 4), (None, 7, 0), (0, 1, 1)], "cb long, cbMatch long, cbPerfect long")
    sets.cell_read_set(table, listed, f"{tmp_path}/t")
    assert parts(tmp_path / "t") == ["CB\tcbMatch\tcbPerfect", "CBnotInPasslist\t7\t0", "AA\t1\t1", "GG\t5\t4"]
    sets.cell_read_set(table.filter("cb = 0"), listed, f"{tmp_path}/u")
    assert parts(tmp_path / "u")[1:] == ["CBnotInPasslist\t0\t0", "AA\t1\t1"]


def test_reports_of_no_reads_are_zeros(spark):
    empty = spark.createDataFrame([], "n_loci int, read_len int, reason string, mapped_len int, n_mismatch int, ins int, ins_bases int, dels int, del_bases int, chimeric boolean")
    got = {r.at: r.value for r in sets.report_lines(sets.alignment_counters(empty), {"Started job on": "Nov 28 10:00:00"}).collect()}
    assert got[0] == f"{'Started job on':>47} |\tNov 28 10:00:00" and got[1] == "" and got[2].endswith("|\t0") and len(got) == 34
    assert got[4] == "UNIQUE READS:".rjust(49) and got[6].endswith("|\t0.00%")
