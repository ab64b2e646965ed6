"""Optional fields, duplicates and allele swaps against serial versions."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import alignments, duplicates, seeds, tags


def serial_md(cigar, read, ref):
    out, run, r, g = "", 0, 0, 0
    for n, op in cigar:
        if op == "M":
            for i in range(n):
                if read[r + i] == ref[g + i]:
                    run += 1
                else:
                    out, run = out + str(run) + ref[g + i], 0
            r, g = r + n, g + n
        elif op == "D":
            out, run, g = out + str(run) + "^" + ref[g : g + n], 0, g + n
        elif op == "N":
            g += n
        else:
            r += n
    return out + str(run)


def test_mismatch_text_equals_a_serial_version(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        cigar = [(rng.randint(1, 4), "S")] * rng.randint(0, 1) + [(rng.randint(1, 12), op) for op in rng.choice(["M", "MIM", "MDM", "MNM", "MDMIMNM"])]
        ref = "".join(rng.choice("ACGT") for _ in range(sum(n for n, op in cigar if op in "MDN")))
        read, g = "", 0
        for n, op in cigar:
            if op == "M":
                read += "".join(c if rng.random() < 0.8 else rng.choice("ACGTN") for c in ref[g : g + n])
            elif op in "SI":
                read += "".join(rng.choice("ACGT") for _ in range(n))
            g += n if op in "MDN" else 0
        rows.append((i, "".join(f"{n}{op}" for n, op in cigar), read, ref, serial_md(cigar, read, ref)))
    df = spark.createDataFrame(rows, "i int, cigar string, read string, ref string, want string")
    got = df.select("want", tags.mismatch_text(S.parse_cigar(F.col("cigar")), F.col("read"), F.col("ref")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def serial_duplicates(records):
    """Flags of records (record, name, chr, pos, mate_pos, flag, n_loci, score, unclip, cigar) by one sweep."""
    free, cluster, top, chrom = set(), [], 0, None

    def close(rows):
        by = {}
        for r in rows:
            by.setdefault(r[1], []).append(r)
        runs = {}
        for name, both in by.items():
            both.sort(key=lambda r: r[5] & 0x80)
            if len(both) == 2 and (both[0][5] & 0x80) != (both[1][5] & 0x80):
                a, b = both
                runs.setdefault((a[8], b[8], a[5], b[5], a[9], b[9]), []).append((-a[7], len(name), name, a[0], b[0]))
        for run in runs.values():
            free.update(min(run)[3:])

    for r in sorted(records, key=lambda r: (r[2], r[3], r[0])):
        if r[2] != chrom or (top and r[3] > top):
            close(cluster)
            cluster, top, chrom = [], 0, r[2]
        if r[6] == 1:
            cluster.append(r)
            if r[4] > r[3]:
                top = max(top, r[4])
    close(cluster)
    return {r[0]: r[6] == 1 and r[0] not in free for r in records}


def test_duplicates_equal_a_serial_sweep(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        pos, gap, chrom, n = rng.randrange(40) * 25, rng.choice([30, 40]), rng.randrange(2), rng.choice([1, 1, 1, 2])
        score, clip = rng.randrange(4), rng.choice([0, 0, 2])
        rows.append((2 * i, f"n{i}", chrom, pos, pos + gap, 99, n, score, pos - clip, "50M"))
        if rng.random() < 0.95:
            rows.append((2 * i + 1, f"n{i}", chrom, pos + gap, pos, 147, n, score, pos + gap, "50M"))
    kind = "record long, name string, chr int, pos long, mate_pos long, flag int, n_loci int, score int, unclip long, cigar string, seq string"
    df = spark.createDataFrame([(*r, "ACGT") for r in rows], kind)
    assert {r.record: r.duplicate for r in duplicates.marked(df, width=64).collect()} == serial_duplicates(rows)
    multi = {r.record: r.duplicate for r in duplicates.marked(df, mark_multi=True, mate2_bases=2, width=64).collect()}
    assert all(multi[r[0]] for r in rows if r[6] > 1)


def test_allele_swaps_are_aligned_again(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    # a second place that differs at one base, where the read's other allele sends it
    copy = base[500:580]
    swapped = copy[:40] + {"A": "C", "C": "G", "G": "T", "T": "A"}[copy[40]] + copy[41:]
    genome = spark.createDataFrame([("c1", base), ("c2", "".join(rng.choice("ACGT") for _ in range(400)) + swapped + "ACGTTGCA" * 20)], "chr string, seq string")
    reads = spark.createDataFrame([(1, 1, base[100:180]), (2, 1, copy), (3, 2, base[900:980]), (4, 1, base[1200:1280]), (5, 1, base[1500:1580])], "read_id long, n_loci int, seq string")
    other = lambda c: {"A": "C", "C": "G", "G": "T", "T": "A"}[c]
    sites = [(1, 10, base[110], other(base[110]), 1), (1, 50, base[150], other(base[150]), 1), (2, 40, copy[40], swapped[40], 1), (3, 5, "A", "C", 1), (4, 7, "A", "C", 4)]
    sites += [(5, i, "A", "C", 1) for i in range(11)]
    codes, swaps = alignments.allele_swaps(reads, spark.createDataFrame(sites, "read_id long, read_pos int, allele1 string, allele2 string, allele int"))
    made = {(r.read_id, r.combo): r.seq for r in swaps.collect()}
    assert set(made) == {(1, 1), (1, 2), (1, 3), (2, 1)}
    assert made[1, 2] == base[100:150] + other(base[150]) + base[151:180] and made[2, 1] == swapped
    place = lambda rows: seeds.best_places(seeds.align(rows, genome, tile=1000, reach=200)).withColumn("place", F.struct("chr", "start", "cigar"))
    numbered = swaps.withColumn("id", F.col("read_id") * 100 + F.col("combo"))
    again = place(numbered.select(F.col("id").alias("read_id"), "seq")).select(F.floor(F.col("read_id") / 100).alias("read_id"), (F.col("read_id") % 100).cast("int").alias("combo"), "place")
    out = alignments.allele_codes(place(reads.select("read_id", "seq")), codes, swaps, again).collect()
    assert {r.read_id: r.code for r in out} == {1: 1, 2: 6, 3: 2, 4: 3, 5: 7}


def test_optional_fields_in_the_order_asked_for(spark):
    from helixframe.functions import sequence as S
    from helixframe.operators import records, tags

    rows = [
        (1, 1, 2, 40, 1, "5M10N5M", 100, [1], [True], "ACGTAACGTA", "ACGTCNNNNNNNNNNACGTA", "g1", [1, 3], [103, 117], 1),
        (2, 1, 1, 10, 0, "10M", 5, [], [], "ACGTAACGTA", "ACGTAACGTA", None, [], [], None),
    ]
    cols = "read_id long, hit int, n_loci int, score int, n_mismatch int, cigar string, start long, motifs array<int>, annotated array<boolean>, aligned string, reference string, group string, alleles array<int>, places array<int>, wasp int"
    df = spark.createDataFrame(rows, cols).withColumn("parsed", S.parse_cigar(F.col("cigar")))
    names = ["NH", "HI", "AS", "nM", "NM", "XS", "jM", "jI", "MD", "RG", "vA", "vG", "vW"]
    got = [r.f.split("\t") for r in df.orderBy("read_id").select(tags.optional_fields(names).alias("f")).collect()]
    assert got[0] == ["NH:i:2", "HI:i:1", "AS:i:40", "nM:i:1", "NM:i:1", "XS:A:+", "jM:B:c,21", "jI:B:i,106,115", "MD:Z:4C5", "RG:Z:g1", "vA:B:c,1,3", "vG:B:i,103,117", "vW:i:1"]
    assert got[1] == ["NH:i:1", "HI:i:1", "AS:i:10", "nM:i:0", "NM:i:0", "MD:Z:10"]
    with pytest.raises(ValueError):
        tags.optional_fields(["ZZ"])
    hits = df.withColumns({"mapq": F.lit(3), "chr_name": F.lit("c"), "is_reverse": F.lit(False), "seq": F.col("aligned"), "qual": F.lit("IIIIIIIIII")})
    lines = {r.read_id: r.line for r in records.sam_lines(hits, tags.optional_fields(["HI", "RG"], first_hit=0)).collect()}
    assert lines[1].endswith("IIIIIIIIII\tHI:i:0\tRG:Z:g1") and lines[2].endswith("\tHI:i:0")
    reasons = spark.createDataFrame([("too_short",), ("too_many_loci",), ("else",), (None,)], "r string")
    assert [r.u for r in reasons.select(tags.unmapped_field(F.col("r")).alias("u")).collect()] == ["uT:A:1", "uT:A:3", "uT:A:0", "uT:A:0"]


def test_run_counters_and_status_of_places(spark):
    from helixframe.operators import alignments, barcodes

    rows = [("exact", "ACGT"), ("exact", "AAAA"), ("multi_rejected", "ANGT"), ("none", None), ("corrected", "ACCC")]
    got = {r.kind: r.n for r in barcodes.run_stats(spark.createDataFrame(rows, "kind string, umi string")).collect()}
    assert got == {"exact": 2, "corrected": 1, "multi": 0, "none": 1, "n_in_cb": 0, "multi_rejected": 1, "n_in_umi": 1, "umi_homopolymer": 1}
    aln = spark.createDataFrame([(1,)] * 3 + [(2,)] + [(3,)] * 2, "read_id long")
    assert sorted(map(tuple, alignments.loci_status(aln, 2).collect())) == [(1, 3, "too_many_loci"), (2, 1, "unique"), (3, 2, "multi")]


def test_short_manifest_lines_and_unknown_chromosomes_are_errors(spark, tmp_path):
    from helixframe.sources import text

    (tmp_path / "m").write_text("#x\na.fq\tb.fq\tcell\n\nc.fq\t-\td\n")
    assert sorted(map(tuple, text.manifest(spark, f"{tmp_path}/m").collect())) == [("a.fq", "b.fq", "cell"), ("c.fq", None, "d")]
    (tmp_path / "bad").write_text("a.fq\tb.fq\n")
    with pytest.raises(Exception, match="manifest line"):
        text.manifest(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "j").write_text("c1 5 9 +\nc2 7 8\n")
    assert len(text.junction_table(spark, f"{tmp_path}/j", ["c1", "c2"]).collect()) == 2
    with pytest.raises(Exception, match="unknown chromosome"):
        text.junction_table(spark, f"{tmp_path}/j", ["c1"]).collect()
