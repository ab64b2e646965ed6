"""Sources, sinks, alignment and the rules without SQL, on small inputs."""

from __future__ import annotations

import gzip
import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import junctions, molecules, records, seeds, transcripts
from helixframe.sinks import text as sinks
from helixframe.sources import text as sources


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def turned(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def genome(seed=1):
    rng = random.Random(seed)
    intron = "GT" + bases(rng, 196) + "AG"
    one, two = bases(rng, 50), bases(rng, 50)
    chr1 = bases(rng, 10_000) + one + intron + two + bases(rng, 9_700)
    return {"chr1": chr1, "chr2": bases(rng, 3_000) + chr1[4_000:4_100] + bases(rng, 500)}


def test_align_finds_places_strands_and_junctions(spark):
    g = genome()
    c = g["chr1"]
    spliced = c[10_020:10_050] + c[10_250:10_280]
    wrong = list(c[2_000:2_080])
    wrong[40] = {"A": "C", "C": "G", "G": "T", "T": "A"}[wrong[40]]
    reads = [(1, c[500:580]), (2, turned(c[900:980])), (3, spliced), (4, turned(spliced)), (5, "".join(wrong)), (6, c[4_000:4_080]), (7, bases(random.Random(9), 80)), (8, None), (9, "ACGT"), (10, "TTTTTTTT" + c[7_000:7_072])]
    frame = spark.createDataFrame(reads, "read_id long, seq string")
    seqs = spark.createDataFrame(list(g.items()), "chr string, seq string")
    found = seeds.best_places(seeds.align(frame, seqs, tile=1000, reach=200))
    out = {}
    for r in found.collect():
        out.setdefault(r.read_id, []).append(r)
    assert set(out) == {1, 2, 3, 4, 5, 6, 10}
    one = lambda i: [(r.chr, r.start, r.is_reverse, r.cigar, r.n_mismatch) for r in out[i]]
    assert one(1) == [("chr1", 500, False, "80M", 0)]
    assert one(2) == [("chr1", 900, True, "80M", 0)]
    assert one(3) == [("chr1", 10_020, False, "30M200N30M", 0)]
    assert one(4) == [("chr1", 10_020, True, "30M200N30M", 0)]
    assert one(5) == [("chr1", 2_000, False, "80M", 1)]
    assert sorted(x[0] for x in one(6)) == ["chr1", "chr2"]
    assert one(10)[0][:2] == ("chr1", 7_000 - 8 + one(10)[0][1] - 6_992)
    obs = junctions.collapse(seeds.junction_observations(found)).collect()
    assert [(r.chr, r.start, r.end, r.motif, r.n_unique, r.overhang) for r in obs] == [("chr1", 10_050, 10_249, 1, 2, 30)]


def test_fastq_fasta_gtf_and_sam(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1/1 extra\nACGTN\n+\nIIIII\n@r2/1\nacg\n+\n!!I\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1/2\nTTTT\n+\nIIII\n@r9/2\nGG\n+\nII\n")
    one, two = sources.fastq(spark, f"{tmp_path}/a.fq"), sources.fastq(spark, f"{tmp_path}/b.fq.gz")
    assert [(r.read_no, r.name, r.seq, r.qual) for r in one.orderBy("read_no").collect()] == [(0, "r1", "ACGTN", "IIIII"), (1, "r2", "ACG", "!!I")]
    assert [r.ok for r in sources.paired(one, two).orderBy("read_no").collect()] == [True, False]
    (tmp_path / "g.fa").write_text(">c1 text\nACgt\nNNxx\n>c2\nTT\n")
    assert sorted((r.name, r.seq) for r in sources.fasta(spark, f"{tmp_path}/g.fa").collect()) == [("c1", "ACGTNNNN"), ("c2", "TT")]
    (tmp_path / "g.gtf").write_text('# head\nc1\tx\tExon\t5\t9\t.\t+\t.\tgene_id "G1"; transcript_id "T1";\nbroken\nc1\tx\tCDS\t5\t9\t.\t+\t.\tgene_id "G1";\n')
    rows = sources.gtf(spark, f"{tmp_path}/g.gtf").collect()
    assert [(r.start, r.end, r.strand, r.attributes["gene_id"]) for r in rows] == [(5, 9, "+", "G1")]
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\nr1\t16\tc1\t8\t255\t5M\t*\t0\t0\tACGTN\tIIIII\tNH:i:1\tAS:i:4\n")
    sam = records.parse_sam(spark.read.text(f"{tmp_path}/x.sam")).collect()
    assert [(r.name, r.flag, r.start, r.cigar, r.tags["AS"]) for r in sam] == [("r1", 16, 7, "5M", "4")]


def test_sinks_write_the_expected_lines(spark):
    runs = spark.createDataFrame([("c1", 3, 9, 2.0), ("c1", 9, 11, 4 / 3), ("c1", 11, 12, 0.5)], "chr string, start long, end long, value double")
    assert [r[0] for r in sinks.bedgraph_lines(runs).collect()] == ["c1\t3\t9\t2", "c1\t9\t11\t1.33333", "c1\t11\t12\t0.5"]
    assert [r[0] for r in sinks.bedgraph_lines(runs.limit(1), 2.5).collect()] == ["c1\t3\t9\t5.00000"]
    hits = spark.createDataFrame([(7, 1, 1, 255, "c1", 4, True, "4M", "ACCN", "IJKL", 3, 0)], "read_id long, hit int, n_loci int, mapq int, chr_name string, start long, is_reverse boolean, cigar string, seq string, qual string, score int, n_mismatch int")
    assert records.sam_lines(hits).collect()[0].line == "7\t16\tc1\t5\t255\t4M\t*\t0\t0\tNGGT\tLKJI\tNH:i:1\tHI:i:1\tAS:i:3\tnM:i:0"
    reads = spark.createDataFrame([(7, "A", "I"), (8, "C", None)], "read_id long, seq string, qual string")
    assert [r.line.split("\t")[:2] for r in records.unmapped_lines(reads, hits).collect()] == [["8", "4"]]


def serial_directional(items, add):
    order = sorted(items, key=lambda x: (-x[1], x[0]))
    gone = set()
    apart = lambda a, b: sum(1 for i in range(5) if (a >> 2 * i) & 3 != (b >> 2 * i) & 3) == 1
    for hub, n in order:
        if hub in gone:
            continue
        for leaf, m in order:
            if leaf != hub and leaf not in gone and m <= n and n >= 2 * m + add and apart(hub, leaf):
                gone.add(leaf)
    return len(order) - len(gone)


def test_directional_equals_a_serial_version(spark):
    rng = random.Random(3)
    rows = {(cb, gene, rng.randrange(200)): rng.choice([1, 1, 2, 3, 5, 9]) for cb in range(3) for gene in range(4) for _ in range(25)}
    frame = spark.createDataFrame([(cb, umi, gene, n) for (cb, gene, umi), n in rows.items()], "cb long, umi long, gene long, reads long")
    for add in (0, -1):
        got = {(r.cb, r.gene): r.value for r in molecules.count_directional(frame, 5, add).collect()}
        want = {k: serial_directional([(u, n) for (c, g, u), n in rows.items() if (c, g) == k], add) for k in got}
        assert got == want


def test_em_splits_molecules_by_unique_evidence(spark):
    unique = spark.createDataFrame([(1, 10, 30), (1, 11, 10)], "cb long, gene long, value long")
    sets = spark.createDataFrame([(1, m, g) for m in range(8) for g in (10, 11)], "cb long, molecule long, gene long")
    out = {r.gene: r.value for r in molecules.share_multi_em(unique, sets).collect()}
    assert abs(out[10] - 36) < 1e-3 and abs(out[11] - 12) < 1e-3
    common = spark.createDataFrame([(1, u, t, 0) for u in range(40) for t in ((5,) if u < 30 else (5, 6))], "cluster long, umi long, transcript long, log_weight long")
    shares = {r.transcript: r.value for r in transcripts.transcript_shares(common).collect()}
    assert abs(sum(shares.values()) - 40) < 1e-6 and shares[5] > 35


def serial_shares(molecules_, factors, rounds=10_000):
    """Expectation-maximisation over single molecules, {transcript: log weight} each."""
    names = sorted({t for m in molecules_ for t in m})
    alone = {t: float(sum(1 for m in molecules_ if list(m) == [t])) for t in names}
    old = {t: sum(1 / len(m) for m in molecules_ if t in m) for t in names}
    frozen, new = set(), old
    for _ in range(rounds):
        new = dict(alone)
        for m in molecules_:
            if len(m) > 1:
                top = max(m.values())
                total = sum(np.exp(w - top) * old[t] for t, w in m.items())
                for t, w in m.items():
                    if t not in frozen and total:
                        new[t] += np.exp(w - top) * old[t] / total
        worst = 0.0
        for t in names:
            if t in frozen or old[t] == 0:
                continue
            diff = abs(new[t] - old[t]) / old[t]
            worst = max(worst, diff)
            if new[t] < 1e-8 * len(molecules_):
                frozen.add(t)
                alone[t] = 0.0
            if diff < 1e-6:
                frozen.add(t)
                alone[t] = new[t]
        if worst < 1e-5:
            break
        old, new = new, old
    value = {t: new[t] * np.exp(factors.get(t, 0.0)) for t in names}
    scale = len(molecules_) / sum(value.values())
    return {t: v * scale for t, v in value.items()}


def test_transcript_shares_equal_a_serial_version(spark):
    rng = random.Random(6)
    mols = [{t: round(rng.uniform(-8, 0), 1) for t in rng.sample(range(6), rng.randint(1, 4))} for _ in range(120)]
    factors = {t: 0.1 * t for t in range(6)}
    common = spark.createDataFrame([(3, u, t, w) for u, m in enumerate(mols) for t, w in m.items()], "cluster long, umi long, transcript long, log_weight double")
    table = spark.createDataFrame(list(factors.items()), "transcript long, factor double")
    got = {r.transcript: r.value for r in transcripts.transcript_shares(common, table).collect()}
    want = serial_shares(mols, factors)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-6 for t in want)


def test_distance_function_and_weights(spark):
    rng = random.Random(2)
    counts = {b: rng.randint(0, 40) + (900 if 1190 < b < 1260 else 0) for b in range(0, 3000, 3)}
    shares = transcripts.distance_function(spark.createDataFrame(list(counts.items()), "bin long, n long"), bins=4000)
    mean = [0.0] * 4000
    for i in range(4000 - 51):
        mean[i] = sum(counts.get(j, 0) for j in range(max(i - 50, 0), i + 51)) / min(101, i + 50)
    end = 1000
    while mean[end + 1] > mean[end]:
        end += 1
    while mean[end + 1] < mean[end]:
        end += 1
    total = sum(mean[:end])
    assert len(shares) == end and np.allclose(shares, [m / total for m in mean[:end]])
    lengths = spark.createDataFrame([(1, 10), (2, 700), (3, 99_999)], "transcript long, length long")
    factors = {r.transcript: r.factor for r in transcripts.length_factors(lengths, shares).collect()}
    assert abs(factors[2] + np.log(shares[:700].sum())) < 1e-9 and factors[3] == 0
    hits = spark.createDataFrame([(1, 5), (2, 5), (3, end)], "transcript long, to_end long")
    rows = {r.transcript: r.log_weight for r in transcripts.weighted_hits(hits, transcripts.length_factors(lengths, shares), shares).collect()}
    assert rows.keys() == {1, 2} and abs(rows[2] - np.log(shares[5]) - factors[2]) < 1e-9


def test_adapter_offset_equals_a_direct_search(spark):
    rng = random.Random(4)
    adapter = "AGATCGGAAG"
    reads = [bases(rng, 30) + adapter[: rng.randint(0, 10)] for _ in range(40)] + ["", None, "NNNN", adapter, "AG", bases(rng, 20) + "AGNTCGGAAG" + "TTT"]
    want = []
    for s in reads:
        s = s or ""
        best = (len(s), 0, 0)
        for i in range(len(s)):
            pairs = [(a, b) for a, b in zip(s[i:], adapter) if a != "N"]
            same = sum(a == b for a, b in pairs)
            other = len(pairs) - same
            if (same > best[1] or (same == best[1] and other < best[2])) and (same == 0 or other / same <= 0.1):
                best = (i, same, other)
        want.append(best[0])
    frame = spark.createDataFrame(list(enumerate(reads)), "i int, s string").coalesce(1)
    assert [r[0] for r in frame.select(S.adapter_offset(F.col("s"), adapter, 0.1), "i").orderBy("i").collect()] == want


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 30, (400, 3))]
    frame = spark.createDataFrame(rows, "cb long, umi long, gene long")
    got = [sorted(map(tuple, molecules.count_components(molecules.molecules(frame.repartition(n)), 5).collect())) for n in (1, 2, 7)]
    assert got[0] == got[1] == got[2]
