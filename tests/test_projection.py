"""Records in transcript coordinates against a walk base by base."""

from __future__ import annotations

import random
import re

from helixframe.operators import projection, seeds

EXONS = [("t1", "c", 100, 200, "+"), ("t1", "c", 300, 400, "+"), ("t1", "c", 500, 650, "+"), ("t2", "c", 100, 200, "-"), ("t2", "c", 300, 400, "-"), ("t3", "c", 150, 400, "+"), ("t4", "d", 100, 200, "+")]
ALN = "aln_id long, read_id long, chr string, start long, end long, cigar string, is_reverse boolean, n_mismatch int, n_loci int, seq string"


def walked(start, cigar, exons):
    """(t_start, cigar) on a forward transcript, or None."""
    place, offset = {}, 0
    for a, b in sorted(exons):
        for x in range(a, b):
            place[x] = offset + x - a
        offset += b - a
    bounds = {b: nxt for (_, b), (nxt, _) in zip(sorted(exons), sorted(exons)[1:])}
    at, ops, first, before = start, [], None, None
    for n, op in re.findall(r"(\d+)([MIDNS])", cigar):
        n = int(n)
        if op == "N":
            if bounds.get(at) != at + n:
                return None
            at, before = at + n, None
            continue
        if op in "MD":
            for _ in range(n):
                if at not in place or (before is not None and place[at] != before + 1) or (before is not None and at - 1 not in place):
                    return None
                first = place[at] if first is None else first
                before, at = place[at], at + 1
        if ops and ops[-1][1] == op:
            ops[-1][0] += n
        else:
            ops.append([n, op])
    return first, "".join(f"{n}{op}" for n, op in ops), offset


def turned(t_start, cigar, length):
    used = sum(int(n) for n, op in re.findall(r"(\d+)([MIDNS])", cigar) if op in "MD")
    return length - t_start - used, "".join(reversed(re.findall(r"\d+[MIDNS]", cigar)))


def test_projection_is_the_walk_along_every_transcript(spark):
    draw = random.Random(3)
    rows = []
    for i in range(300):
        start = draw.choice([120, 150, 180, 190, 310, 380, 520, 640, draw.randint(90, 650)])
        cigar = draw.choice(["20M", "3S20M", "10M100N20M", "20M100N100M100N10M", "10M2D10M", "12M1I8M2S", "20M101N20M", f"{200 - start}M100N30M" if start < 200 else "5M", f"{400 - start}M100N30M" if 300 <= start < 400 else "9M"])
        span = sum(int(n) for n, op in re.findall(r"(\d+)([MIDNS])", cigar) if op in "MDN")
        rows.append((i, i // 3, "c", start, start + span, cigar, draw.random() < 0.5, 0, 3, None))
    got = projection.projected(spark.createDataFrame(rows, ALN), spark.createDataFrame(EXONS, "transcript string, chr string, start long, end long, strand string"), mode="keep")
    want = set()
    for aln, read, chrom, start, _, cigar, reverse, *_ in rows:
        for t in ("t1", "t2", "t3", "t4"):
            own = [(e[2], e[3]) for e in EXONS if e[0] == t and e[1] == chrom]
            if own and (found := walked(start, cigar, own)):
                at, text, length = found
                at, text = turned(at, text, length) if t == "t2" else (at, text)
                want.add((aln, read, t, at, text, reverse != (t == "t2"), 0))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_primary_is_one_of_all_hits_and_quality_counts_the_larger_number(spark):
    rows = [(i, i % 40, "c", 310, 330, "20M", False, 0, 1 if i < 40 else 5, None) for i in range(40)] + [(100, 100, "c", 510, 530, "20M", True, 0, 5, None)]
    exons = spark.createDataFrame(EXONS, "transcript string, chr string, start long, end long, strand string")
    got = projection.transcript_records(spark.createDataFrame(rows, ALN), exons, mode="keep").collect()
    by = {}
    for r in got:
        by.setdefault(r.read_id, []).append(r)
    assert all(sorted(r.hit for r in v) == list(range(1, len(v) + 1)) for v in by.values())
    assert {r.mapq for r in by[0]} == {1} and len(by[0]) == 3 and {r.mapq for r in by[100]} == {0}
    assert len({next(r.transcript for r in v if r.hit == 1) for k, v in by.items() if k < 40}) == 3
    assert {r.flag for r in got if r.hit == 1} <= {0, 16} and all(r.flag & 256 for r in got if r.hit > 1)


def test_modes_ban_indels_and_lay_clips_on_the_genome(spark):
    draw = random.Random(9)
    seq = "".join(draw.choice("ACGT") for _ in range(700))
    genome = spark.createDataFrame([("c", seq)], "chr string, seq string")
    exons = spark.createDataFrame(EXONS, "transcript string, chr string, start long, end long, strand string")
    wrong = "".join("ACGT"[("ACGT".index(c) + 1) % 4] for c in seq[505:520])
    rows = [
        (1, 1, "c", 515, 535, "5S20M4S", False, 0, 1, seq[510:539]), (2, 2, "c", 520, 550, "10M2D18M", False, 0, 1, seq[520:530] + seq[532:550]),
        (3, 3, "c", 520, 550, "15S30M", False, 0, 1, wrong + seq[520:550]), (4, 4, "c", 503, 530, "4S27M", False, 0, 1, seq[499:530]),
    ]
    aln, parts = spark.createDataFrame(rows, ALN), seeds.tiles(genome)
    ban = {r.aln_id: (r.transcript, r.t_start, r.cigar) for r in projection.projected(aln, exons, parts=parts).collect()}
    assert ban == {1: ("t1", 210, "29M")}
    keep = {r.aln_id for r in projection.projected(aln, exons, mode="keep").collect()}
    assert keep == {1, 2, 3, 4}


def test_pairs_need_both_mates_on_one_transcript(spark):
    rows = [(1, 1, "c", 110, 130, "20M", False, 0, 1, None, 1, 1), (2, 1, "c", 350, 370, "20M", True, 0, 1, None, 1, 2), (3, 2, "c", 110, 130, "20M", False, 0, 1, None, 1, 1), (4, 2, "d", 150, 170, "20M", True, 0, 1, None, 1, 2)]
    exons = spark.createDataFrame(EXONS, "transcript string, chr string, start long, end long, strand string")
    got = projection.transcript_pairs(spark.createDataFrame(rows, ALN + ", pair_no int, mate int"), exons, mode="keep").collect()
    assert {(r.read_id, r.transcript) for r in got} == {(1, "t1"), (1, "t2")} and len(got) == 4
    assert {r.mapq for r in got} == {3}
    for hit in (1, 2):
        flags = sorted(r.flag for r in got if r.hit == hit)
        assert [f & 0x3 for f in flags] == [3, 3] and {f & 0xC0 for f in flags} == {64, 128} and {f & 0x30 for f in flags} == {16, 32}


def test_projection_moves_an_alignment_once_and_needs_each_exon_once(spark):
    """Overlapping exons of one transcript give no row where a stretch lies in two of them; no join but that with the exons."""
    exons = [("t", "c", 100, 200, "+"), ("t", "c", 300, 400, "+"), ("u", "c", 100, 200, "-"), ("u", "c", 150, 260, "-")]
    rows = [(1, 1, "c", 120, 330, "80M100N30M", False, 0), (2, 2, "c", 120, 140, "20M", True, 0), (3, 3, "c", 160, 180, "20M", False, 0), (4, 4, "c", 120, 330, "79M101N30M", False, 0)]
    aln = spark.createDataFrame(rows, "aln_id long, read_id long, chr string, start long, end long, cigar string, is_reverse boolean, n_mismatch int")
    out = projection.projected(aln, spark.createDataFrame(exons, "transcript string, chr string, start long, end long, strand string"), mode="keep")
    got = sorted((r.aln_id, r.transcript, r.t_start, r.cigar, r.is_reverse) for r in out.collect())
    assert got == [(1, "t", 20, "110M", False), (2, "t", 20, "20M", True), (2, "u", 170, "20M", False), (3, "t", 60, "20M", False)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
