"""Sweeps along chromosomes against serial versions, with bins much smaller than the data."""

import random

import pytest

from helixframe.operators import intervals
from helixframe.operators.ranking import adjust_p, global_rank


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("mated", [0.02, 0.3, 0.0])
def test_mate_clusters_equal_a_serial_sweep(spark, seed, mated):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        pos = rng.randrange(3000)
        rows.append((i % 2, pos, pos + rng.randint(1, 60) if rng.random() < mated else None, i))
    want = {}
    for chrom in (0, 1):
        cluster, top = 1, 0
        for _, pos, mate, record in sorted((r for r in rows if r[0] == chrom), key=lambda r: (r[1], r[3])):
            if top and pos > top:
                cluster, top = cluster + 1, 0
            top = max(top, mate or 0)
            want[record] = cluster
    df = spark.createDataFrame(rows, "chr int, pos long, mate_pos long, record int")
    out = intervals.mate_clusters(df, ["chr"], width=100).collect()
    assert {r.record: r.cluster for r in out} == want


def test_islands_and_clusters_across_bins(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), s, s + rng.randint(1, 90)) for s in (rng.randrange(4000) for _ in range(150))]
    rows += rows[:20] + [(0, 0, 1500)]
    want = []
    for chrom in (0, 1):
        island = None
        for _, s, e in sorted(r for r in rows if r[0] == chrom):
            if island and s <= island[2]:
                island[2] = max(island[2], e)
            else:
                island = [chrom, s, e]
                want.append(island)
    df = spark.createDataFrame(rows, "chr int, start long, end long")
    got = intervals.merge_islands(df, ["chr"], width=128).select("chr", "start", "end").collect()
    assert sorted(map(list, got)) == sorted(want)
    numbers = intervals.overlap_clusters(df, ["chr"], width=128).collect()
    assert all(len({r.cluster for r in numbers if (r.chr, r.start, r.end) == row}) == 1 for row in rows)


def test_as_of_join_across_bins(spark):
    blocks = [(1, 10, "a"), (1, 11, "b"), (1, 900, "c"), (2, 500, "d")]
    points = [(1, 5), (1, 10), (1, 400), (1, 899), (1, 900), (1, 5000), (2, 499), (2, 4000), (3, 1), (1, None)]
    got = intervals.as_of_join(
        spark.createDataFrame(points, "chr int, pos long"), spark.createDataFrame(blocks, "chr int, start long, name string"), width=100
    )
    want = {(1, 5): None, (1, 10): "a", (1, 400): "b", (1, 899): "b", (1, 900): "c", (1, 5000): "c", (2, 499): None, (2, 4000): "d", (3, 1): None, (1, None): None}
    assert {(r.chr, r.pos): r.name for r in got.collect()} == want


def test_ranks_and_adjusted_p(spark):
    rng = random.Random(2)
    values = [round(rng.random(), 2) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, p double")
    ranks = {r.id: r["rank"] for r in global_rank(df, [df.p.desc(), df.id]).collect()}
    assert [i for i, _ in sorted(ranks.items(), key=lambda x: x[1])] == sorted(range(300), key=lambda i: (-values[i], i))
    assert sorted(ranks.values()) == list(range(1, 301))
    order = sorted(values)
    want, low = {}, 1.0
    for k in range(300, 0, -1):
        low = min(low, order[k - 1] * 300 / k)
        want[order[k - 1]] = min(low, want.get(order[k - 1], 1.0))
    assert all(abs(r.p_adj - want[r.p]) < 1e-12 for r in adjust_p(df).collect())
