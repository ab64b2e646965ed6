from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import molecules as M


def _serial(rows, size):
    of = {(cb, gene, umi): n for cb, gene, umi, n in rows}
    out = {}
    for (cb, gene, umi), n in of.items():
        best = (n, umi)
        for i in range(size):
            for d in (1, 2, 3):
                other = umi ^ (d << (2 * i))
                best = max(best, (of.get((cb, gene, other), -1), other)) if (cb, gene, other) in of else best
        out[cb, gene, umi] = best[1]
    return out


@pytest.fixture
def rows():
    r = random.Random(1)
    keys = sorted({(r.choice([1, 1, 1, 2, 3, 9]), r.randrange(5), r.randrange(256)) for _ in range(1500)})
    return [(*k, r.randint(1, 4)) for k in keys]


@pytest.mark.parametrize("large", [None, 60])
def test_correction_in_tasks_and_by_joins(spark, rows, large):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        mols = spark.createDataFrame(rows, "cb long, gene long, umi long, reads long").repartition(3)
        want = _serial(rows, 4)
        got = {(x.cb, x.gene, x.umi): x.target for x in M.corrected_cr(mols, 4, large).collect()}
        assert got == want
        counts = {(x.cb, x.gene): x.value for x in M.count_cr(mols, 4, large).collect()}
        assert counts == {(cb, gene): len({t for (c, g, _), t in want.items() if (c, g) == (cb, gene)}) for cb, gene, _ in want}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_and_wide_tags(spark):
    rows = [(1, 1, None, 5), (1, None, 3, 2), (1, None, 2, 9), (2, 1, -1, 3), (2, 1, -2, 4), (3, 1, 1 << 61, 1), (3, 1, (1 << 61) + 1, 2)]
    mols = spark.createDataFrame(rows, "cb long, gene long, umi long, reads long")
    got = {(x.cb, x.gene): x.value for x in M.count_cr(mols, 2).collect()}
    assert got == {(1, 1): 0, (1, None): 2, (2, 1): 1, (3, 1): 1}


def test_neighbours_are_not_made_as_rows(spark, rows):
    """Before, each molecule was shuffled with all of its neighbours, 15 rows for a tag of five bases."""
    mols = spark.createDataFrame(rows, "cb long, gene long, umi long, reads long")
    for df in (M.count_cr(mols, 4), M.filter_cr_corrected(mols, 4)):
        plan = df._jdf.queryExecution().toString()
        assert "Join" not in plan


def test_filter_against_serial(spark, rows):
    want = _serial(rows, 4)
    reads = {(cb, gene, umi): n for cb, gene, umi, n in rows}
    moved = {}
    for key, target in want.items():
        at = (key[0], target, key[1])
        moved[at] = moved.get(at, 0) + reads[key]
    kept = set()
    for (cb, umi, gene), n in moved.items():
        rivals = [m for (c, u, _), m in moved.items() if (c, u) == (cb, umi)]
        raw = max(m for (c, _, u), m in reads.items() if (c, u) == (cb, umi))
        if n == max(rivals) and rivals.count(n) == 1 and reads.get((cb, gene, umi), 0) >= raw:
            kept.add((cb, umi, gene))
    mols = spark.createDataFrame(rows, "cb long, gene long, umi long, reads long").orderBy(F.rand(2))
    assert {tuple(x) for x in M.filter_cr_corrected(mols, 4).collect()} == kept
