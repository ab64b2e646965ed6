"""Large groups by joins give what the loops of one task give."""

from __future__ import annotations

import random

import pytest

from helixframe.operators import molecules as M


@pytest.fixture(scope="module")
def mols(spark):
    draw = random.Random(4)
    rows = [(cb, gene, umi, draw.choice([1, 1, 1, 2, 3, 5, 9, 20])) for cb, gene, n in ((1, 1, 150), (1, 2, 3), (2, 1, 60), (3, 3, 1)) for umi in draw.sample(range(4**5), n)]
    return spark.createDataFrame(rows, "cb long, gene long, umi long, reads long")


@pytest.mark.parametrize("large", [0, 100])
def test_tags_of_large_groups(spark, mols, large):
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(M.count_components(mols, 5, large)) == plain(M.count_components(mols, 5, 1 << 40))
    for add in (0, -1):
        assert plain(M.count_directional(mols, 5, add, large)) == plain(M.count_directional(mols, 5, add, 1 << 40))


def test_rounds_of_a_large_cell(spark):
    draw = random.Random(6)
    unique = spark.createDataFrame([(cb, g, draw.randint(0, 5)) for cb in (1, 2) for g in range(6)], "cb long, gene long, value long")
    sets = [(cb, m, g) for cb in (1, 2, 9) for m in range(30 if cb == 1 else 4) for g in draw.sample(range(9), draw.randint(2, 4))]
    sets = spark.createDataFrame(sets, "cb long, molecule long, gene long")
    want = {(r.cb, r.gene): r.value for r in M.share_multi_em(unique, sets, rounds=12).collect()}
    for large in (0, 40):
        got = {(r.cb, r.gene): r.value for r in M.share_multi_em(unique, sets, rounds=12, large=large).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {k[0] for k in want} == {1, 2}
