from __future__ import annotations

import random

import pytest

from helixframe.operators import molecules as M


@pytest.mark.parametrize("state", [1, 1000])
def test_rounds_store_nothing_and_send_blocks_nowhere(spark, monkeypatch, state):
    """Before, each round joined all entries twice and stored three tables."""
    draw = random.Random(8)
    unique = spark.createDataFrame([(cb, g, draw.randint(0, 5)) for cb in (1, 2, 3) for g in range(6)], "cb long, gene long, value long")
    sets = spark.createDataFrame([(cb, m, g) for cb in (1, 2, 3) for m in range(20) for g in draw.sample(range(9), draw.randint(2, 4))], "cb long, molecule long, gene long")
    want = {(r.cb, r.gene): r.value for r in M.share_multi_em(unique, sets, rounds=9).collect()}
    made, inner = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df: made.append(1) or inner(df))
    monkeypatch.setattr(M, "STATE", state)
    monkeypatch.setattr(M, "BLOCK", 7)
    got = {(r.cb, r.gene): r.value for r in M.share_multi_em(unique, sets, rounds=9, large=0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(made) <= 5 + 3
