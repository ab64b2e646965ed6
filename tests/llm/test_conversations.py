"""Conversation repair against a search through all edits, and its defined cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from helixframe.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def every_edit(rows):
    """(cost, audit, repaired) of the best of all edits with up to two inserts at a place."""
    seen, options, faults = set(), [], []
    for role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        choices = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            extra = int(fault == "truncated")
            choices += [(extra, "K", [(role, text)]), (2 + extra, "R", [("user", text)]), (2 + extra, "R", [("assistant", text)])]
        options.append(choices)
    inserts = [(0, "", [])] + [(2 * n, "I" * n, list(x)) for n in (1, 2) for x in itertools.product([("user", ""), ("assistant", "")], repeat=n)]
    partial = [(0, "", [])]
    grammar = re.compile(r"(s?(u|ua)*)?")
    for place in [*[x for o in options for x in (inserts, o)], inserts]:
        partial = [(a + d, b + e, c + f) for a, b, c in partial for d, e, f in place]
        partial = [p for p in partial if grammar.fullmatch("".join(r[:1] or "?" for r, _ in p[2]))]
        least = min(p[0] for p in partial)
        partial = [p for p in partial if p[0] <= least + 6]
    right = [p for p in partial if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in p[2]))]
    cost, audit, kept = min(right, key=lambda p: (p[0], p[1]))
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in kept), faults


def expected(conv, rows):
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, text, faults = every_edit([(r, t) for _, r, t in rows])
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def made(spark, rows):
    return spark.createDataFrame(rows, "conv long, turn long, role string, text string")


@pytest.mark.parametrize("piece_rows", [1, 2, 1000])
def test_repair_is_the_cheapest_of_all_edits(spark, piece_rows):
    draw = random.Random(piece_rows)
    talks = {}
    for conv in [None, *range(24)]:
        rows = [(turn, draw.choice(["user", "user", "assistant", "assistant", "system", " ", "tool"]), draw.choice(["A.", "b!", "c", "long one?", " ", "A."]) + str(draw.choice(["", turn]))) for turn in range(draw.randint(1, 4))]
        talks[conv] = [(t, r, x if x.strip() in ("", "A.") else x + "." * draw.randint(0, 1)) for t, r, x in rows]
    rows = [(c, *r) for c, talk in talks.items() for r in talk]
    draw.shuffle(rows)
    got = C.repair(made(spark, rows), piece_rows=piece_rows)
    assert {tuple(r) for r in got.collect()} == {expected(c, talk) for c, talk in talks.items()}


def test_long_conversation_over_many_pieces_equals_one_piece(spark):
    draw = random.Random(5)
    rows = [(7, turn, draw.choice(["user", "assistant", "system"]), draw.choice(["x.", "y", "", "z!"]) + ("" if turn % 5 else str(turn))) for turn in range(400)]
    rows += [(c, 0, "user", f"{c}.") for c in range(8, 40)]
    one = {tuple(r) for r in C.repair(made(spark, rows), piece_rows=5000).collect()}
    assert one == {tuple(r) for r in C.repair(made(spark, rows), piece_rows=7).collect()}
    turns = C.repaired_turns(made(spark, rows), piece_rows=7).filter("conv = 7").orderBy("piece", "at").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in turns)
    assert hashlib.sha256(text.encode()).hexdigest() in {r[-1] for r in one}
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[0] for r in turns))


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, r, "Is it so? Yes. No!") for c in (1, 2, None) for t in [*range(60), None] for r in ("system", None)]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            out = (c, t, "user" if kind == 4 else r or " ", "" if kind == 1 else "Is it so Yes No" if kind == 2 else x)
            want += [out] * (2 if kind == 3 else 1)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, C.damage(table).collect()), key=repr) == sorted(want, key=repr)


def test_null_empty_long_and_repeated_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (2, 1, "", "b."), (2, 2, "assistant", "c" * 300_000 + "."), (3, 5, "user", "\x0b\r"), (4, 3, "user", "é"), (4, 9, "assistant", "!")]
    got = {r.conv: r for r in C.repair(made(spark, rows)).collect()}
    assert got[None].audit == "D" and got[None].blank == 1 and got[None].gaps == 0
    assert got[1].audit == "KDI" and got[1].duplicate == 1
    assert got[2].audit == "RK" and got[2].illegal == 1
    assert got[3].audit == "D" and got[3].repaired_sha256 == C.NO_TEXT
    assert got[4].gaps == 5 and got[4].truncated == 1 and got[4].cost == 1


def test_conversations_without_rows_and_empty_tables(spark):
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "x.", 1)], "conv_id long, turn long, role string, text string, audit int")
    assert [tuple(r) for r in C.damage_and_repair(table).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", C.NO_TEXT)]
    assert C.damage_and_repair(table.limit(0)).collect() == []
