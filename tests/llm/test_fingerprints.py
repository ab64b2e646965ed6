"""Fingerprints: sums over paragraphs, edits, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from helixframe.llm import fingerprints as P


def vector(text):
    out = [0] * (P.EXACT + P.NEAR)
    for paragraph in text.split("\n"):
        digest = hashlib.sha256(paragraph.encode()).hexdigest()
        for k in range(P.EXACT):
            out[k] += int(digest[8 * k : 8 * k + 8], 16)
        words = paragraph.split(" ")
        for a, b in zip(words, words[1:]) if len(words) > 1 else [(words[0], "")]:
            at = zlib.crc32(f"{a} {b}".encode()) % (2 * P.NEAR)
            out[P.EXACT + at % P.NEAR] += 1 if at < P.NEAR else -1
    return [x % (1 << (P.EXACT_BITS if k < P.EXACT else P.NEAR_BITS)) for k, x in enumerate(out)]


def written(v):
    return "".join(f"{x:08x}" if k < P.EXACT else f"{x:04x}" for k, x in enumerate(v))


def alike(a, b):
    around = lambda x: (x + 32768) % 65536 - 32768
    a, b = a[P.EXACT :], b[P.EXACT :]
    apart = sum(around(x - y) ** 2 for x, y in zip(a, b))
    return 1.0 if not apart else max(0.0, 1 - apart / (sum(around(x) ** 2 for x in a) + sum(around(x) ** 2 for x in b)))


def expected(rows):
    """Result of rows (id, text) with different ids, in ascending order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0]))
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        v, e, w = vector(text), vector(edited), vector(after)
        out[i] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(v), written(e), alike(v, e), alike(v, w))
    return out


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_edits_equal_a_serial_version(spark):
    draw = random.Random(8)
    words = ["a", "to", "é", "wörd", "x\ty", "", "lorem"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", "\n", ". "]) for _ in range(draw.randint(0, 60)))
    rows = [(i * 3, text()) for i in range(60)] + [(None, "no id at all"), (1, None), (2, ""), (4, "\n"), (5, "long " * 40_000), (7, "𝒳𝒴𝒵 end")]
    draw.shuffle(rows)
    got = {r[0]: tuple(r) for r in P.edits(made(spark, rows)).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][:5] == row[:5] and all(abs(a - b) < 1e-12 for a, b in zip(got[i][5:], row[5:]))


def test_sums_are_independent_of_order_and_take_insertions_and_deletions(spark):
    texts = {"whole": "one two three\nfour\n\nfour", "turned": "four\n\none two three\nfour", "part": "four\n", "rest": "one two three\nfour", "other": "one two three\nfour\n\nfive"}
    parts = made(spark, list(enumerate(texts.values()))).withColumn("k", F.col("doc_id"))
    v = {name: row.v for name, row in zip(texts, P.lanes(parts, ["k"], {"v": F.lit(1)}).orderBy("k").collect())}
    assert v["whole"] == v["turned"] == vector(texts["whole"]) and v["whole"] != v["other"]
    pair = spark.createDataFrame([(v["whole"], v["part"], v["rest"])], "a array<long>, b array<long>, c array<long>")
    less = pair.select(P.combined(F.col("a"), F.col("b"), -1).alias("x"), P.combined(F.col("c"), F.col("b")).alias("y")).first()
    assert list(less.x) == v["rest"] and list(less.y) == v["whole"]


def test_repeated_ids_rows_one_document_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "e f g h"), (2, "other text here"), (2, None), (2, "")]
    got = P.edits(made(spark, rows).withColumns({"near_next": F.lit(1), "k1": F.lit(2)})).collect()
    assert len(got) == 6 and len({tuple(r) for r in got if r.doc_id == 1}) == 1
    assert {r.n_chars for r in got if r.doc_id == 2} == {0, 7, 15}
    alone = P.edits(made(spark, [(3, "self next one")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"self next selsel"[:10] + b"sel").hexdigest()
    assert P.edits(made(spark, [])).collect() == []


def test_likeness_follows_the_share_of_common_words(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(f"{draw.randrange(10**6)}" for _ in range(400))) for i in range(40)]
    got = P.edits(made(spark, rows)).collect()
    near = sorted(r.near_edited for r in got)
    assert 0.65 < near[20] < 0.85 and near[0] > 0.5 and max(r.near_next for r in got) < 0.4


def test_fingerprints_of_equal_texts_are_equal(spark):
    got = {r.doc_id: r.fingerprint for r in P.fingerprints(made(spark, [(1, "x y\nz"), (2, "z\nx y"), (3, "x y z"), (4, None), (5, "")])).collect()}
    assert got[1] == got[2] == written(vector("x y\nz")) != got[3] and got[4] == got[5]
