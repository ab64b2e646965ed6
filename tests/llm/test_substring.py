import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import substring


def brute(rows, size):
    places = {}
    raws = [(t or "").encode() for _, t in rows]
    for n, raw in enumerate(raws):
        if rows[n][0] is not None:
            for i in range(len(raw) - size + 1):
                places.setdefault(raw[i : i + size], []).append((n, i))
    gone = [bytearray(len(r)) for r in raws]
    for found in places.values():
        if len(found) > 1:
            for n, i in found:
                gone[n][i : i + size] = b"\1" * size
    out = []
    for (doc, _), raw, g in zip(rows, raws, gone):
        kept = bytes(b for b, x in zip(raw, g) if not x)
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((doc, len(raw), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdé \n\0"
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [fresh(n) for n in (30, 39, 40, 41, 60, 200)]
    texts = []
    for _ in range(40):
        parts = [fresh(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), fresh(rng.randint(0, 50))]
        texts.append("".join(parts))
    texts += [texts[0]] * 4 + ["a" * 300, "a" * 41, "ab" * 60, "", None, "x"]
    rows = list(enumerate(texts))
    return rows + [(None, texts[0]), (1, texts[1]), (2, fresh(100))]


@pytest.mark.parametrize("chunk", [500, 60])
@pytest.mark.parametrize("seed", [3, 4])
def test_spans_equal_brute_force(spark, seed, chunk):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    out = substring.remove_repeats(docs, min_bytes=40, gram=8, chunk_bytes=chunk).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=repr) == brute(rows, 40)


def test_default_parameters(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(500)) + passage[: 399 + i * 50] + "!" + str(i)) for i in range(6)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows, 400)


@pytest.fixture
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", [3, 4])
def test_all_groups_in_one_transform(spark, one_partition, seed):
    rows = corpus(seed)
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=40, gram=8).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=repr) == brute(rows, 40)


def test_a_segment_in_two_groups_does_not_match_itself():
    rng = random.Random(8)
    fresh = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    shared = fresh(400)
    # the first text is in both groups, with one neighbour in each; only the second shares a window
    texts = [fresh(100) + shared + fresh(100), shared + fresh(200), fresh(600)]
    rows = [(g, bytes([i]), len(texts[i]) - 399, 1, 1200, texts[i]) for g, i in ((1, 0), (1, 1), (2, 0), (2, 2))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["g", "d", "n", "c", "most", "bytes"])
    found = {}
    for out in substring._transform(iter([batch]), 400, substring.CHUNK_BYTES):
        for r in out.to_pylist():
            found.setdefault(r["d"], []).append(r["spans"])
    assert found == {b"\0": [[100, 101]], b"\1": [[0, 1]]}


def test_kept_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "q" * 50), (2, "z")], "doc_id long, text string")
    out = {r.doc_id: bytes(r.kept) for r in substring.remove_repeats(docs, min_bytes=40, gram=8, keep_bytes=True).collect()}
    assert out == {1: b"", 2: b"z"}
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_interval_expansion_finds_long_prefixes():
    rng = random.Random(5)
    raw = bytes(rng.choice(b"ab") for _ in range(3000)) + b"\0" + bytes(rng.choice(b"ab") for _ in range(500)) + b"\0"
    text = np.frombuffer(raw, np.uint8)
    order = substring.suffix_array(text, 64)
    suffixes = [raw[i:] for i in order.tolist()]
    assert [s[:60] for s in suffixes] == sorted(s[:60] for s in suffixes)
    for size in (16, 18, 24):
        same = substring.long_prefixes(text, order, size)
        want = [False] + [a[:size] == b[:size] and b"\0" not in a[:size] and len(a) >= size for a, b in zip(suffixes, suffixes[1:])]
        assert same.tolist() == want


def test_very_long_texts_are_taken_in_pieces(spark, monkeypatch):
    """Repeats across the pieces' edges, in one text and between two."""
    monkeypatch.setattr(substring, "RUN_BYTES", 700)
    rng = random.Random(6)
    fresh = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = fresh(900)
    rows = [(1, fresh(650) + shared + fresh(2000) + shared[:80]), (2, fresh(300) + shared[100:]), (3, "é" * 2000), (4, fresh(699)), (5, fresh(700))]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=60, gram=8).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=repr) == brute(rows, 60)


def test_passages_that_polynomial_hashes_confuse(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "c" + word[:400]), (4, "d" + word[:399])]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows, 400)


def test_texts_are_packed_in_small_batches(monkeypatch):
    monkeypatch.setattr(substring, "RUN_BYTES", 5000)
    texts = ["é" * 500, None, "", "x" * 12000, *(str(i) * 300 for i in range(60))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts), 0, -1)), pa.array(texts)], ["doc", "mark", "text"])
    out = list(substring._pack_text(iter([batch.slice(0, 3), batch.slice(3)])))
    back = [[None if p is None else zlib.decompress(p) for p in b.column("packed").to_pylist()] for b in out]
    assert [x for b in back for x in b] == [None if t is None else t.encode() for t in texts]
    assert [(d, m) for b in out for d, m in zip(b.column("doc").to_pylist(), b.column("mark").to_pylist())] == [(i, len(texts) - i) for i in range(len(texts))]
    assert all(sum(len(x or b"") for x in b) <= 5000 for b in back if len(b) > 1)
