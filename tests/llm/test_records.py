"""WARC, top-k, URL filter and packing on small tables."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from helixframe.llm import packing, topk, urlfilter, warc

# WARC


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    rows = [(9, "http://a/", "same text"), (2, None, "same text"), (4, "http://c\r\nX: y", "é" * 100_000), (5, "u", None), (1, "u", ""), (7, "u", "abc"), (8, "u", "abc"), (None, "u", "same text"), (None, None, None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, owner string")
    out = warc.round_trip(pages, min_bytes=min_bytes).collect()
    assert all(r.error is None and r.digest_ok for r in out)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        low = min((p for p, _, h in rows if (h or "").encode() == raw and p is not None), default=None)
        other = page is not None and low != page and len(raw) >= min_bytes
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", low if other else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_reader_keeps_payloads_and_reports_damage():
    one, two = warc.record(1, "http://x/", b"payload \r\n\r\n bytes", None), warc.record(2, "http://y/", b"payload", 1)
    got = list(warc.read_records(io.BytesIO(one + two), payloads=True))
    assert [r["payload"] for r in got] == [b"payload \r\n\r\n bytes", None]
    assert list(warc.read_records(io.BytesIO(one + two[:-9])))[1]["error"]
    plain = bytearray(zlib.decompress(one, 31))
    plain[-8] ^= 1
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    assert [r["digest_ok"] for r in warc.read_records(io.BytesIO(packer.compress(bytes(plain)) + packer.flush()))] == [False]
    assert list(warc.read_records(io.BytesIO(b""))) == []


# Exact top-k


def brute_top(rows, k, every):
    ok = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % every == 0:
            scores = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [7, 4096])
def test_top_products_equal_brute_force(spark, bucket_rows):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(8) * rng.choice([0.01, 0.3, 1, 20])).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(20)] + [(500 + i, [float(i)] + [0.0] * 7) for i in range(30)]
    rows += [(600, [0.0] * 8), (601, None), (602, [1.0, None] + [0.0] * 6), (603, [float("nan")] * 8), (604, [float("inf")] * 8), (605, []), (None, rows[0][1]), (610, [1.0, 2.0]), (611, [2.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    out = topk.top_products(frame, every=10, bucket_rows=bucket_rows, query_bytes=2000)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()) == brute_top(rows, 10, 10)
    assert topk.top_products(frame.limit(0)).count() == 0


def test_empty_vectors_have_a_product_with_each_other(spark):
    rows = [(0, []), (7, []), (8, [1.0])]
    out = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(0, 1, 7, 0)]


def test_repeated_query_rows_each_get_an_answer(spark):
    """The other row of an id is a candidate: only the query's own row is not."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0])]
    out = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(0, i + 1, i) for i in (0, 1, 2) for _ in "ab"]


# URL filter


def rule_of(host, path):
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def test_rules_and_models(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(i, f"http://{word('spam')}.net/{word('spam')}") for i in range(150)]
    rows += [(200 + i, f"HTTPS://{word('good')}.ORG/fr/{word('good')}") for i in range(150)]
    rows += [(400 + i, f"http://{word('spam')}.test/{word('spam')}") for i in range(40)] + [(500 + i, f"http://{word('good')}.test/x/{word('good')}") for i in range(40)]
    odd = ["http://a.Example.net/en/x?q", "http://example.net/de/", "x://notnet/", "http://net", "http://net/", "no scheme", None, "", "://", "http://example.com/de/#f", "http://xexample.com/de/", "a://b://c/d", "http://h?q=/p", "http://o.org/fr/" + "z" * 100_000]
    rows += [(600 + i, u) for i, u in enumerate(odd)] + [(None, "http://net/"), (600, odd[0])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, verdict string")
    out = urlfilter.judge(pages).collect()
    assert len(out) == len(rows)
    urls = dict(rows)
    for r in out:
        url = urls[r.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (rest[:cut].lower(), path)
        fit = rule_of(r.host, r.path)
        assert r.rule == (fit and fit[0]) and r.verdict in ("allow", "block")
        if fit:
            assert r.verdict == fit[1]
    held = {r.page_id: r.verdict for r in out if r.page_id is not None and 400 <= r.page_id < 600}
    assert np.mean([v == ("block" if i < 500 else "allow") for i, v in held.items()]) > 0.9
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert urlfilter.judge(pages.filter("page_id >= 400 and page_id < 600")).count() == 80


def serial_models(labelled, order=5):
    grams, contexts = {}, {}
    for side, url in labelled:
        text = url + "\0"
        for i in range(len(text)):
            for k in range(min(i, order) + 1):
                before = text[i - k : i]
                grams[side, before, text[i]] = grams.get((side, before, text[i]), 0) + 1
                contexts.setdefault((side, before), []).append(text[i])
    size = {c: (len(x), len(set(x))) for c, x in contexts.items()}

    def score(url):
        text, total = url + "\0", 0.0
        for i in range(len(text)):
            p = [1 / 256, 1 / 256]
            for side in (0, 1):
                for k in range(min(i, order) + 1):
                    n, t = size.get((side, text[i - k : i]), (0, 0))
                    if n:
                        p[side] = (grams.get((side, text[i - k : i], text[i]), 0) + t * p[side]) / (n + t)
            total += np.log(p[0]) - np.log(p[1])
        return total / len(text)

    return score


def test_scores_equal_a_serial_model_of_all_ruled_urls(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "RUN_CHARS", 64)
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    letters = "abcdefghijklmnopqrstuvwxyzéß日0123456789-_"
    urls = [f"http://{word(letters)}.net/{word(letters)}/{word(letters)}" for _ in range(150)] + [f"http://{word(letters)}.org/fr/{word(letters)}" for _ in range(150)]
    urls += [f"http://{word(letters)}.test/{word(letters)}" for _ in range(60)] + ["", None, "a\0b", "x" * 300, "a", urls[0], urls[0]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = urlfilter.judge(pages).collect()
    score = serial_models([(int(r.verdict == "block"), urls[r.page_id]) for r in out if r.rule is not None])
    assert sorted(r.page_id for r in out) == list(range(len(urls)))
    assert max(abs(r.score - score(urls[r.page_id] or "")) for r in out) < 1e-9


# Packing


def test_pieces_hold_the_tokenizer_ids_and_fill_sequences(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    words = ["the", "Cat's", "naïve", "x2-10%", "Straße", "ÉLAN", "don't", "3,14", "«c»", "日本", "<|startoftext|>", "<|endoftext|>", "\t", "\n\n", "a_b$c", "İ", "ß", "e\u0301", "ﬁ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300, 900]))) for _ in range(80)] + [None, "", "  ", "the " * 2600]
    rows = [*enumerate(texts), (None, "the"), (0, "again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    out = packing.pack(docs, capacity=512, with_ids=True).collect()
    want = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want.append((doc, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    check_sequences(out, 512, serial_best_fit([r.length for r in out], 512))
    assert packing.pack(docs.limit(0)).count() == 0


def test_units_give_the_tokenizers_ids_for_any_text():
    rng = random.Random(1)
    letters = "aAbYyJHTWzé ÉÀàß ÿŸ'’-.,!?0123<>=|~^`\u0338\u0331\u030a\u030c\u0308\u0301×÷漢字КиІİıǅﬁ\u200b \n\t _$€😀ẞ"
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    texts += ["Y\u030a", "J\u030c", "H\u0331", "T\u0308", "W\u030a", word, word.translate(str.maketrans("ab", "ba"))]
    coder = packing.Encoder(packing.default_tokenizer())
    assert coder.plain
    raw = [t.encode() for t in texts]
    ids, bounds = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, r in enumerate(raw):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == coder._whole(r)


def check_sequences(out, capacity, at_most):
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(by) <= at_most


def serial_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("rows", [50_000, 60])
@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_give_no_more_sequences_than_a_serial_best_fit(spark, monkeypatch, seed, rows):
    """Also with many ranges, and with a length that a third of the pieces have."""
    monkeypatch.setattr(packing, "SWEEP_ROWS", rows)
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 7, 50, 99, 100, 33, 33, 33, 33, *(rng.randint(1, 100) for _ in range(3))]) for _ in range(rng.randint(300, 500))]
    items = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    placed = packing.best_fit(items, 100).collect()
    assert sorted(r.id for r in placed) == list(range(len(lengths)))
    used = {}
    for r in placed:
        used.setdefault(r.sequence_id, []).append((r.offset, lengths[r.id]))
    for parts in used.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 100
    assert len(used) <= serial_best_fit(lengths, 100)


def test_what_ranges_leave_over_meets_by_rank():
    # (range, documents left, parts left): the last parts left go first
    assert packing.across([(0, 0, 3), (1, 1, 2), (2, 4, 0), (3, 1, 1)]) == [(1, 0, 1, 0, 2), (2, 0, 2, 1, 1), (2, 2, 2, 0, 1)]
