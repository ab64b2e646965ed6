"""Collocations against a serial count of all phrases, and their defined cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import collocations as K


def expected(rows, least, top=2000, percent=100):
    counts, total = Counter(), Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                longer[lang, w[i : i + size]] = max(longer[lang, w[i : i + size]], a)
    out = []
    for (lang, w), a in found.items():
        cuts = [(1000 * a * total[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if 100 * longer[lang, w] < percent * a:
            out.append((lang, score, a, " ".join(w), counts[lang, w[:k]], counts[lang, w[k:]], total[lang]))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))[:top]
        ranked += [(lang, i + 1, phrase, a, left, right, n, score) for i, (_, score, a, phrase, left, right, n) in enumerate(own)]
    return sorted(ranked)


def corpus(seed, size=400):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "naïve", "x", "tab\x1cword", "\xa0", "new", "york", "city", "ab", "abab"]
    phrase = lambda: draw.choice(["new york city", "NEW  york", "of the", "ab ab ab", " ".join(draw.choices(words, k=draw.randint(1, 6)))])
    text = lambda: "".join(phrase() + draw.choice([" ", "\t", "  ", ". ", ",", "\n", "?", " ; ", "\x0b"]) for _ in range(draw.randint(0, 30)))
    return [(draw.choice(["en", "en", "de", None, "und", ""]), text()) for _ in range(size)] + [("en", None), ("xx", ""), (None, "...")]


def made(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")


@pytest.mark.parametrize(("least", "top", "percent", "pass_bytes"), [(20, 2000, 100, 1 << 20), (5, 7, 80, 300)])
def test_collocations_equal_a_serial_count(spark, least, top, percent, pass_bytes):
    rows = corpus(least)
    got = K.mine(made(spark, rows), least=least, top=top, percent=percent, pass_bytes=pass_bytes).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = expected(rows, least, top, percent)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_short_runs_and_narrow_maps_change_nothing(spark, monkeypatch):
    rows = corpus(3, 150) + [("en", "new york " * 30_000)]
    monkeypatch.setattr(K, "MAP_BITS", 1 << 10)
    got = K.mine(made(spark, rows), least=9)
    assert sorted(map(tuple, got.collect())) == expected(rows, 9)


def test_products_beyond_64_bits_are_exact(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("l", "a b", big), ("l", "a", big + 1), ("l", "b", big + 7)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("l", 9 * big)], "lang string, n long")
    row = K.scored(counts, totals, 100).first()
    assert row.score == 1000 * big * 9 * big // ((big + 1) * (big + 7)) and (row.l, row.r) == (big + 1, big + 7)


def test_ties_of_cuts_repeated_rows_and_empty_tables(spark):
    rows = [("en", "p q r")] * 6
    got = K.mine(made(spark, rows).withColumn("rank", F.lit(1)), least=6).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.score) for r in got] == [("p q r", 6, 6, 6, 3000)]
    assert K.mine(made(spark, []), least=6).collect() == [] and K.mine(made(spark, rows), least=7).collect() == []


def test_phrase_hashes_follow_words_not_their_place():
    one, two = K.Words("en", K.normal([b"A b\tc, a b", b"a  b c"])), K.Words("de", K.normal([b"a b c"]))
    h = one.phrases(2)
    assert h[0] == h[3] == h[5] and h[0] != h[1] and two.phrases(2)[0] != h[0]
    assert one.possible(1 << 20, [], 3).tolist() == [True, False, False, False, False, True]
    assert K.Words("en", b"").possible(16, [], 2).tolist() == [] and np.array_equal(K.Words("en", b" ").phrases(3), [])


def test_the_text_is_read_as_often_for_many_phrases_as_for_few(spark):
    rows = corpus(5, 150)
    docs, read = made(spark, rows), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    for least, many in ((3, 300), (60, 1)):
        read.value = 0
        got = K.mine(docs.mapInArrow(seen, docs.schema), least=least, pass_bytes=300)
        want = expected(rows, least)
        assert sorted(map(tuple, got.collect())) == want and len(want) >= many
        assert read.value == 5 * len(rows)


def test_counts_of_a_bucket_are_added_up_a_few_at_a_time(spark, monkeypatch):
    rows = corpus(8, 120)
    monkeypatch.setattr(K, "HELD", 20)
    got = K.mine(made(spark, rows).repartition(5), least=4, pass_bytes=1)
    assert sorted(map(tuple, got.collect())) == expected(rows, 4)
