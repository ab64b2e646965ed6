"""The pipeline's stages on a small table, and the registered queries against their SQL."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from helixframe.llm import packing, queries
from tests.llm.test_minhash import components
from tests.llm.test_records import check_sequences, serial_best_fit
from tests.llm.test_texts import brute_hits, kept_lines, line_owners

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.fixture
def small(spark, tmp_path):
    rng = random.Random(6)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, shared = text(40), "this line is shared by several documents"
    base = text(120)
    rows = [
        (1, base, "de", "a", 1), (2, base + " more", "de", "b", 1), (3, None, "de", "a", None), (4, "12 34", None, None, 5), (5, "", "de", "a", 0),
        (6, shared + "\n" + text(50), "de", "a", 1), (7, text(30) + "\n" + shared, "en", "a", 1), (8, text(10) + " " + passage, "de", "a", 1),
        (9, text(60), None, "a", 1), (9, text(60), "de", "a", 1), (None, text(30), "de", None, 1), (10, text(5000), "de", "a", 1),
    ]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, contaminated string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, str(tmp_path)


def test_stages_take_effect(spark, small):
    docs, folder = small
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            kept.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=repr))
    everything = [1, 10, 2, 6, 7, 8, 9, 9, None]
    assert kept[0] == kept[1] == sorted(everything, key=repr)
    assert kept[2] == sorted([x for x in everything if x != 2], key=repr)
    assert kept[3] == sorted([x for x in everything if x not in (2, 8)], key=repr)
    seven = next(r for r in docs.collect() if r.doc_id == 7)
    assert "shared" not in seven.text and seven.n_chars == len(seven.text)
    assert {r.doc_id for r in out.collect()} == {1, 6, 7, 9, 10, None}


def serial_stages(rows, items):
    """(doc_id, text) that the first four stages keep, by the serial versions of the operators."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    yield rows
    owner = line_owners(rows)
    rows = [(doc, "\n".join(kept_lines(doc, text, owner))) for doc, text in rows]
    yield rows
    # rows of one id and one text share a verdict; components as of all rows
    label = components(rows, 80)
    rows = [r for r, low in zip(rows, label) if low is None or low == r[0]]
    yield rows
    bad = {}
    for r in rows:
        bad[r] = brute_hits([r], items)[0][-1]
    rows = [r for r in rows if not bad[r]]
    yield rows


def test_stages_equal_serial_versions(spark, tmp_path):
    """Nulls, empty and repeated texts and ids, a very long text, and columns with names of our own."""
    from tokenizers import Tokenizer

    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, lines = text(30), [f"a common line of number {i}" for i in range(5)]
    rows = []
    for i in range(60):
        body = text(rng.randint(3, 60))
        if i % 4 == 1 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
            w[rng.randrange(len(w))] = "edited"
            body = " ".join(w)
        if i % 5 == 0:
            body += "\n" + rng.choice(lines) + "\n" + text(8)
        if i % 7 == 0:
            body += " " + passage.upper()
        rows.append((i * 2, body))
    rows += [(500, None), (501, ""), (502, "12 ?"), (4, rows[2][1]), (4, "another text of the same id is here today"), (None, text(20)), (None, rows[0][1]), (503, text(30_000)), (504, lines[0])]
    full = [(*r, "de", "x", "y", 3, [1]) for r in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, _hf_text string, _hf_id string, n_words int, c0 array<int>")
    folder = str(tmp_path)
    spark.createDataFrame([(0, passage), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, serial_stages(rows, [(0, passage), (1, None)])):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(want, key=repr), name
        assert all((r._hf_text, r._hf_id, r.n_words, r.c0) == ("x", "y", 3, [1]) for r in docs.collect())
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = corpus_pipeline.pack(spark, docs, folder).collect()
    sizes = {}
    for doc, text_ in want:
        sizes.setdefault(doc, []).append(len(tokenizer.encode(text_ or "", add_special_tokens=False).ids) + 1)
    assert {d: sum(r.length for r in pieces if r.doc_id == d) for d in sizes} == {d: sum(n) for d, n in sizes.items()}
    check_sequences(pieces, 4096, serial_best_fit([r.length for r in pieces], 4096))


def test_run_and_empty_table(spark, small):
    docs, folder = small
    assert corpus_pipeline.run(spark, folder).count() >= 8
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_near_copies_from_four_fifths_on_are_dropped(spark):
    rng = random.Random(7)
    grams = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    rows, below = [], []
    for pair, (n, edits) in enumerate([(45, 1), (90, 2), (135, 3), (52, 1), (96, 2), (103, 2), (145, 3), (42, 1), (86, 2)]):
        words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
        copy = list(words)
        for e in range(edits):
            copy[6 + 10 * e] = f"x{rng.randrange(10**9)}"
        share = len(grams(words) & grams(copy)) / len(grams(words) | grams(copy))
        assert 0.75 < share < 0.85
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(copy))]
        below += [2 * pair + 1] if share < 0.8 else []
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(below) == 2
    assert sorted(r.doc_id for r in kept) == sorted([i for i, _ in rows if i % 2 == 0] + below)


def test_letters_in_no_language_go_and_clean_texts_stay(spark):
    rng = random.Random(3)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit", "amet", "magna"], "bb": ["wiki", "nuku", "taro", "moana", "kahu", "rangi"]}
    clean = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    junk = lambda n: " ".join("".join(rng.choice("bcdfghjkpqvwxyz") for _ in range(6)) for _ in range(n))
    rows = [(i, clean(lang, rng.randint(30, 60)), lang) for i in range(0, 200) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(1000 + i, clean("aa", 40), None) for i in range(5)] + [(2000 + i, junk(40), None) for i in range(5)] + [(3000, "?!", None), (3001, "ok", None)]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {i for i, *_ in rows if i < 2000 or i == 3001}
