"""Line dedup, decontamination, language ID and toxicity on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from helixframe.llm import decontam, langid, linededup, toxicity

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Line dedup


def key(line):
    return lower(line.strip(SPACE))


def line_owners(rows):
    owner = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                owner[key(line)] = min(doc, owner.get(key(line), doc))
    return owner


def kept_lines(doc, text, owner):
    return [x for x in (text or "").split("\n") if doc is None or len(key(x)) < 10 or owner[key(x)] == doc]


def brute_lines(rows):
    owner = line_owners(rows)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = kept_lines(doc, text, owner)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_lines_equal_brute_force(spark, batches):
    rng = random.Random(batches)
    pool = [f"line number {i} " + "é" * (i % 3) for i in range(40)] + ["short", "", "  padded line here\t", "PADDED line here", "exactly10c", "\x0bexactly10c", "é" * 9, "é" * 10]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, "line number 1 é"), (70, None), (71, ""), (5, "exactly10c\nline number 2 éé"), (72, "\n\n"), (73, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_lines int")
    out = linededup.dedup_lines(docs, batches=batches, fanout=2).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out), key=repr) == brute_lines(rows)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


# Decontamination


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            b = words(body)
            k = min(13, len(b))
            windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 200])
def test_hits_equal_brute_force(spark, pass_bytes):
    rng = random.Random(2)
    vocabulary = ["a", "b", "ab", "Été", "x9", "lorem", "ipsum", "dolor"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ", "]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((1, 2, 3, 5, 12, 13, 14, 30, 60))] + [(20, ""), (21, None), (22, " .,"), (None, text(15)), (7, text(16))]
    docs = []
    for i in range(50):
        body = text(rng.randint(0, 60))
        if i % 3 == 0:
            body += " " + items[rng.randrange(9)][1].upper() + " " + text(rng.randint(0, 40))
        docs.append((i, body))
    docs += [(None, items[7][1]), (60, None), (61, ""), (62, "--"), (3, items[8][1]), (63, "zz " * 20_000 + items[8][1])]
    left = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, items string")
    right = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    out = decontam.contamination(left, right, pass_bytes=pass_bytes).collect()
    assert sorted((tuple(r[c] for c in names) for r in out), key=repr) == brute_hits(docs, items)
    assert decontam.contamination(left, right.limit(0)).filter("contaminated or n_hit > 0").count() == 0
    assert decontam.contamination(left.limit(0), right).count() == 0


# Language ID


LANGUAGES = {"aa": "abcde", "bb": "cdefg", "cc": "éàüöß"}


def spoken(rng, lang, n=30):
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_language_profiles_tell_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, spoken(rng, lang), lang) for i, lang in enumerate(rng.choice(list(LANGUAGES)) for _ in range(300))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 ?!", "bb"), (None, spoken(rng, "aa"), "aa"), (903, spoken(rng, "bb"), None), (904, spoken(rng, "cc", 40_000), "cc")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (900, 901, 902))
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def serial_profiles(rows):
    """(language, cosine) of each text by dictionaries of trigrams and vectors one by one."""
    letters = np.random.default_rng(langid.SEED).integers(0, 2, (langid.CLASSES, langid.DIMENSIONS), np.int8) * 2 - 1

    def bundle(text):
        classes = [0]
        for c in (text or "").lower():
            k = ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (langid.CLASSES - 27) if c.isalpha() else 0
            if k or classes[-1]:
                classes.append(k)
        if classes[-1]:
            classes.append(0)
        out = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(classes, classes[1:], classes[2:]):
            if b:
                out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    unit = lambda x: x / max(np.linalg.norm(x), 1e-9)
    sums = {}
    for doc, text, lang in rows:
        if lang is not None and not (doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2):
            sums[lang] = sums.get(lang, 0) + bundle(text)
    mean = sum(unit(x) for x in sums.values()) / len(sums)
    prototypes = {lang: unit(unit(x) - mean) for lang, x in sums.items()}
    out = []
    for _, text, _ in rows:
        if not any(c.isalpha() for c in (text or "").lower()):
            out.append(("und", 0.0))
        else:
            v = unit(bundle(text))
            best = max(sorted(prototypes), key=lambda lang: float(v @ prototypes[lang]))
            out.append((best, min(1.0, max(0.0, float(v @ prototypes[best])))))
    return out


def test_language_profiles_equal_a_serial_version(spark):
    rng = random.Random(8)
    rows = [(i, spoken(rng, lang, rng.randint(1, 8)), lang) for i, lang in enumerate(rng.choice(list(LANGUAGES)) for _ in range(80))]
    rows += [(90, "Ab!!c  Dé 漢字", "aa"), (90, "Ab!!c  Dé 漢字", "aa"), (91, "?", "bb"), (None, "aBc", "bb"), (92, None, "cc")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)).collect()
    for r, (lang, score) in zip(out, serial_profiles(rows), strict=True):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-5
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    rng = random.Random(4)
    rows = [(i, spoken(rng, lang), lang) for i, lang in enumerate(rng.choice(list(LANGUAGES)) for _ in range(120))]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    kind = "doc_id long, text string, lang string"
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(x, kind)).collect()} for x in (rows, wrong))
    assert a == b
    nothing = langid.identify(spark.createDataFrame([(1, "abc", None)], kind)).collect()[0]
    assert (nothing.lang_pred, nothing.score) == ("und", 0)


# Toxicity


def test_severity_follows_planted_words(spark):
    rng = random.Random(3)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        grade = rng.choice([0, 0, 0, 1, 2])
        w = [rng.choice(clean) for _ in range(40)] + {0: [], 1: ["mild", "rude"], 2: ["vile", "rude"]}[grade]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, grade))
    rows += [(None, "vile rude"), (5000, None), (5001, ""), (5002, "vile rude " * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, grade int")
    marks = spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, grade int")
    out = {r.doc_id: r for r in toxicity.assess(docs, marks).collect()}
    bad = {i for i, t in rows if t and "rude" in t}
    assert {i for i, r in out.items() if r.toxic} == bad
    assert np.mean([out[i].severity for i, t in rows if t and "vile" in t]) > np.mean([out[i].severity for i, t in rows if t and "mild" in t]) > 0.5
    assert toxicity.assess(docs, marks.limit(0)).filter("toxic or severity <> 0").count() == 0
    assert toxicity.assess(docs.limit(0), marks).count() == 0


def likelihood(w, cuts, row, col, grade, weight, penalty):
    score = np.bincount(row, w[col], len(grade))
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    p = 1 / (1 + np.exp(-(edge[grade + 1] - score))) - 1 / (1 + np.exp(-(edge[grade] - score)))
    return (weight / weight.sum() * np.log(p)).sum() - penalty / 2 * (w * w).sum()


def test_fit_is_a_maximum_of_the_likelihood():
    """No step in any weight or threshold of a small model makes the penalised likelihood larger."""
    rng = np.random.default_rng(5)
    n, words = 600, 5
    has = rng.random((n, words)) < 0.4
    latent = has @ np.array([2.0, -1.0, 0.5, 0.0, 1.0]) + rng.logistic(size=n)
    grade = np.digitize(latent, [1.0, 2.5])
    row, col = np.nonzero(has)
    slot = (col + 1) * 1000
    weight = np.where(grade == 0, 2.0, 1.0)
    model = toxicity.fit(row, slot, grade, weight, steps=3000, min_texts=1, deviations=0.0)
    w, cuts = model.weights[(np.arange(words) + 1) * 1000], model.thresholds
    best = likelihood(w, cuts, row, col, grade, weight, 1e-3)
    for i in range(words + 2):
        for step in (-0.05, 0.05):
            w2, c2 = w.copy(), cuts.copy()
            if i < words:
                w2[i] += step
            else:
                c2[i - words] += step
            assert likelihood(w2, c2, row, col, grade, weight, 1e-3) < best
    p = model.above(model.score(row, slot, n))
    edge = 1 / (1 + np.exp(cuts[None, :] - np.bincount(row, w[col], n)[:, None]))
    assert np.allclose(p, edge)


def test_severity_of_repeated_rows_and_rare_words(spark):
    rows = [(i, "vile " * (i % 2) + f"only{i} text") for i in range(60)] + [(1, "vile only1 text"), (3, "vile only3 text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, grade int")
    out = toxicity.assess(docs, marks, deviations=3.0).collect()
    assert len(out) == 62 and all(r.toxic == (r.doc_id % 2 == 1) for r in out)
    assert len({(r.severity, r.p_toxic) for r in out if r.doc_id == 3}) == 1
