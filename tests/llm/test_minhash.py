import random
import re

import pytest

from helixframe.llm import minhash


def word_sets(rows):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def components(rows, percent=85):
    """component of each row by all-pairs Jaccard on word shingles."""
    sets = word_sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return [None if d is None else low[find(i)] for i, (d, _) in enumerate(rows)]


def brute(rows):
    return sorted(((d, len(s), c) for (d, _), s, c in zip(rows, word_sets(rows), components(rows))), key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, 6)):
            new = list(text)
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(len(new))] = rng.choice(words)
            rows.append(" ".join(new))
    rows += [rows[0]] * 30 + [rows[0].upper(), "", None, " \t\n", "one", "one", "one two three four", "é É ß x y z"]
    rng.shuffle(rows)
    out = [(i * 3, t) for i, t in enumerate(rows)]
    return out + [(None, rows[0]), (0, "a repeated id with another text altogether now"), (3, rows[1]), (3, rows[1])]


@pytest.mark.parametrize("chunk", [1 << 19, 2000])
def test_components_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(minhash, "SALT", 3)
    monkeypatch.setattr(minhash, "SMALL", 4 if chunk > 2000 else 2)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    out = minhash.near_duplicates(docs).collect()
    # rows that repeat an id are apart in the brute force, but share the id's smallest label here too
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in out)


def checked(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)
    return len({c for _, _, c in got})


@pytest.mark.parametrize("chunk", [1 << 19, 3000])
def test_large_bucket_of_different_texts(spark, monkeypatch, chunk):
    """A chain of texts, each near its neighbours only, in crowded buckets."""
    monkeypatch.setattr(minhash, "CHUNK_BYTES", chunk)
    words = [f"v{i}" for i in range(400)]
    checked(spark, [(i, " ".join(words[i * 3 : i * 3 + 120])) for i in range(60)])


def test_large_group_of_near_copies(spark):
    """One base with many edited copies: most link with it, some with each other only, some with none."""
    rng = random.Random(7)
    base = [f"base{i}" for i in range(110)]
    rows = []
    for i in range(150):
        text = list(base[: rng.choice([110, 110, 96, 80])])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            text[rng.randrange(len(text))] = f"other{rng.randrange(30)}"
        rows.append((i, " ".join(text)))
    assert 1 < checked(spark, rows) < 120


def test_bucket_of_low_entropy(spark):
    """Texts of very few words, so that many unlike texts share bands."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ab", "cd"]) for _ in range(rng.randint(5, 60)))) for i in range(120)]
    checked(spark, rows)


def test_very_long_texts_and_words(spark):
    rng = random.Random(5)
    long = [rng.choice("abcdefgh") * rng.randint(1, 12) for _ in range(60_000)]
    near = list(long)
    for i in range(0, 60_000, 2000):
        near[i] = "changed"
    one = "x" * 3_000_000
    checked(spark, [(1, " ".join(long)), (2, " ".join(near)), (3, one), (4, one), (5, one + "y"), (6, " ".join(reversed(long)))])


def test_words_that_polynomial_hashes_confuse(spark):
    """A Thue-Morse word and its complement agree under every polynomial hash modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    assert checked(spark, [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "a b c d"), (4, "a b c d e")]) == 4


def test_recall_of_links_at_the_threshold(spark):
    """Pairs that share just over 85 % of their shingles are found."""
    rows = []
    for i in range(300):
        words = [f"t{i}_{j}" for j in range(104)]
        other = list(words)
        other[50] = "else"
        other[-1] = "also"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert checked(spark, rows) == 300


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_jaccard():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    s = minhash.signatures([a, b], 480)
    assert abs((s[0] == s[1]).mean() - 1800 / 2200) < 0.08
