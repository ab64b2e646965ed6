"""Language identification with hyperdimensional n-gram profiles.

Every letter class has a random vector of +1 and -1.  A letter trigram is the
product of its letters' vectors, permuted (shifted circularly) by their place;
a text is the sum of its trigram vectors, and a language the sum over its
labelled texts.  A text gets the language whose prototype has the largest
cosine with its own vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import utf8_runs

DIMENSIONS = 1024
#: Letter classes: 0 is all but letters, a to z have their own, others share by code point.
CLASSES = 64
RUN_BYTES = 1 << 18
SEED = 404
UNKNOWN = "und"


_ASCII = np.array([27 + c % (CLASSES - 27) if chr(c).isalpha() else 0 for c in range(128)], np.uint8)
_ASCII[ord("a") : ord("z") + 1] = np.arange(1, 27)


def letter_classes(text: str) -> np.ndarray:
    """Class of each character in lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _ASCII[np.minimum(points, 127)]
    high = np.flatnonzero(points > 127)
    if len(high):
        distinct, at = np.unique(points[high], return_inverse=True)
        out[high] = np.array([27 + c % (CLASSES - 27) if chr(c).isalpha() else 0 for c in distinct.tolist()], np.uint8)[at]
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) over letters and word edges; runs of other characters are one edge."""
    codes = [letter_classes(t) for t in texts]
    row = np.repeat(np.arange(len(codes)), [len(c) + 2 for c in codes])
    x = np.zeros(len(row), np.int64)
    if len(row):
        lens = np.array([len(c) for c in codes])
        heads = np.cumsum(lens + 2) - lens - 2
        inside = np.ones(len(row), bool)
        inside[heads] = inside[heads + lens + 1] = False
        x[inside] = np.concatenate(codes)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0) | (row[1:] != row[:-1])
    x, row = x[keep], row[keep]
    code = (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]
    fits = (row[:-2] == row[2:]) & (x[1:-1] != 0)
    key = np.sort((row[:-2] * CLASSES**3 + code)[fits])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    return key[first] // CLASSES**3, key[first] % CLASSES**3, np.diff(np.append(first, len(key)))


def vectors(code: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of trigrams: shifted by two, one and no places, multiplied."""
    letters = np.random.default_rng(SEED).integers(0, 2, (CLASSES, dimensions), np.int8) * 2 - 1
    a, b, c = code // CLASSES**2, code // CLASSES % CLASSES, code % CLASSES
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


@dataclass
class Profiles:
    """Unit prototypes, one row for each language."""

    languages: list[str]
    prototypes: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its cosine, cut to 0..1."""
        row, code, count = trigrams(texts)
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not len(row) or not self.languages:
            return out, score
        used, column = np.unique(code, return_inverse=True)
        has = np.bincount(row, minlength=len(texts)) > 0
        for lo in range(0, len(texts), 256):
            hi = min(lo + 256, len(texts))
            part = slice(*np.searchsorted(row, [lo, hi]))
            r, c, n = row[part] - lo, column[part], count[part]
            bundle = np.zeros((hi - lo, self.prototypes.shape[1]), np.float32)
            order = np.argsort(c, kind="stable")
            r, c, n = r[order], c[order], n[order]
            for first in range(0, len(used), 4096):
                at = slice(*np.searchsorted(c, [first, first + 4096]))
                seen, place = np.unique(c[at], return_inverse=True)
                counts = np.zeros((hi - lo, len(seen)), np.float32)
                counts[r[at], place] = n[at]
                bundle += counts @ vectors(used[seen], bundle.shape[1]).astype(np.float32)
            norm = np.linalg.norm(bundle, axis=1, keepdims=True)
            cosine = (bundle / np.maximum(norm, 1e-9)) @ self.prototypes.T
            for i, best in enumerate(cosine.argmax(1).tolist(), lo):
                if has[i]:
                    out[i], score[i] = self.languages[best], min(1.0, max(0.0, float(cosine[i - lo, best])))
        return out, score


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else False for i in ids], bool)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of one partition."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs):
            part = batch.column("text").filter(pa.array(langs == lang))
            sums = total.setdefault(lang, np.zeros(CLASSES**3, np.int64))
            for start, end, _, _ in utf8_runs(part, RUN_BYTES):
                _, code, count = trigrams(part.slice(start, end - start).to_pylist())
                sums += np.bincount(code, count, CLASSES**3).astype(np.int64)
    for lang, sums in total.items():
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())],
            ["lang", "code", "n"],
        )


def train(labelled: DataFrame, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes from all labelled rows (lang, text).

    Partitions sum their trigram counts, Spark sums those; the driver sees at
    most ``CLASSES``**3 numbers a language, however many texts there are.  The
    mean of the languages' unit vectors is taken off, which leaves what tells
    them apart.
    """
    rows = labelled.select("lang", F.coalesce("text", F.lit("")).alias("text")).filter("lang is not null")
    sums = rows.mapInArrow(_tally, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    languages = sorted(got["lang"].unique())
    prototypes = np.zeros((len(languages), dimensions))
    for i, lang in enumerate(languages):
        part = got[got["lang"] == lang]
        for lo in range(0, len(part), 4096):
            step = part.iloc[lo : lo + 4096]
            prototypes[i] += step["n"].to_numpy(float) @ vectors(step["code"].to_numpy(), dimensions)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    if len(languages) > 1:
        prototypes -= prototypes.mean(0)
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    return Profiles(languages, prototypes.astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, without a shuffle.

    With ``keep`` all columns of ``docs`` stay and the last three are added.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    own = ("held_out", "lang_pred", "score")
    slim = docs.drop(*(c for c in own if c not in (id_col, text_col))) if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_name, text_name = (id_col, text_col) if keep else ("doc_id", "text")
    names = slim.columns if keep else ["doc_id"]

    def run(batches):
        for batch in batches:
            ids, text = batch.column(id_name), batch.column(text_name)
            langs, scores = [], []
            for start, end, _, _ in utf8_runs(text, RUN_BYTES):
                part = [t or "" for t in text.slice(start, end - start).to_pylist()]
                lang, score = held.value.predict(part)
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(held_out(ids.to_pylist())), pa.array(langs, pa.string()),
                 pa.array(np.concatenate(scores or [np.zeros(0)]))],
                [*names, "held_out", "lang_pred", "score"],
            )

    added = [T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return slim.mapInArrow(run, T.StructType([*(slim.schema[c] for c in names), *added]))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict every row.

    A row is held out if crc32 of its id, as text, has the remainder 2 modulo 4;
    a null id is not held out.  Texts that are null or have no letter get
    ``und`` with score 0, as do all rows where no row is labelled; a null
    language is not learned.  Of languages with equal cosines the first by name
    is given.  Repeated rows are learned as often as they occur and predicted
    alike; other columns are ignored.  With ``keep`` the added columns take the
    place of columns of the same name.
    """
    out = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2
    learn = docs.filter(F.col(lang_col).isNotNull() & ~F.coalesce(out, F.lit(False)))
    profiles = train(learn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    return predict(docs, profiles, id_col=id_col, text_col=text_col, keep=keep)
