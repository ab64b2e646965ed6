"""Toxicity severity by cumulative-link ordinal regression on sparse words.

One weight vector is shared by all grades; ordered thresholds cut its score
into grades: P(grade <= k) = sigmoid(threshold_k - weights . words).  A text's
severity is its expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import span_keys, utf8_runs
from helixframe.llm.decontam import normalise

#: Words are hashed to this many bits.
BITS = 20
#: A word gets a weight if at least so many sampled texts have it,
MIN_TEXTS = 8
#: and if the grades of its texts pull it this many standard deviations from 0: of 2**20
#: words without a bearing on the grade less than one in a hundred runs gets that far.
DEVIATIONS = 6.0
#: Labelled texts of one grade that are learned from, at most.
SAMPLE = 6000
RUN_BYTES = 1 << 20


def word_slots(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every word of each text."""
    norm, first, of = normalise(data, off)
    gaps = np.append(np.flatnonzero(norm == 0x20), len(norm))
    h = span_keys(norm, first, gaps[np.searchsorted(gaps, first)])
    return np.repeat(np.arange(len(off) - 1), np.diff(of)), (h >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_slots(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) pairs without repeats, only slots that are ``wanted`` if given."""
    row, slot = word_slots(data, off)
    if wanted is not None:
        some = wanted[slot]
        row, slot = row[some], slot[some]
    key = np.unique((row << BITS) | slot)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Ordinal:
    """Weights by slot and thresholds between the grades ``grades``."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def score(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.weights[slot], n) if len(row) else np.zeros(n)


def fit(row: np.ndarray, slot: np.ndarray, grade: np.ndarray, weight: np.ndarray, *, penalty: float = 1e-3, steps: int = 300,
        min_texts: int = MIN_TEXTS, deviations: float = DEVIATIONS) -> Ordinal:
    """Maximise the weighted likelihood of the grades, by gradient steps of adapted size.

    Only words in ``min_texts`` texts whose gradient at the start is ``deviations``
    standard deviations from 0 take part.
    """
    grades, y = np.unique(grade, return_inverse=True)
    n, k = len(grade), len(grades) - 1
    model = Ordinal(grades, np.zeros(1 << BITS), np.zeros(max(k, 0)))
    if k < 1:
        return model
    weight = weight / weight.sum()
    texts = np.bincount(slot, minlength=1 << BITS)
    mean = np.array([weight[y <= j].sum() for j in range(k)])
    edge = np.concatenate([[0.0], mean, [1.0]])
    pull = edge[y] + edge[y + 1] - 1  # of the score, before any weight is learned
    sums, each = np.bincount(slot, (weight * pull)[row], 1 << BITS), ((weight * pull) ** 2).mean()
    used = np.flatnonzero((texts >= min_texts) & (np.abs(sums) >= deviations * np.sqrt(texts * each)))
    column = np.full(1 << BITS, -1)
    column[used] = np.arange(len(used))
    keep = column[slot] >= 0
    row, col = row[keep], column[slot[keep]]
    share = 1 - mean
    start = -np.log(share / (1 - share))
    # thresholds: the first one and the logarithms of the steps to the next
    cuts = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    w = np.zeros(len(used))
    theta = np.concatenate([w, cuts])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, cuts = theta[: len(used)], theta[len(used) :]
        t = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
        score = np.bincount(row, w[col], n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi = 1 / (1 + np.exp(-np.clip(edge[y + 1] - score, -40, 40)))
        lo = 1 / (1 + np.exp(-np.clip(edge[y] - score, -40, 40)))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_score = weight * (dlo - dhi)
        g_w = np.bincount(col, by_score[row], len(used)) - penalty * w
        g_t = np.array([(weight * (dhi * (y == j) - dlo * (y == j + 1))).sum() for j in range(k)])
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * np.exp(cuts[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, cuts = theta[: len(used)], theta[len(used) :]
    model.weights[used] = w
    model.thresholds = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, off in utf8_runs(batch.column("text"), RUN_BYTES):
            row, slot = distinct_slots(data, off)
            at = np.searchsorted(row, np.arange(end - start + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(slot, pa.int32()))
            names = ["grade", "weight", "held"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, end - start) for c in names), lists], [*names, "slots"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, min_texts: int = MIN_TEXTS, deviations: float = DEVIATIONS) -> Ordinal:
    """Learn from labelled texts (docs: doc, text; labels: doc, grade).

    Of each grade the ``sample`` rows with the smallest hash of their id are
    taken, weighted by how many rows of the grade there are; a fifth of them is
    held out to calibrate the cut between the lowest grade and the others: the
    one with the best weighted F1.  ``min_texts`` and ``deviations`` say which
    words get a weight (see :func:`fit`); the sample's word slots reach the driver.
    """
    clean = labels.filter("doc is not null and grade is not null")
    counts = {r["grade"]: r["count"] for r in clean.groupBy("grade").count().collect()}
    chosen = None
    for grade, n in sorted(counts.items()):
        part = clean.filter(F.col("grade") == grade).orderBy(F.xxhash64("doc"), "doc").limit(sample)
        part = part.withColumn("weight", F.lit(n / min(n, sample)))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return Ordinal(np.zeros(1, np.int64), np.zeros(1 << BITS), np.zeros(0))
    chosen = chosen.withColumn("held", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(5)) == 0)
    # at most ``sample`` rows a grade
    texts = docs.join(F.broadcast(chosen), "doc").select("grade", "weight", "held", F.coalesce("text", F.lit("")).alias("text"))
    got = texts.mapInArrow(_features, "grade int, weight double, held boolean, slots array<int>").toArrow()
    grade, weight, held = (got.column(c).to_numpy() for c in ("grade", "weight", "held"))
    lists = [c for c in got.column("slots").chunks if len(c)]
    none = np.zeros(0, np.int32)
    slot = np.concatenate([c.flatten().to_numpy() for c in lists] or [none]).astype(np.int64)
    row = np.repeat(np.arange(len(grade)), np.concatenate([c.value_lengths().to_numpy() for c in lists] or [none]))
    learn = ~held if (~held).any() else np.ones(len(grade), bool)
    place = np.cumsum(learn) - 1
    mine = learn[row] if len(row) else np.zeros(0, bool)
    model = fit(place[row[mine]], slot[mine], grade[learn], weight[learn], min_texts=min_texts, deviations=deviations)
    if held.any() and len(model.thresholds):
        p = model.above(model.score(row, slot, len(grade)))[:, 0][held]
        bad, w = grade[held] > model.grades[0], weight[held]
        turn = np.argsort(-p)
        hit = np.cumsum((w * bad)[turn])
        f1 = 2 * hit / (np.cumsum(w[turn]) + max((w * bad).sum(), 1e-9))
        best = int(f1.argmax())
        below = p[turn][best + 1] if best + 1 < len(p) else 0.0
        model.cut = float((p[turn][best] + below) / 2)
    return model


def assess(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
           grade_col: str = "grade", sample: int = SAMPLE, min_texts: int = MIN_TEXTS, deviations: float = DEVIATIONS) -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic`` of every row.

    ``severity`` is the expected grade, ``grade`` the likeliest (of equal ones
    the lowest), ``toxic`` whether P(above the lowest grade) reaches the calibrated cut.  Null and
    empty texts have no words: their severity is that of the thresholds alone,
    and they are not toxic.  Labels with a null id or grade are not learned;
    with fewer than two grades every severity is that grade (0 without labels)
    and nothing is toxic.  Repeated rows are assessed alike; other columns are
    ignored.  No shuffle but that of the labels.
    """
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(label_id).alias("doc"), F.col(grade_col).cast("int").alias("grade"))
    held = docs.sparkSession.sparkContext.broadcast(train(slim, marks, sample=sample, min_texts=min_texts, deviations=deviations))
    kind = slim.schema["doc"].dataType.simpleString()

    def run(batches):
        model = held.value
        wanted = model.weights != 0
        for batch in batches:
            for start, end, data, off in utf8_runs(batch.column(1), RUN_BYTES):
                n = end - start
                row, slot = distinct_slots(data, off, wanted)
                above = model.above(model.score(row, slot, n))
                edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
                each = edge[:, :-1] - edge[:, 1:]
                p = above[:, 0] if above.shape[1] else np.zeros(n)
                some = np.bincount(row, minlength=n) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array(each @ model.grades.astype(float)),
                     pa.array(model.grades[each.argmax(1)].astype(np.int32)), pa.array(p),
                     pa.array(some & (p >= model.cut) & (above.shape[1] > 0))],
                    ["doc_id", "severity", "grade", "p_toxic", "toxic"],
                )

    return slim.mapInArrow(run, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean")
