"""Benchmark decontamination by Wu-Manber multi-pattern search.

Documents and test items are normalised to words joined by one space; every
window of 13 item words becomes a byte pattern.  A block shift table skips
positions at which no pattern can end, buckets by suffix hash select the
patterns to try, and a direct comparison confirms each occurrence.  Many places
of a text are searched in lock step, so that a skip is one array operation.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import byte_words, free_prefix, per_row, span_keys, utf8_runs

WINDOW = 13
RUN_BYTES = 1 << 19
LANE = 2048
SPACE = 0x20
#: Patterns under this length are searched apart, as they allow small skips only.
SHORT = 24
#: Bytes of test items that one broadcast may hold; more make further passes.  A worker's tables take some ten times as much.
PASS_BYTES = 4 << 20


def _folded() -> np.ndarray:
    """Byte map: digits, letters (lower case) and non-ASCII stay, the rest is a space."""
    table = np.full(256, SPACE, np.uint8)
    for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[lo : hi + 1] = np.arange(lo, hi + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


FOLDED = _folded()


def normalise(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space, a space at either end of each text.

    Two spaces lie between texts, which no pattern has: matches never cross.
    Returns the bytes, the start of every word, and each text's first word.
    """
    n = len(off) - 1
    lens = np.diff(off)
    wide = np.full(len(data) + 2 * n, SPACE, np.uint8)
    heads = off[:-1] + 2 * np.arange(n)
    wide[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, lens)] = FOLDED[data]
    blank = wide == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[heads] = True
    starts = np.cumsum(keep)[heads] - 1
    out = wide[keep]
    word = out != SPACE
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    return out, first, np.searchsorted(first, np.append(starts, len(out)))


class WuManber:
    """Shift and bucket tables for byte patterns of one length class."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 6, bits: int = 18):
        """The patterns are the ``size`` bytes of ``data`` from each ``start`` on."""
        self.data, self.start, self.size = data.tobytes(), start, size
        self.m = m = int(size.min())
        self.block = b = min(block, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - b + 1, np.int32)
        for j in range(m - b + 1):
            last = self._slot(byte_words(data, start + j))
            np.minimum.at(self.shift, last, m - b - j)
        order = np.argsort(last, kind="stable")
        self.order = order
        self.slots, self.begin = np.unique(last[order], return_index=True)
        self.until = np.append(self.begin[1:], len(order))
        self.prefix_mask = np.uint64((1 << (8 * min(8, m))) - 1)
        self.prefix = byte_words(data, start) & self.prefix_mask

    def _slot(self, word: np.ndarray) -> np.ndarray:
        return (((word & self.mask) * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern number of every occurrence."""
        none = np.zeros(0, np.int64)
        span = len(text) - self.m + 1
        if span <= 0:
            return none, none
        raw = np.concatenate([text, np.zeros(8, np.uint8)])
        at8 = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        s = np.arange(0, span, LANE)
        end = np.minimum(s + LANE, span)
        found, slots = [], []
        while len(s):
            slot = self._slot(at8[s + (self.m - self.block)])
            step = self.shift[slot]
            zero = step == 0
            found.append(s[zero])
            slots.append(slot[zero])
            s = s + np.maximum(step, 1)
            alive = s < end
            s, end = s[alive], end[alive]
        s, slot = np.concatenate(found), np.concatenate(slots)
        k = np.searchsorted(self.slots, slot)
        k[k == len(self.slots)] = 0
        real = self.slots[k] == slot
        s, k = s[real], k[real]
        count = self.until[k] - self.begin[k]
        s = np.repeat(s, count)
        nth = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
        p = self.order[np.repeat(self.begin[k], count) + nth]
        same = (at8[s] & self.prefix_mask) == self.prefix[p]
        s, p = s[same], p[same]
        whole, data = text.tobytes(), self.data
        places = zip(s.tolist(), self.start[p].tolist(), self.size[p].tolist())
        ok = np.fromiter((whole[i : i + n] == data[j : j + n] for i, j, n in places), bool, len(s))
        return s[ok], p[ok]


class Matcher:
    """All windows of a set of items, with the items that each window belongs to."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        raw = [(text or "").encode() for _, text in items]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data, first, of = normalise(np.frombuffer(b"".join(raw), np.uint8), off)
        words = np.diff(of)
        count = np.where(words > 0, np.maximum(words - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), count)
        w = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + of[item]
        span = np.minimum(words[item], window)
        gaps = np.flatnonzero(data == SPACE)
        # a window with the space before it and the one behind it
        start, end = first[w] - 1, gaps[np.searchsorted(gaps, first[w + span - 1])] + 1 if len(w) else w
        keys = [span_keys(data, start[i : i + 50_000], end[i : i + 50_000]) for i in range(0, len(w), 50_000)]
        _, one, window_of = np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)]), return_index=True, return_inverse=True)
        self.words = span[one]
        named = np.array([i is not None for i, _ in items], bool)[item] if len(item) else np.zeros(0, bool)
        pairs = np.unique(np.stack([window_of[named], item[named]], 1), axis=0) if named.any() else np.zeros((0, 2), np.int64)
        self.names = [i for i, _ in items]
        self.owner, self.of = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
        start, size = start[one], (end - start)[one]
        self.parts = []
        for ids in (np.flatnonzero(size < SHORT), np.flatnonzero(size >= SHORT)):
            if len(ids):
                self.parts.append((ids, WuManber(data, start[ids], size[ids])))

    def owners(self, pattern: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.of[pattern] : self.of[pattern + 1]].tolist()]

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(s, ids[p]) for ids, part in self.parts for s, p in [part.search(text)]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([s for s, _ in found]), np.concatenate([p for _, p in found])


_MATCHER: list[tuple[str, Matcher]] = []


def matcher_of(held, name: str, window: int) -> Matcher:
    """The tables of a broadcast list of items; a worker builds them once and keeps the last."""
    if not _MATCHER or _MATCHER[0][0] != name:
        _MATCHER[:] = [(name, Matcher(held.value, window))]
    return _MATCHER[0][1]


def _spans(hit: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.tolist()


def _scan(batches: Iterator[pa.RecordBatch], held, name: str, window: int, own: str) -> Iterator[pa.RecordBatch]:
    """Adds what one pass finds to the columns whose names begin with ``own``."""
    found = matcher_of(held, name, window)
    for batch in batches:
        old = {c: batch.column(own + c).to_pylist() for c in ("spans", "items")}
        n_words, spans, items = [], [], []
        for start, end, data, off in utf8_runs(batch.column(f"{own}text"), RUN_BYTES):
            norm, first, of = normalise(data, off)
            s, p = found.search(norm)
            w = np.searchsorted(first, s + 1)
            edge = np.zeros(len(first) + 1, np.int64)
            np.add.at(edge, w, 1)
            np.add.at(edge, w + found.words[p], -1)
            hit = np.cumsum(edge[:-1]) > 0
            doc = np.searchsorted(of, w, "right") - 1
            pairs = np.unique(doc * len(found.words) + p) if len(p) else p
            mine: dict[int, set] = {}
            for x in pairs.tolist():
                d, q = divmod(x, len(found.words))
                mine.setdefault(d, set()).update(found.owners(q))
            n_words += np.diff(of).tolist()
            touched = per_row(hit, of)
            for d in range(end - start):
                now = _spans(hit[of[d] : of[d + 1]]) if touched[d] else []
                spans.append([*(old["spans"][start + d] or []), *now])
                items.append(sorted({*(old["items"][start + d] or []), *mine.get(d, ())}))
        put = {
            f"{own}words": pa.array(n_words, pa.int64()),
            f"{own}spans": pa.array(spans, pa.list_(pa.int64())),
            f"{own}items": pa.array(items, pa.list_(pa.string())),
        }
        yield pa.RecordBatch.from_arrays([put.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)


def _report(batches: Iterator[pa.RecordBatch], keep: list[str], share: int, own: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, digests = [], []
        for spans, items in zip(batch.column(f"{own}spans").to_pylist(), batch.column(f"{own}items").to_pylist()):
            total, reach = 0, 0
            for lo, hi in sorted(zip(spans[::2], spans[1::2])):
                total += max(0, hi - max(lo, reach))
                reach = max(reach, hi)
            hits.append(total)
            digests.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        hit = np.array(hits, np.int64)
        words = batch.column(f"{own}words").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in keep),
                pa.array(words, pa.int64()),
                pa.array(hit),
                pa.array([len(x) for x in batch.column(f"{own}items").to_pylist()], pa.int64()),
                batch.column(f"{own}items"),
                pa.array(digests, pa.string()),
                pa.array((hit > 0) & (share * hit >= words)),
            ],
            [*keep, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20,
                  pass_bytes: int = PASS_BYTES, keep: bool = False) -> DataFrame:
    """Words of each document inside any window of a benchmark item.

    Returns one row per input row: the id, ``n_words``, ``n_hit``, ``n_items``,
    ``items`` (sorted ids, as strings), ``items_sha256`` and ``contaminated``
    (``n_hit > 0 and share * n_hit >= n_words``); with ``keep`` all columns of
    ``docs`` in place of the id.

    Null and empty texts have no words and are not contaminated.  An item
    without words has no window; an item with a null id hits words but is not
    listed.  Repeated rows are judged one by one, other columns are ignored.
    No shuffle takes place.  The items' texts are broadcast in passes of about
    ``pass_bytes`` bytes, and the tables are built where they are used; a large
    benchmark makes more passes over the documents, not a larger broadcast.
    With ``keep`` the added columns take the place of columns of the same name.
    """
    spark = docs.sparkSession
    if window < 1:
        raise ValueError("window must be at least 1")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    added = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
    mine = [c for c in docs.columns if c not in added] if keep else [id_col]
    own = free_prefix(docs.columns)
    out = docs.select(
        *mine,
        F.col(text_col).alias(f"{own}text"),
        F.lit(0).cast("long").alias(f"{own}words"),
        F.lit(None).cast("array<bigint>").alias(f"{own}spans"),
        F.lit(None).cast("array<string>").alias(f"{own}items"),
    )
    schema = T.StructType(
        [*(docs.schema[c] for c in mine), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
         T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
         T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    )
    for i in range(passes):
        part = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i)
        held, name = spark.sparkContext.broadcast([(r.item, r.text) for r in part.collect()]), uuid.uuid4().hex
        if i + 1 < passes:
            out = out.mapInArrow(lambda b, held=held, name=name: _scan(b, held, name, window, own), out.schema)
    return out.mapInArrow(lambda b: _report(_scan(b, held, name, window, own), mine, share, own), schema)
