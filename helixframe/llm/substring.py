"""Removal of repeated passages, judged byte by byte with suffix structures.

A 400-byte string that occurs twice has the same smallest gram hash at the same
place in both, so every window of 400 bytes belongs to one anchor, and equal
windows to equal anchors.  The windows of one anchor form a segment of text.
Segments whose anchor is unique hold no repeat; equal segments are counted, not
compared.  A window reaches at least half of its spare bytes to one side of its
anchor, so the others meet by their anchor with either half around it, where a Burrows-Wheeler transform of their
texts is searched: intervals are extended backwards, breadth first, which gives
the common prefixes in increasing order of length, up to the minimum length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import discard, mix64, store, utf8_runs

MIN_BYTES = 400
GRAM = 32
RUN_BYTES = 1 << 19
#: Bytes of segments that one transform takes, and that one group may have before its windows are counted one by one.
CHUNK_BYTES = 1 << 19
#: Bits of a place within ``RUN_BYTES`` and one window.
PLACE_BITS = 20

_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, 2 * RUN_BYTES), base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def _hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``begin`` to ``end``."""
    down = _powers(len(sums))[1]
    return mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def segments(data: np.ndarray, off: np.ndarray, size: int, gram: int) -> tuple:
    """Of each text: (text, digest, first window, windows, left, right) of its segments.

    The digest is one of 128 bits of all bytes of the segment's windows.
    ``left`` and ``right`` are hashes of the anchor with half a window's other
    bytes before or after it, 0 where the segment has fewer; they only say
    which segments meet.
    """
    width = size - gram + 1
    n = len(data)
    nothing = np.zeros(0, np.int64)
    if n < size:
        return nothing, [], nothing, nothing, nothing, nothing
    sums = _sums(data)
    _, down = _powers(n + 1)
    places = n - gram + 1
    hashes = (sums[gram:] - sums[:places]) * down[:places]
    hashes = mix64(hashes)
    low = np.uint64((1 << PLACE_BITS) - 1)  # the same for all texts, so that ties of the bits above fall alike
    key = (hashes & ~low) | np.arange(places, dtype=np.uint64)
    del hashes
    blocks = -(-places // width)
    key = np.pad(key, (0, blocks * width - places), constant_values=np.uint64(2**64 - 1)).reshape(blocks, width)
    ahead = np.minimum.accumulate(key, 1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - size + 1
    anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & low).astype(np.int64)
    del key, ahead, behind
    new = np.ones(starts, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    edge = off[(off > 0) & (off < starts)]
    new[edge] = True
    head = np.flatnonzero(new)
    of = np.searchsorted(off, head, "right") - 1
    # the windows of a text that fit come first in its run of one anchor
    count = np.minimum(np.append(head[1:], starts), off[of + 1] - size + 1) - head
    head, of, count = head[count > 0], of[count > 0], count[count > 0]
    at, end, half = anchor[head], head + count - 1 + size, (size - gram + 1) // 2
    raw = data.tobytes()
    digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(head.tolist(), end.tolist())]
    has = at - half >= head, at + gram + half <= end
    sides = [np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)]
    sides[0][has[0]] = _hash(sums, at[has[0]] - half, at[has[0]] + gram).view(np.int64)
    sides[1][has[1]] = ~_hash(sums, at[has[1]], at[has[1]] + gram + half).view(np.int64)
    return of, digest, head - off[of], count, *sides


def _scan(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, off in utf8_runs(batch.column(2), RUN_BYTES):
            # a longer text is taken in pieces that overlap by all but one byte of a window; a segment may be cut there
            for lo in range(0, max(1, len(data) - size + 1), RUN_BYTES):
                whole = len(data) <= RUN_BYTES
                part = data if whole else data[lo : lo + RUN_BYTES + size - 1]
                of, digest, first, *rest = segments(part, off if whole else np.array([0, len(part)]), size, gram)
                rows = pa.array(of + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(digest, pa.binary()), *map(pa.array, (first + lo, *rest))],
                    ["doc", "mark", "d", "first", "n", "left", "right"],
                )


SEGMENT = "doc long, mark long, d binary, first long, n long, left long, right long"


def suffix_array(text: np.ndarray, depth_wanted: int) -> np.ndarray:
    """Suffixes of ``text`` (non-negative bytes, last one 0) sorted by their first ``depth_wanted`` bytes or more."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", wide, strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n, dtype=np.int32)))
    depth = 8
    slots = _open_slots(same)
    while len(slots) and depth < depth_wanted:
        items = order[slots]
        after = items + depth
        pair = rank[items].astype(np.int64) << 32
        pair |= np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        turn = np.argsort(pair, kind="stable")
        items, pair = items[turn], pair[turn]
        order[slots] = items
        same = np.concatenate([[False], pair[1:] == pair[:-1]])
        rank[items] = slots[np.maximum.accumulate(np.where(same, 0, np.arange(len(items))))]
        slots = slots[_open_slots(same)]
        depth *= 2
    return order


def _open_slots(same: np.ndarray) -> np.ndarray:
    """Places in runs of more than one."""
    return np.flatnonzero(same | np.append(same[1:], False)).astype(np.int32)


def _short_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before, up to 16 and up to its string's end."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(24, np.uint8)])
    key = np.ndarray((n + 8,), ">u8", wide, strides=(1,)).astype(np.uint64)
    shared = np.zeros(n, np.int32)
    for at, part in ((0, key[order]), (8, key[order + 8])):
        differ = np.concatenate([[np.uint64(2**64 - 1)], part[1:] ^ part[:-1]])
        more = np.zeros(n, np.int32)
        for j in range(1, 8):
            more += differ < np.uint64(1 << (64 - 8 * j))
        more += differ == 0
        shared += np.where(shared == at, more, 0)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)
    return np.minimum(shared, left[order])


def long_prefixes(text: np.ndarray, order: np.ndarray, size: int, first: int = 16) -> np.ndarray:
    """Whether the suffix at each rank shares ``size`` bytes with the one before.

    ``text`` is a sequence of strings, each closed by 0, which matches nothing.
    The intervals of suffixes with ``first`` bytes in common are read from the
    sorted words.  From there on, level by level, a boundary between suffixes
    with ``level`` bytes in common gives, for each letter that precedes them,
    one with a byte more.  What has no boundary after ``size`` levels shares at
    least ``size`` bytes.
    """
    n = len(text)
    before = text[order - 1]
    by_letter = np.argsort(before, kind="stable").astype(np.int32)
    forward = np.empty(n, np.int32)
    forward[by_letter] = np.arange(n, dtype=np.int32)
    previous = np.full(n, -1, np.int32)
    equal = before[by_letter][1:] == before[by_letter][:-1]
    previous[by_letter[1:][equal]] = by_letter[:-1][equal]
    shared = _short_prefixes(text, order)
    start = min(first, size)
    known = np.append(shared < start, True)
    new = np.flatnonzero(shared == start - 1)
    for _ in range(size - start):
        # what lies between a new boundary and the next one, old or new
        edges = np.flatnonzero(known)
        until = edges[np.searchsorted(edges, new, "right")]
        span = until - new
        at = np.repeat(new, span)
        place = np.arange(len(at)) - np.repeat(np.cumsum(span) - span, span) + at
        hit = place[(previous[place] < at) & (before[place] != 0)]
        found = forward[hit]
        found = found[~known[found]]
        if not len(found):
            break
        known[found] = True
        new = np.sort(found)
    return ~known[:n]


def repeated_windows(parts: list[bytes], windows: list[int], size: int) -> list[np.ndarray]:
    """For each of different strings, which of its first windows occur in another place too."""
    raw = np.frombuffer(b"\0".join(p.replace(b"\0", b"\xff") for p in parts) + b"\0", np.uint8)
    order = suffix_array(raw, size + 1)
    same = long_prefixes(raw, order, size)
    hit = np.zeros(len(raw), bool)
    hit[order] = same | np.append(same[1:], False)
    at = np.cumsum([0] + [len(p) + 1 for p in parts])
    return [hit[a : a + w] for a, w in zip(at, windows)]


def _runs(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def _transform(batches: Iterator[pa.RecordBatch], size: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Segments sorted by group -> (d, spans of window starts that repeat).

    A segment may be in two groups, by its left and its right side.  Where both
    fall into one transform its text is taken once, or it would match its own copy.
    """
    held: dict[bytes, tuple[int, int, bytes]] = {}
    total, last = 0, None

    def flush():
        hits = repeated_windows([raw for _, _, raw in held.values()], [n for n, _, _ in held.values()], size)
        out = [(d, _runs(x)) for (d, (_, c, _)), x in zip(held.items(), hits) if c == 1]
        out = [r for r in out if r[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in out], pa.binary()), pa.array([x for _, x in out], pa.list_(pa.int64()))], ["d", "spans"]
        )

    for batch in batches:
        for i in range(batch.num_rows):
            g, d, n, c, most = (batch.column(x)[i].as_py() for x in ("g", "d", "n", "c", "most"))
            if held and g != last and total + most > chunk:
                yield flush()
                held, total = {}, 0
            last = g
            if d not in held:
                raw = batch.column("bytes")[i].as_py()
                held[d] = n, c, raw
                total += len(raw)
    if held:
        yield flush()


def _pack_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed from their buffers, without a string for each; batches of about ``RUN_BYTES`` of text."""
    for batch in batches:
        valid = batch.column(2).is_valid().to_pylist()
        for start, end, data, off in utf8_runs(batch.column(2), RUN_BYTES):
            packed = [zlib.compress(data[a:b], 1) if v else None for v, a, b in zip(valid[start:end], off.tolist(), off[1:].tolist())]
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["doc", "mark", "packed"])


CUT = "g long, d binary, n long, c long, most long, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The segments' bytes, a row for each; batches of about ``RUN_BYTES``."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["g", "d", "n", "c", "most", "bytes"]
    for batch in batches:
        out: list[tuple] = []
        total = 0
        for i in range(batch.num_rows):
            raw = zlib.decompress(batch.column("packed")[i].as_py())
            for w in batch.column("wanted")[i].as_py():
                part = raw[w["first"] : w["first"] + w["n"] - 1 + size]
                out.append((w["g"], w["d"], w["n"], w["c"], w["most"], part))
                total += len(part)
                if total > RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, total = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One row for each window of the segments of a crowded group, by a digest of all its bytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            g, d, n, c, raw = (batch.column(x)[i].as_py() for x in ("g", "d", "n", "c", "bytes"))
            w = [hashlib.blake2b(raw[j : j + size], digest_size=16).digest() for j in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * n, pa.binary()), pa.array(np.full(n, c)), pa.array(np.arange(n)), pa.array(w, pa.binary())],
                ["d", "c", "at", "w"],
            )


def repeated_spans(docs: DataFrame, size: int, gram: int, chunk: int) -> DataFrame:
    """(doc, mark, starts): of each text, ends of runs of window starts that repeat elsewhere."""
    seg = store(docs.mapInArrow(lambda b: _scan(b, size, gram), SEGMENT), "segments")
    unlike = seg.groupBy("d").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "mark", "first")).alias("rep"), F.first("n").alias("n"),
        F.first("left").alias("left"), F.first("right").alias("right"),
    )
    unlike = store(unlike, "unlike")
    # a segment that occurs twice as a whole: all its windows repeat
    whole = unlike.filter("c > 1").select("d", F.array(F.lit(0).cast("long"), "n").alias("spans"))
    by_side = unlike.select(F.explode(F.array("left", "right")).alias("g"), "d", "n", "c", "rep").filter("g <> 0")
    crowd = by_side.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") - 1 + size).alias("most")).filter("kinds > 1")
    mixed = by_side.join(crowd.select("g", "most").hint("merge"), "g")
    wanted = mixed.groupBy(F.col("rep.doc").alias("doc"), F.col("rep.mark").alias("mark")).agg(
        F.collect_list(F.struct("g", "d", "n", "c", F.col("rep.first").alias("first"), "most")).alias("wanted")
    )
    packed = docs.mapInArrow(_pack_text, "doc long, mark long, packed binary")
    texts = store(wanted.join(packed.hint("merge"), ["doc", "mark"]).dropDuplicates(["doc", "mark"]), "segment-texts")

    def cut(fits):
        rows = texts.withColumn("wanted", F.filter("wanted", lambda w: fits(w["most"]))).filter(F.size("wanted") > 0)
        return rows.mapInArrow(lambda b: _cut_out(b, size), CUT)

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = cut(lambda most: most <= chunk).repartition(tasks, "g").sortWithinPartitions("g")
    found = plain.mapInArrow(lambda b: _transform(b, size, chunk), "d binary, spans array<bigint>")
    # a window may meet in two groups, so it is counted once for each segment
    single = cut(lambda most: most > chunk).dropDuplicates(["d"]).mapInArrow(lambda b: _windows(b, size), "d binary, c long, at long, w binary")
    again = single.groupBy("w").agg(F.sum("c").alias("times")).filter("times > 1").select("w")
    single = single.join(again.hint("merge"), "w").groupBy("d").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("spans"))
    spans = store(whole.unionByName(found).unionByName(single), "spans")
    discard(texts, unlike)
    mine = seg.join(spans.hint("merge"), "d").select("doc", "mark", F.transform("spans", lambda x: x + F.col("first")).alias("starts"))
    return mine.groupBy("doc", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _remove(batches: Iterator[pa.RecordBatch], size: int, keep_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for packed, starts in zip(batch.column("packed"), batch.column("starts")):
            raw = zlib.decompress(packed.as_py()) if packed.is_valid else b""
            edges: list[int] = []
            if starts.is_valid:
                pairs = np.sort(starts.values.to_numpy(zero_copy_only=False).reshape(-1, 2), 0)
                lo, hi = pairs[:, 0], pairs[:, 1] - 1 + size
                reach = np.maximum.accumulate(hi)
                new = np.concatenate([[True], lo[1:] > reach[:-1]])
                edges = np.stack([lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]], 1).ravel().tolist()
            stay = [raw[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(raw)])]
            kept = b"".join(stay)
            rows.append((len(raw), len(raw) - len(kept), len(edges) // 2, edges, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
        cols = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64())),
             pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES,
                   gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, keep_bytes: bool = False) -> DataFrame:
    """Remove each byte covered by a ``min_bytes`` string that starts in two places.

    Texts are UTF-8 bytes (null: empty) and all strings are judged on the
    input.  Returns ``doc_id, n_bytes, n_removed, n_spans, spans`` (ends of the
    removed runs), ``kept_sha256`` and, with ``keep_bytes``, ``kept``.  Texts
    under ``min_bytes`` stay whole.  Rows that repeat count as two places; rows
    with a null id stay whole and make no other lose bytes.  Other columns are
    ignored.

    Segments that meet by one side of an anchor and have more than
    ``chunk_bytes`` together are too many for one transform: their windows are
    counted one by one, by digests, spread over all tasks.  Texts travel
    compressed, twice: to be cut and to lose their spans.
    """
    if not gram < min_bytes:
        raise ValueError("gram must be shorter than min_bytes")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    # rows that share an id are told apart by their text
    keyed = slim.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(keyed.filter("doc is not null"), min_bytes, gram, chunk_bytes)
    packed = keyed.mapInArrow(_pack_text, "doc long, mark long, packed binary")
    wide = packed.join(spans.hint("merge"), ["doc", "mark"], "left").withColumn("doc_id", F.col("doc").cast(kind))
    schema = T.StructType(
        [slim.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
         T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept_sha256", T.StringType()),
         T.StructField("kept", T.BinaryType())]
    )
    out = wide.select("doc_id", "packed", "starts").mapInArrow(lambda b: _remove(b, min_bytes, keep_bytes), schema)
    return out if keep_bytes else out.drop("kept")
