"""Best-fit packing of tokenised documents into sequences of a fixed size.

Documents are tokenised where they lie.  Packing runs in bulk-synchronous
rounds, from long documents to short ones.  In a round the documents and the
gaps of the open sequences are sorted by size into ranges.  Each range is swept
from large to small: a document takes its successor, the smallest gap passed
that is still free.  What a range leaves over meets across ranges by its rank:
the documents left in one range take, in order, the last gaps left by the
ranges before.  Then the gaps are updated, and the round is repeated.  Documents
longer than every gap open as many new sequences as their lengths need at least.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import span_keys, store, utf8_runs

CAPACITY = 4096
END_ID = 1
RUN_BYTES = 1 << 19
#: Units that a worker remembers before it starts anew.
MEMORY = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


# Byte classes: white space that always parts tokens, letters, digits, punctuation, all other.
_PART, _LETTER, _DIGIT, _PUNCT, _OTHER = range(5)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[0x21:0x7F] = _PUNCT
    table[0x30:0x3A] = _DIGIT
    table[0x41:0x5B] = table[0x61:0x7B] = _LETTER
    table[0x27] = _OTHER  # it may open a contraction
    table[[0x20, 0x0A]] = _PART
    return table


class Encoder:
    """Token ids of whole texts, with a memory of the units met before.

    A text is cut into units only where the tokenizer itself always cuts: at
    blanks and line ends, and between ASCII (or Latin-1) letters, digits and
    ASCII punctuation.  Each distinct unit is encoded once; units of such
    characters alone are remembered in lower case, all others as they stand,
    since a mark may compose with a letter of one case only.  Texts with a
    special token in them are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [re.escape(s).encode() for s in special]
        self.classes, self.shown = _classes(), dict(enumerate(_byte_symbols()))
        self.plain = self._is_plain()
        self.forget()

    def _is_plain(self) -> bool:
        """Whether cutting into units and the short way for letters reproduce this tokenizer."""
        probe = "The Cat's ÉLAN, naïve (e.g. x2-10%) déjà-vu, Straße!? l'été 3,14 a»b «c» don't ÿ Ÿ ﬁ é, ño\t≮ a_b$c"
        self.forget()
        try:
            return self._units(probe.encode()) == self._whole(probe.encode())
        except Exception:  # noqa: BLE001  a model without a tokenize of its own is encoded whole
            return False

    def _whole(self, raw: bytes) -> list[int]:
        return self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _units(self, raw: bytes) -> list[int]:
        data = np.frombuffer(raw, np.uint8)
        ids, bounds = self._run(data, np.array([0, len(data)]))
        return ids[bounds[0] : bounds[1]].tolist()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _encode_units(self, units: list[bytes], letters: list[bool]) -> list[list[int]]:
        """Ids of units; those of Latin letters alone, in lower case, go straight to the model."""
        model = self.tokenizer.model.tokenize
        shown = self.shown
        return [
            [t.id for t in model(u.decode("latin-1").translate(shown))] if short else self._whole(u)
            for u, short in zip(units, letters)
        ]

    def _run(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        kind = self.classes[data]
        fold = data.copy()
        upper = (data >= 0x41) & (data <= 0x5A)
        lead = data == 0xC3
        if lead.any():
            # two-byte letters U+00C0..U+00FF, without the signs U+00D7 and U+00F7
            at = np.flatnonzero(lead[:-1])
            tail = data[at + 1]
            at = at[(tail != 0x97) & (tail != 0xB7)]
            kind[at] = kind[at + 1] = _LETTER
            capital = at[data[at + 1] <= 0x9E] + 1
            fold[capital] += 0x20
        fold[upper] += 0x20
        part = kind == _PART
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        if n > 1:
            a, b = kind[:-1], kind[1:]
            cut[1:n] |= part[:-1] | part[1:] | ((a != b) & (a != _OTHER) & (b != _OTHER))
        begin = np.flatnonzero(cut[:n] & ~part)
        stop = np.flatnonzero(cut)
        end = stop[np.searchsorted(stop, begin, "right")]
        other = np.concatenate([[0], np.cumsum(kind == _OTHER, dtype=np.int32)])
        mixed = other[end] > other[begin]
        if mixed.any():
            edge = np.zeros(n + 1, np.int8)
            edge[begin[mixed]] += 1
            edge[end[mixed]] -= 1
            inside = np.cumsum(edge[:n], dtype=np.int8) > 0
            fold[inside] = data[inside]
        distinct, first, inverse = np.unique(span_keys(fold, begin, end), return_index=True, return_inverse=True)
        b, e = begin[first], end[first]
        letters = np.concatenate([[0], np.cumsum(kind == _LETTER, dtype=np.int32)])
        slot = self._learn(distinct, b, e, fold, letters[e] - letters[b] == e - b)
        slot = slot[inverse]
        count = self.n[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        take = np.arange(total[-1]) + np.repeat(self.at[slot] - total[:-1], count)
        return self.ids[take], total[np.searchsorted(begin, off)]

    def _learn(self, keys: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: np.ndarray,
               letters: np.ndarray) -> np.ndarray:
        """Places of the units in the memory, after encoding those that are new."""
        if len(self.keys) > MEMORY:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = fold.tobytes()
            units = [raw[b:e] for b, e in zip(begin[new].tolist(), end[new].tolist())]
            ids = self._encode_units(units, letters[new].tolist())
            n = np.array([len(i) for i in ids], np.int64)
            place = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, np.array([t for i in ids for t in i], np.int32)])
            where = at[new]
            self.keys = np.insert(self.keys, where, keys[new])
            self.at = np.insert(self.at, where, place)
            self.n = np.insert(self.n, where, n)
        return np.searchsorted(self.keys, keys)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's bounds."""
        raw = data.tobytes()
        if self.plain and not any(re.search(s, raw) for s in self.special):
            return self._run(data, off)
        out = [self._whole(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        bounds = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int64)
        return np.array([t for o in out for t in o], np.int32), bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    coder = encoder(path)
    for batch in batches:
        for begin, stop, data, off in utf8_runs(batch.column(1), RUN_BYTES):
            ids, bounds = coder.encode(data, off)
            rows: list[tuple] = []
            for i in range(stop - begin):
                mine = np.append(ids[bounds[i] : bounds[i + 1]], END_ID).astype("<u4")
                for piece, lo in enumerate(range(0, len(mine), capacity)):
                    part = mine[lo : lo + capacity]
                    raw = part.tobytes()
                    rows.append((begin + i, piece, lo, len(part), zlib.crc32(raw), number, part if with_ids else None))
                    number += 1
            cols = list(zip(*rows)) if rows else [()] * 7
            out = [batch.column(0).take(pa.array(cols[0], pa.int32())), *(pa.array(c, pa.int64()) for c in cols[1:6])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "id"]
            if with_ids:
                out.append(pa.array([p.astype(np.int32) for p in cols[6]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)


#: Documents of one class are at most so many times as long as the shortest.
CLASS = 3
#: Documents of which so many fit into a sequence are one class with all shorter ones.
SHORT = 64
#: Rows of documents and gaps that one task sweeps.
SWEEP_ROWS = 200_000
DOC, GAP = 1, 0
SWEPT = "part int, kind int, id long, size int, seq long, offset long, first long, n long"


def _sweep(batches: Iterator[pa.RecordBatch], longest: int, least: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Match the documents of one range with its gaps, sorted from large to small.

    A gap counts as many times as ``longest`` fits in, each time with an equal
    part of its size.  Gives placed documents (with ``seq`` and ``offset``) and
    the new state: documents left with their rank in ``first``, and gaps with what
    is left of them, ``n`` parts from ``first`` on.  What is not larger than
    ``least`` waits for its class and has no rank and no part.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in SWEPT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    stack: list[list[int]] = []  # sequence, what is left, parts
    left = first = 0

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        out: list[tuple] = []
        for kind, item, size in zip(*(batch.column(c).to_pylist() for c in ("kind", "id", "size"))):
            if size <= least:
                out.append((part, kind, item, size, None, None, None, None))
            elif kind == GAP:
                stack.append([item, size, max(1, size // longest)])
            elif stack:
                top = stack[-1]
                out.append((part, DOC, item, size, top[0], capacity - top[1], None, None))
                top[1] -= size
                top[2] -= 1
                if not top[2]:
                    stack.pop()
                    if top[1]:
                        out.append((part, GAP, top[0], top[1], None, None, None, None))
            else:
                out.append((part, DOC, item, size, None, None, left, None))
                left += 1
        if out:
            yield rows(out)
    out = []
    for item, size, n in stack:
        out.append((part, GAP, item, size, None, None, first, n))
        first += n
    if out:
        yield rows(out)


def across(totals: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(range, first document, documents, range of their gaps, last part) from (range, documents left, parts left).

    Ranges go from large to small, and in each the documents left come before
    the gaps left: the documents take the parts that were left last.
    """
    stack: list[list[int]] = []
    out = []
    for part, docs, gaps in sorted(totals):
        rank = 0
        while rank < docs and stack:
            top = stack[-1]
            n = min(docs - rank, top[1])
            out.append((part, rank, n, top[0], top[1] - 1))
            rank, top[1] = rank + n, top[1] - n
            if not top[1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return out


def _parts_taken(batches: Iterator[pa.RecordBatch], taken: list[tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """(part, first, seq, gap): the document, by range and rank, that takes a part of each gap left over, and the gap's size."""
    for batch in batches:
        out = []
        for part, item, size, first, n in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "size", "first", "n"))):
            for doc_part, rank, docs, gap_part, last in taken:
                if gap_part == part:
                    # part numbers last, last - 1, ... go to ranks rank, rank + 1, ...
                    hi, lo = min(last, first + n - 1), max(last - docs + 1, first)
                    out += [(doc_part, rank + last - x, item, size) for x in range(hi, lo - 1, -1)]
        cols = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32()))], ["part", "first", "seq", "gap"])


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """(id, sequence_id, offset) of items (id, length), each at most ``capacity`` long.

    Items that fill a sequence have one of their own, of an odd number; the
    others share sequences of even numbers.  What reaches the driver is the
    number of documents and gaps of each size, at most two rows a size, and one
    row a range.
    """
    spark = items.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    logs = [items.filter(F.col("length") == capacity).select("id", (F.col("id") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    waiting = {r["length"]: r["count"] for r in items.filter(F.col("length") < capacity).groupBy("length").count().collect()}
    lengths = items.select(F.lit(DOC).alias("kind"), "id", F.col("length").cast("int").alias("size"))
    state = lengths.limit(0)
    opened, least = 0, capacity
    while True:
        sizes = [(r["kind"], r["size"], r["count"]) for r in state.groupBy("kind", "size").count().collect()]
        docs = {size: n for kind, size, n in sizes if kind == DOC}
        if not docs and not waiting:
            break
        if not docs:  # the next class joins the gaps
            top, least = least, max(waiting) // CLASS if max(waiting) * SHORT > capacity else 0
            docs = {size: waiting.pop(size) for size in [*waiting] if size > least}
            sizes += [(DOC, size, n) for size, n in docs.items()]
            state = state.unionByName(lengths.filter((F.col("size") > least) & (F.col("size") <= top) & (F.col("size") < capacity)))
        widest = max((size for kind, size, _ in sizes if kind == GAP), default=0)
        # documents longer than every gap ask for as many new sequences as their lengths need at least
        more = -(-sum(size * n for size, n in docs.items() if size > widest) // capacity)
        fresh = spark.range(opened, opened + more).select(F.lit(GAP).alias("kind"), (F.col("id") * 2).alias("id"), F.lit(capacity).alias("size"))
        opened += more
        ranges = max(1, min(tasks, -(-(sum(n for _, _, n in sizes) + more) // SWEEP_ROWS)))
        log, state = _round(state.unionByName(fresh), max(docs), least, capacity, ranges)
        logs += log
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def _round(state: DataFrame, longest: int, least: int, capacity: int, ranges: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables (id, sequence_id, offset) of what one round places, and the state after it."""
    parts = F.greatest(F.floor(F.col("size") / longest), F.lit(1))
    slot = F.when((F.col("kind") == GAP) & (F.col("size") > least), F.floor(F.col("size") / parts)).otherwise(F.col("size"))
    order = [F.col("slot").desc(), F.col("kind"), F.col("id")]
    rows = state.withColumn("slot", slot)
    rows = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.repartition(1)
    rows = rows.sortWithinPartitions(*order).select("kind", "id", "size")
    swept = store(rows.mapInArrow(lambda b: _sweep(b, longest, least, capacity), SWEPT), "sweep")
    placed = lambda t: t.filter("seq is not null").select("id", F.col("seq").alias("sequence_id"), "offset")
    after = swept.filter("seq is null")
    if ranges == 1:
        return [placed(swept)], after.select("kind", "id", "size")
    free, open_ = after.filter((F.col("kind") == DOC) & F.col("first").isNotNull()), after.filter(F.col("n") > 0)
    totals = free.groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.lit(0).alias("parts"))
    totals = totals.unionByName(open_.groupBy("part").agg(F.lit(0).alias("docs"), F.sum("n").alias("parts"))).groupBy("part").agg(F.sum("docs"), F.sum("parts"))
    taken = across([tuple(r) for r in totals.collect()])
    if not taken:
        return [placed(swept)], after.select("kind", "id", "size")
    taking = open_.mapInArrow(lambda b: _parts_taken(b, taken), "part int, first long, seq long, gap int")
    met = free.select("part", "first", "id", "size").join(taking, ["part", "first"])
    before = Window.partitionBy("seq").orderBy(F.col("size").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)
    at = capacity - F.col("gap") + F.coalesce(F.sum("size").over(before), F.lit(0))
    met = store(met.select("id", "seq", at.cast("long").alias("offset"), "size"), "placed")
    # of a placed document nothing is left, of a gap what is not taken
    used = met.groupBy(F.col("seq").alias("id")).agg(F.sum("size").cast("int").alias("taken")).select(F.lit(GAP).alias("kind"), "id", "taken")
    used = used.unionByName(met.select(F.lit(DOC).alias("kind"), "id", F.col("size").alias("taken")))
    left = after.select("kind", "id", "size").join(used.hint("merge"), ["kind", "id"], "left")
    left = left.select("kind", "id", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("size")).filter("size > 0")
    return [placed(swept), placed(met)], store(left, "packing-state")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and one end id; only a longer one than
    ``capacity`` is cut, into full pieces and a rest.  ``with_ids`` adds the
    ids.  A null or empty text is the end id alone; repeated rows are packed
    each, whatever their id; other columns are ignored; an empty table gives no
    row.  Sequences are filled from 0 on without gaps between their pieces.
    Pieces of one length go by their number, so a length that is very common
    is spread over ranges like any other.
    """
    path = tokenizer or default_tokenizer()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, id long" + ", ids array<int>" * with_ids
    pieces = store(slim.mapInArrow(lambda b: _pieces(b, path, capacity, with_ids), schema), "pieces")
    places = best_fit(pieces.select("id", "length"), capacity)
    return pieces.join(places, "id").select(*names, "sequence_id", "offset")
