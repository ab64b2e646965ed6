"""Collocations: frequent phrases whose words meet more often than their parts let expect.

1. A count-min sketch of one row, as wide as the text has bytes by four, gives
   every phrase an upper bound of its count.  Words are sketched first, then
   pairs of words that may be frequent, then phrases of 3 to 5 words made of
   such pairs: three passes, each pruned by what the last one has ruled out.
2. Phrases whose bound reaches the threshold are candidates.  One more pass
   over the text counts them all, however many there are: a task numbers its
   words, then the pairs of a number and a word, and so on, so phrases are
   told apart by all their bytes; their counts travel in buckets and are added
   up a bucket at a time.
3. Thresholds, cuts, containment and ranks are joins of the counted phrases.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import UPPER, mix64, store

LONGEST = 5
#: Bytes of text that are held as arrays at once.
RUN_BYTES = 1 << 18
#: Bits of the map of slots that may be frequent: what is broadcast between passes has this size at any size of the text.
MAP_BITS = 1 << 26
#: Bytes of text whose phrases a task counts before it sends them.
PASS_BYTES = 12 << 20
#: Phrases that a task gathers before it sends their slots or adds up their counts, and bits of the largest bucket of slots.
HELD = 1 << 20
BUCKET_BITS = 22
#: A-Z in lower case, tabs as spaces, the ends of pieces as newlines.
FOLD = bytes.maketrans(UPPER.encode() + b"\t.,;:!?\n\x0b\x0c\r", UPPER.lower().encode() + b" " + b"\n" * 10)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def normal(texts: list[bytes]) -> bytes:
    """The texts' pieces, one a line, with single spaces between words."""
    data = b"\n".join(texts).translate(FOLD)
    return re.sub(rb" {2,}", b" ", data) if b"  " in data else data


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, normal text) of some ``RUN_BYTES`` each; columns are lang and text.  A text is never cut."""
    held, size = defaultdict(list), Counter()
    for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()):
            held[lang].append(text)
            size[lang] += len(text)
            if size[lang] >= RUN_BYTES:
                yield lang, normal(held.pop(lang))
                del size[lang]
        if size.total() >= 8 * RUN_BYTES:
            yield from ((lang, normal(texts)) for lang, texts in held.items())
            held.clear()
            size.clear()
    for lang, texts in held.items():
        yield lang, normal(texts)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for texts of up to two runs."""
    if len(_POWERS[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            power = np.full(max(n, RUN_BYTES), base, np.uint64)
            power[0] = 1
            out.append(np.cumprod(power, out=power))
        if n > 2 * RUN_BYTES:
            return out[0], out[1]
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """Words of a normal text: where they begin and end, their pieces, and hashes of phrases."""

    def __init__(self, lang: str, data: bytes):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        gap = np.concatenate([[1], (raw == 32) | (raw == 10), [1]]).astype(np.int8)
        turn = np.diff(gap)
        self.begin, self.end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        self.piece = np.cumsum(raw == 10)[self.begin] if len(self.begin) else self.begin
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.add(raw, np.uint64(1), out=total[1:], dtype=np.uint64)
        total[1:] *= up[:-1]
        np.cumsum(total, out=total)
        code = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]
        self.hashes = [mix64((total[self.end] - total[self.begin]) * down[self.begin] ^ code)]

    def phrases(self, k: int) -> np.ndarray:
        """Hashes of the phrases of ``k`` words from each place on (also across pieces)."""
        while len(self.hashes) < k:
            last, at = self.hashes[-1], len(self.hashes)
            self.hashes.append(mix64(last[:-1] * _STEP + self.hashes[0][at:]) if len(last) else last)
        return self.hashes[k - 1]

    def starts(self, width: int, maps: list[np.ndarray], longest: int) -> Iterator[np.ndarray]:
        """Where phrases of 1, 2, ... ``longest`` words may begin, by the maps there are (of words, of pairs, of longer phrases)."""
        one = self.phrases(1)
        yield (ok := _in_map(maps[0], one, width) if maps else np.ones(len(one), bool))
        for n in range(2, longest + 1):
            ok = ok[:-1] & ok[1:] & (self.piece[: len(ok) - 1] == self.piece[n - 1 :]) if len(ok) else ok
            level = min(n, 3) - 1
            if level < len(maps):
                ok[ok] = _in_map(maps[level], self.phrases(n)[ok], width)
            yield ok

    def possible(self, width: int, maps: list[np.ndarray], k: int) -> np.ndarray:
        """Where a phrase of ``k`` words may begin."""
        return list(self.starts(width, maps, k))[-1]

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """Each word as its place among the text's different words, and these."""
        raw = np.frombuffer(self.data, np.uint8)
        ends = np.concatenate([[0], np.cumsum(self.end - self.begin)]).astype(np.int64)
        letters = pa.py_buffer(raw[(raw != 32) & (raw != 10)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(ends), letters]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary


def _in_map(bits: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    at = hashes & np.uint64(min(width, 8 * len(bits)) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _counted(slots: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """The slots with their numbers, a row for each bucket of ``2**bits`` slots: places in the bucket as differences, and counts."""
    found, n = np.unique(np.concatenate(slots), return_counts=True)
    bucket = found >> np.uint64(bits)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    low, n = np.diff(found.astype(np.int64), prepend=0).astype(np.uint32), n.astype(np.uint32)
    starts = np.concatenate([[0], cuts]) if len(found) else cuts
    low[starts] = (found & np.uint64((1 << bits) - 1))[starts]
    bounds = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(found)])) if len(found) else []
    columns = [pa.nulls(len(bounds), pa.string()), pa.array([int(bucket[i]) for i, _ in bounds], pa.int64()), pa.array([low[i:j].tobytes() for i, j in bounds], pa.binary()),
               pa.array([n[i:j].tobytes() for i, j in bounds], pa.binary()), pa.nulls(len(bounds), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "slots", "counts", "n"])


def sketch(texts: DataFrame, width: int, maps: list, ks: tuple[int, ...], least: int) -> DataFrame:
    """(lang, slot, n): the counters of phrases of ``ks`` words that reach ``least``; and with a null slot a language's words, if 1 is in ``ks``.

    Counters travel as buckets, some 256 of them or as many as their size bound
    asks for, and are added up a bucket at a time, so no task holds more than
    one bucket's counters.
    """
    bits = min(BUCKET_BITS, max(8, width.bit_length() - 9))
    shared = [texts.sparkSession.sparkContext.broadcast(m) for m in maps]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, total = [m.value for m in shared], [], Counter()
        for lang, data in runs(batches):
            words = Words(lang, data)
            held += [words.phrases(k)[ok] & np.uint64(width - 1) for k, ok in enumerate(words.starts(width, known, max(ks)), 1) if k in ks]
            total[lang] += len(words.begin)
            if sum(map(len, held)) >= HELD:
                yield from _counted(held, bits)
                held = []
        if held:
            yield from _counted(held, bits)
        if 1 in ks and total:
            nothing = [pa.nulls(len(total), t) for t in (pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array([-1] * len(total)), *nothing, pa.array(total.values(), pa.int64())], ["lang", "bucket", "slots", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bucket, sums, words = ["lang", "slot", "n"], None, np.zeros(1 << bits, np.int64), Counter()

        def close() -> pa.RecordBatch:
            at = np.flatnonzero(sums >= least) if bucket is not None else np.zeros(0, np.int64)
            out = pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(((bucket or 0) << bits) + at), pa.array(sums[at])], names)
            sums[:] = 0
            return out

        for batch in batches:
            for lang, here, slots, counts, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                if here < 0:
                    words[lang] += n
                    continue
                if here != bucket:
                    yield close()
                    bucket = here
                sums[np.cumsum(np.frombuffer(slots.as_buffer(), np.uint32), dtype=np.int64)] += np.frombuffer(counts.as_buffer(), np.uint32)
        yield close()
        yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.nulls(len(words), pa.int64()), pa.array(words.values(), pa.int64())], names)

    rows = texts.mapInArrow(count, "lang string, bucket long, slots binary, counts binary, n long")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "lang string, slot long, n long")


def heavy_map(counters: DataFrame, least: int, width: int) -> np.ndarray:
    """The bits of the slots that hold at least ``least``; gathered as blocks of bits, ``MAP_BITS`` in all at most."""
    bits = min(width, MAP_BITS)
    block = 1 << 16
    at = F.col("slot").bitwiseAND(F.lit(bits - 1))
    heavy = counters.filter((F.col("n") >= least) & F.col("slot").isNotNull()).select(at.alias("at")).distinct()

    def pack(key, group):
        held = np.zeros(block, np.uint8)
        held[group.column("at").to_numpy() % block] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    packed = heavy.withColumn("block", F.floor(F.col("at") / block)).groupBy("block").applyInArrow(pack, "block long, bits binary")
    out = np.zeros(max(bits, block) // 8, np.uint8)
    for row in packed.collect():
        out[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.frombuffer(row["bits"], np.uint8)
    return out[: bits // 8]


class Shard:
    """Words of many texts as numbers, and how many words a phrase from each place on may have."""

    def __init__(self):
        number = numbers()
        self.known: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))
        self.ids, self.reach, self.hashes, self.size = [], [], [], 0

    def take(self, lang: str, words: Words, starts: Iterator[np.ndarray]) -> None:
        reach = np.zeros(len(words.begin), np.uint8)
        for ok in starts:
            reach[: len(ok)] += ok
        at, different = words.numbered()
        some = np.flatnonzero(reach)
        first = np.full(len(different), -1)
        first[at[some]] = some
        used = np.flatnonzero(first >= 0)
        names = different.take(pa.array(used)).to_pylist()
        number = np.full(len(different), -1)
        number[used] = np.fromiter(map(self.known[lang].__getitem__, names), np.int64, len(names))
        self.ids.append(number[at].astype(np.int32))
        self.reach.append(reach)
        self.hashes.append((number[used], words.phrases(1)[first[used]]))
        self.size += len(words.data)

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        """For 1 to ``LONGEST`` words: languages by place in ``known``, hashes, phrases and counts of what is there."""
        total = sum(map(len, self.known.values()))
        names, lang = pa.array([w for own in self.known.values() for w in own], pa.large_binary()), np.zeros(total, np.int64)
        place = np.fromiter((i for own in self.known.values() for i in own.values()), np.int64, total)
        lang[place] = np.repeat(np.arange(len(self.known)), [len(own) for own in self.known.values()])
        names = names.take(pa.array(np.argsort(place)))
        one = np.zeros(total, np.uint64)
        for number, hashes in self.hashes:
            one[number] = hashes
        ids, reach = np.concatenate(self.ids), np.concatenate(self.reach)
        at = np.flatnonzero(reach)
        code, own, hashes, phrases = ids[at].astype(np.int64), lang, one, names
        yield own, hashes, phrases, np.bincount(code, minlength=total)
        for k in range(2, LONGEST + 1):
            more = reach[at] >= k
            at, code = at[more], code[more]
            last = ids[at + k - 1]
            pairs = pa.array(code * total + last).dictionary_encode()
            different = pairs.dictionary.to_numpy()
            code = pairs.indices.to_numpy().astype(np.int64)
            start, end = different // max(total, 1), different % max(total, 1)
            own, hashes = own[start], mix64(hashes[start] * _STEP + one[end])
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(start)), names.take(pa.array(end)), pa.scalar(b" ", pa.large_binary()))
            yield own, hashes, phrases, np.bincount(code, minlength=len(different))


def _packed(shard: Shard, bits: int) -> Iterator[pa.RecordBatch]:
    """The shard's phrases with their counts, a compressed row for each language and bucket of their hashes."""
    own, hashes, phrases, counts = zip(*shard.phrases())
    key = np.concatenate(own) << bits | (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, counts = key[order], np.concatenate(counts)[order].astype(np.uint32)
    phrases = pa.concat_arrays(phrases).take(pa.array(order))
    _, ends, letters = phrases.buffers()
    ends, letters = np.frombuffer(ends, np.int64)[: len(phrases) + 1], np.frombuffer(letters, np.uint8)
    sizes = np.diff(ends).astype(np.uint32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist() if len(key) else [0]
    langs, codec = list(shard.known), pa.Codec("zstd", 1)
    blocks = [sizes[i:j].tobytes() + counts[i:j].tobytes() + letters[ends[i] : ends[j]].tobytes() for i, j in zip(cuts, cuts[1:])]
    key = key[cuts[:-1]]
    columns = [pa.array([langs[k >> bits] for k in key.tolist()], pa.string()), pa.array(key & ((1 << bits) - 1), pa.int64()), pa.array(np.diff(cuts), pa.int64()),
               pa.array([len(x) for x in blocks], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in blocks], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n", "size", "block"])


def _unpacked(n: int, size: int, block: pa.Buffer) -> pa.Table:
    data = pa.Codec("zstd").decompress(block, size)
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint32, n), dtype=np.int64)])
    phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), data.slice(8 * n)])
    return pa.table({"phrase": phrases, "f": pa.array(np.frombuffer(data, np.uint32, n, 4 * n).astype(np.int64))})


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).combine_chunks().group_by("phrase", use_threads=False).aggregate([("f", "sum")])
    return out.rename_columns(["phrase" if c == "phrase" else "f" for c in out.column_names])


def tally(texts: DataFrame, width: int, maps: list, least: int, pass_bytes: int, bits: int) -> DataFrame:
    """(lang, phrase, f): all phrases of 1 to 5 words that occur ``least`` times, with their exact counts.

    One pass over the text, whatever the number of phrases.  What a task finds
    travels in ``2**bits`` buckets a language; a bucket's phrases are added up
    in one task, some ``HELD`` counts at a time.
    """
    shared = [texts.sparkSession.sparkContext.broadcast(m) for m in maps]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = [m.value for m in shared], Shard()
        for lang, data in runs(batches):
            words = Words(lang, data)
            shard.take(lang, words, words.starts(width, known, LONGEST))
            if shard.size >= pass_bytes:
                yield from _packed(shard, bits)
                shard = Shard()
        if shard.size:
            yield from _packed(shard, bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, limit = None, [], 0, HELD

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                all_of = _summed(held)
                own = all_of.filter(pc.greater_equal(all_of["f"], least)).combine_chunks()
                yield from own.set_column(0, "phrase", own["phrase"].cast(pa.string())).add_column(0, "lang", pa.array([key[0]] * len(own), pa.string())).to_batches()

        for batch in batches:
            for lang, bucket, n, length, block in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if (lang, bucket) != key:
                    yield from close()
                    key, held, size, limit = (lang, bucket), [], 0, HELD
                held.append(_unpacked(n, length, block.as_buffer()))
                size += n
                if size >= limit:
                    held = [_summed(held)]
                    size, limit = 0, max(HELD, len(held[0]))
        yield from close()

    rows = texts.mapInArrow(count, "lang string, bucket long, n long, size long, block binary")
    return rows.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(add, "lang string, phrase string, f long")


def scored(counts: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases counted at least ``least`` times, by their lowest-scoring cut."""
    split = F.split("phrase", " ")
    frequent = counts.filter((F.col("f") >= least) & (F.size(split) > 1)).select("lang", "phrase", F.size(split).alias("words"), F.col("f").alias("a"), split.alias("w"))
    cut = frequent.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("one"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("two"))
    left, right = counts.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), counts.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r"))
    cut = cut.join(left, ["lang", "one"]).join(right, ["lang", "two"])
    # one row a language
    cut = cut.join(F.broadcast(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "below": wide("l") * wide("r")}).withColumn("score", F.expr("above div below"))
    best = cut.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "n", "b.score")


def within_longer(found: DataFrame) -> DataFrame:
    """(lang, phrase, longer): for phrases that lie in longer ones of ``found``, the largest count of these."""
    w = F.split("phrase", " ")
    each = found.filter("words > 2").select("lang", "a", "words", w.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    each = each.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    parts = each.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "a")
    return parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def mine(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, percent: int = 100, top: int = 2000,
         pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only) and cut into pieces at ``.,;:!?`` and line
    ends, pieces into words at spaces and tabs.  A phrase of 2 to 5 words of
    one piece that occurs ``a >= least`` times is scored at each cut into a
    first part (``l`` times) and a rest (``r`` times) by
    floor(1000 * a * n / (l * r)), ``n`` being the language's words; the lowest
    score counts, of equal ones that of the smallest first part.  A phrase that
    lies in a longer one which occurs at least ``percent`` percent as often is
    left out.  Ranks go by score, then count, both descending, then by phrase.

    A null language is ``und``, a null text empty.  Repeated rows count each.
    An empty table gives no rows.  Other columns are not read.  Counts are
    exact: the sketch only ever proposes too many phrases.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    width = 1 << max(16, (size // 4).bit_length())
    maps: list[np.ndarray] = []
    counters = store(sketch(texts, width, maps, (1,), least), "phrase-counters")
    totals = counters.filter("slot is null").groupBy("lang").agg(F.sum("n").alias("n"))
    for ks in (2,), tuple(range(3, LONGEST + 1)):
        maps.append(heavy_map(counters, least, width))
        counters = sketch(texts, width, maps, ks, least)
    maps.append(heavy_map(counters, least, width))
    counts = store(tally(texts, width, maps, least, pass_bytes, min(12, max(6, size.bit_length() - 26))), "phrase-counts")
    best = store(scored(counts, totals, least), "scored-phrases")
    kept = best.join(within_longer(best), ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
