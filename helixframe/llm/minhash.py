"""Near-duplicate components by circulant MinHash, banding and exact Jaccard.

One permutation shuffles the shingles' hashes, a second one, shifted
circularly by 0, 1, 2, ..., gives every coordinate of the signature.  Equal
shingle sets are merged first; documents that share a band meet there, and a
link counts only after the full shingle sets confirm it.

A word of up to seven bytes is its own 64-bit key, a longer one has a
cryptographic digest of 64 bits as its key, and a shingle mixes five keys: no
texts that are easy to write share one.  Equal sets have equal digests of 128
bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import discard, mix64, span_keys, store, utf8_runs

RUN_BYTES = 1 << 19
#: Members of a bucket whose pairs are listed; those of larger ones meet a centre first.
SMALL = 4
#: Bytes of shingle sets of one side of a comparison in a task.
CHUNK_BYTES = 1 << 19
#: Members of a crowded bucket that one task matches with the centre.
SALT = 512


@dataclass(frozen=True)
class Params:
    """``percent``: links have 100 * intersection >= percent * union.

    A pair at 85 % shares none of 24 bands of 5 rows with a probability of
    8e-7; at 80 % that takes 36 bands (6e-7).  ``low``: listed pairs are not
    compared in full if fewer of their signature bytes agree; 0.15 below the
    threshold is 4.6 standard deviations at 85 % and 24 bands, 5.0 at 80 % and
    36.
    """

    percent: int = 85
    words: int = 5
    bands: int = 24
    rows: int = 5

    @property
    def low(self) -> float:
        return self.percent / 100 - 0.15


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def word_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit key of every word, and the bounds of each text's words."""
    n = len(data)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.concatenate([[True], space[:-1]]) if n else space
    start = np.flatnonzero(~space & (before | cut[:-1]))
    after = np.concatenate([space[1:], [True]]) if n else space
    end = np.flatnonzero(~space & (after | cut[1:])) + 1
    return span_keys(_LOWER[data], start, end), np.searchsorted(start, off)


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct keys of each text's word shingles."""
    w, of = word_keys(data, off)
    n = len(w)

    def folded(at: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(at), size, np.uint64)
        for j in range(size):
            h = mix64(h * _FOLD ^ w[at + j])
        return h

    full = folded(np.arange(max(0, n - k + 1)), k)
    for lo, hi in zip(of[:-1].tolist(), of[1:].tolist()):
        if hi - lo >= k:
            part = np.sort(full[lo : hi - k + 1])
            yield part[np.concatenate([[True], part[1:] != part[:-1]])]
        else:
            yield folded(np.array([lo]), hi - lo) if hi > lo else w[:0]


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets, one row each."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)  # the hash's bits are the first permutation
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), coordinates), np.uint32)
    y, t = np.empty_like(x), np.empty_like(x)
    for k in range(coordinates):  # the second permutation, shifted by k
        np.add(x, np.uint32(k), out=y)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
            np.right_shift(y, np.uint32(shift), out=t)
            np.bitwise_xor(y, t, out=y)
            if factor:
                np.multiply(y, np.uint32(factor), out=y)
        out[:, k] = np.minimum.reduceat(y, at)
    return out


def _node(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def _describe(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    factor = np.array([pow(_BASE, j + 1, 1 << 64) for j in range(p.rows)], np.uint64)
    for batch in batches:
        for start, end, data, off in utf8_runs(batch.column(1), RUN_BYTES):
            sets = list(shingles(data, off, p.words))
            some = [s for s in sets if len(s)]
            bands: list = [None] * len(sets)
            short: list = [None] * len(sets)
            if some:
                sig = signatures(some, p.bands * p.rows)
                wide = sig.reshape(len(some), p.bands, p.rows).astype(np.uint64)
                keys = mix64((wide * factor).sum(2) + np.arange(1, p.bands + 1, dtype=np.uint64)).view(np.int64)
                low = (sig & np.uint32(255)).astype(np.uint8)
                rows = iter(zip(keys.tolist(), low))
                for i, s in enumerate(sets):
                    if len(s):
                        bands[i], b = next(rows)
                        short[i] = b.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, end - start),
                    batch.column(2).slice(start, end - start),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(short, pa.binary()),
                ],
                ["doc", "mark", "n", "node", "bands", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, off in utf8_runs(batch.column(1), RUN_BYTES):
            want = batch.column(0).slice(start, end - start).to_pylist()
            found = [(w, s.tobytes()) for w, s in zip(want, shingles(data, off, p.words)) if _node(s) == w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], ["node", "shingles"]
            )


def linked(a: bytes, b: bytes, percent: int) -> bool:
    """Exact test of 100 * intersection >= percent * union on sorted sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every end of ``edges`` (a, b): the smallest node it reaches.

    Each round a node takes the smallest label around it and then that label's
    own label, so the rounds grow with the logarithm of the longest path.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        over = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        step = step.join(over, F.col("comp") == F.col("n2"), "left")
        step = store(step.select("node", F.least("comp", F.coalesce("c2", "comp")).alias("comp"), "old"), "labels")
        discard(labels)
        moved = step.filter("comp <> old").limit(1).count()
        labels = step.select("node", "comp")
        if not moved:
            discard(both)
            return labels


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose signatures, then full sets, agree enough."""

    def near(batches):
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(x.num_rows, -1) for c in ("sa", "sb"))
            yield x.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= p.low))

    def exact(batches):
        for x in batches:
            ok = [linked(a.as_py(), b.as_py(), p.percent) for a, b in zip(x.column("xa"), x.column("xb"))]
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def with_both(rows, table, col, left, right):
        rows = rows.join(table.select(F.col("node").alias("a"), F.col(col).alias(left)).hint("merge"), "a")
        return rows.join(table.select(F.col("node").alias("b"), F.col(col).alias(right)).hint("merge"), "b")

    few = with_both(pairs, sigs, "sig", "sa", "sb").mapInArrow(near, "a binary, b binary")
    return with_both(few, sets, "shingles", "xa", "xb").mapInArrow(exact, "a binary, b binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each left set, the sizes of its intersections with all right sets."""
    values = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    until = np.append(first[1:], len(values))
    values = values[first]
    for x in left:
        at = np.searchsorted(values, x)
        at[at == len(values)] = 0
        at = at[values[at] == x]
        span = until[at] - first[at]
        place = np.arange(int(span.sum())) + np.repeat(first[at] - np.cumsum(span) + span, span)
        yield np.bincount(owner[place], minlength=len(right))


def _match(table: pa.Table, percent: int) -> pa.Table:
    """Links between components: sets of the left chunk against those of the right one.

    Links within a component of the task's own making are not listed again, so
    there are fewer of them than sets.
    """
    sides: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
    for left, members in zip(table.column("is_left").to_pylist(), table.column("members").to_pylist()):
        for m in members:
            sides[left][0].append(m["comp"])
            sides[left][1].append(np.frombuffer(m["shingles"], np.uint64))
    (lc, ls), (rc, rs) = sides[True], sides[False]
    out: list[tuple[bytes, bytes]] = []
    if lc and rc:
        root = {c: c for c in lc + rc}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        size = np.array([len(x) for x in rs])
        for comp, x, both in zip(lc, ls, common_counts(ls, rs)):
            for j in np.flatnonzero(100 * both >= percent * (len(x) + size - both)).tolist():
                a, b = find(comp), find(rc[j])
                if a != b:
                    root[a] = b
                    out.append((a, b))
    return pa.table([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])


def _rest(crowd: DataFrame, sets: DataFrame, p: Params) -> tuple[DataFrame, ...]:
    """Links (a, b) between components that still meet in a crowded bucket, and the stored tables they are read from.

    ``crowd`` is (bucket, node, n, comp).  Members of a bucket's largest
    component need no comparison with each other: the others (left) meet all
    members (right).  Buckets with the same largest component hold much the same
    members; where it saves comparisons they are taken together.  Only sets
    whose sizes allow a link meet, in chunks of ``CHUNK_BYTES``, so a
    hot bucket is spread over as many tasks as it has pairs of chunks.
    """
    one = F.count(F.lit(1))
    parts = crowd.groupBy("bucket", "comp").agg(one.alias("k"))
    parts = parts.groupBy("bucket").agg(
        F.max_by("comp", F.struct("k", "comp")).alias("major"), F.max("k").alias("most"), F.sum("k").alias("all"), one.alias("kinds")
    ).filter("kinds > 1")
    rows = mixed = store(crowd.join(parts.select("bucket", "major", "most", "all"), "bucket"), "mixed")
    apart = rows.groupBy("bucket", "major").agg(F.first(F.expr("(all - most) * all")).alias("cost")).groupBy("major").agg(F.sum("cost").alias("apart"))
    together = rows.select("major", "node", "comp").distinct().groupBy("major").agg((one * F.sum((F.col("comp") != F.col("major")).cast("long"))).alias("together"))
    choice = apart.join(together, "major").select("major", (F.col("together") <= F.col("apart")).alias("merge"))
    # one row a bucket, so that no component's members come together
    plan = parts.select("bucket", "major").join(choice, "major").select("bucket", F.when(~F.col("merge"), F.col("bucket")).alias("own"))
    rows = rows.join(plan.hint("merge"), "bucket").select(
        F.xxhash64("major", "own").alias("g"), "node", "n", "comp", (F.col("comp") != F.col("major")).alias("minor")
    ).distinct()
    # sets whose sizes differ by more than the threshold's ratio cannot link: they are never in neighbouring classes
    rows = rest = store(rows.withColumn("q", F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / p.percent) * 1.0001)).cast("int")), "rest")
    chunks = lambda c: F.ceil(F.sum(F.when(c, F.col("n") * 8).otherwise(0)) / CHUNK_BYTES).cast("int")
    meta = rows.groupBy("g", "q").agg(chunks(F.lit(True)).alias("cr"), chunks(F.col("minor")).alias("cl"))
    meta = meta.groupBy("g").agg(F.collect_list(F.struct("q", "cl", "cr")).alias("meta"))
    rows = rows.join(meta.hint("merge"), "g")
    mine = F.filter("meta", lambda m: m["q"] == F.col("q"))[0]
    full = rows.join(sets.hint("merge"), "node")
    member = F.struct("comp", "shingles")

    def packed(rows: DataFrame, count: str, left: bool) -> DataFrame:
        chunk = F.pmod(F.xxhash64("node"), mine[count]).cast("int")
        out = rows.groupBy("g", "q", chunk.alias("c")).agg(F.first("meta").alias("meta"), F.collect_list(member).alias("members"))
        near = F.filter("meta", lambda m: F.abs(m["q"] - F.col("q")) <= 1)
        other = "cr" if left else "cl"
        pairs = F.flatten(F.transform(near, lambda m: F.transform(
            F.filter(F.sequence(F.lit(0), m[other]), lambda j: j < m[other]), lambda j: F.struct(m["q"].alias("q"), j.alias("c")))))
        out = out.select("g", F.struct("q", "c").alias("own"), "members", F.explode(pairs).alias("with"))
        ends = ("own", "with") if left else ("with", "own")
        return out.select("g", F.col(ends[0]).alias("l"), F.col(ends[1]).alias("r"), F.lit(left).alias("is_left"), "members")

    both = packed(full.filter("minor"), "cl", True).unionByName(packed(full, "cr", False))
    found = both.groupBy("g", "l", "r").applyInArrow(lambda t: _match(t, p.percent), "a binary, b binary")
    return found, mixed, rest


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: Params = Params(),
                    with_mark: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    ``with_mark`` adds xxhash64 of the text, which tells rows of one id apart.

    Words are runs of other than ASCII white space with A-Z in lower case; a
    text with fewer words than a shingle has its whole sequence as the one
    shingle.  Null and empty texts have no shingles and link with nothing:
    their component is their own id.  Rows of a null id have a null component
    and are kept, but link nothing.  Rows that repeat an id are separate nodes
    with the same id.  Other columns are ignored.  Texts of any length are taken
    whole.

    Sets are merged by a 128-bit digest before banding, so copies cost one row
    each.  Members of a bucket of at most ``SMALL`` are compared with each
    other.  Those of a larger one are compared with one centre, the member
    that meets most others in its buckets, which links most of a large group at
    once.  Members that are then still in different components are compared in
    full, chunk by chunk, each with all members whose size allows a link; that
    work grows with the number of such members times the bucket's size, and is
    spread over tasks.  No link is left out and no list of pairs is made.
    """
    p = params
    ids = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark"))
    kind = ids.schema["doc"].dataType.simpleString()
    described = store(
        ids.mapInArrow(lambda b: _describe(b, p), f"doc {kind}, mark long, n long, node binary, bands array<bigint>, sig binary"), "minhash"
    )
    nodes = store(
        described.filter("doc is not null and node is not null")
        .groupBy("node")
        .agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "nodes",
    )
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("who")
    ).filter("size > 1")
    # buckets of several bands with the same members are one
    shared = shared.groupBy("size", "who", "least").agg(F.min("bucket").alias("bucket"))
    members = store(spread.join(shared.select("bucket", "size").hint("merge"), "bucket"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = wanted.join(ids, F.col("rep") == F.col("doc")).select("node", "text")
    sets = store(texts.mapInArrow(lambda b: _sets(b, p), "node binary, shingles binary").dropDuplicates(["node"]), "sets")
    sigs = nodes.select("node", "sig")

    small = members.filter(F.col("size") <= SMALL)
    other = small.select("bucket", F.col("node").alias("b"))
    pairs = small.select("bucket", F.col("node").alias("a")).join(other, "bucket").filter("a > b").select("a", "b")
    meets = F.sum("size").over(Window.partitionBy("node")).alias("meets")
    crowd = store(members.filter(F.col("size") > SMALL).select("bucket", "node", "n", "size", meets), "crowd")
    some = crowd.limit(1).count() > 0
    if some:
        salts = F.ceil(F.col("size") / SALT).cast("int")
        centre = crowd.groupBy("bucket").agg(F.max_by("node", F.struct("meets", "node")).alias("b"), F.first("size").alias("size"))
        centre = centre.select("bucket", "b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        dealt = crowd.select("bucket", F.col("node").alias("a"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
        pairs = pairs.unionByName(dealt.join(centre, ["bucket", "salt"]).filter("a <> b").select("a", "b"))
    links = store(_confirmed(pairs.distinct(), sigs, sets, p), "links")
    labels = components(links)
    if some:
        now = crowd.join(labels.hint("merge"), "node", "left").select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"))
        found, *unused = _rest(now, sets, p)
        more = store(found, "more-links")
        if more.limit(1).count():
            labels = components(links.unionByName(more))
        discard(more, *unused)
    discard(members, crowd, sets, links)
    lowest = nodes.join(labels, "node").groupBy("comp").agg(F.min("rep").alias("low"))
    of_node = labels.join(lowest, "comp").select("node", "low")
    owner = nodes.select("node", "rep").join(of_node, "node", "left").select("node", F.coalesce("low", "rep").alias("own"))
    owner = store(owner, "owners")  # so that the join with all rows stands alone and can be split at a set of many copies
    out = described.select("doc", "mark", "n", "node").join(owner.hint("merge"), "node", "left")
    own = F.when(F.col("doc").isNotNull(), F.coalesce("own", "doc"))
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(own == F.col("doc"), F.lit(True)).alias("kept"), *(["mark"] if with_mark else []),
    )
