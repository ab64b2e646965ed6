"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt into buckets of similar length, longest first.  A query's
k-th score so far, divided by its own and the bucket's length, is the cosine
that a vector of the bucket needs to matter.  Above 1 the bucket is skipped;
a high one selects candidates by the query's strongest coordinate; a low one
by length alone.  The candidates' integer products are then computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import store

SCALE = 1024
BUCKET_ROWS = 4096
#: Bytes of queries that are broadcast at once; more queries make further passes.
QUERY_BYTES = 32 << 20
#: Local cosine thresholds from here on are pruned by coordinate, below by length.
COORDINATE_FROM = 0.6
SLACK = 1e-9


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """floor(scale * x) of every complete, finite vector."""
    for batch in batches:
        ids, raw, norms, dims = [], [], [], []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            if vec_id is None or not vector.is_valid or vector.values.null_count:
                continue
            x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            x = np.clip(np.floor(scale * x), -(2.0**62), 2.0**62)
            ids.append(vec_id)
            raw.append(x.astype("<i8").tobytes())
            norms.append(float(np.sqrt((x * x).sum())))
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(raw, pa.binary())],
            ["vec_id", "dim", "norm", "v"],
        )


def _buckets(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted vectors of a partition, packed into buckets of one dimension."""
    held: list[tuple] = []

    def flush():
        top = held[0]
        ids, rows = (np.array([h[i] for h in held], "<i8").tobytes() for i in (0, 4))
        norms, vectors = np.array([h[2] for h in held]).tobytes(), b"".join(h[3] for h in held)
        return pa.RecordBatch.from_arrays(
            [pa.array([top[1]], pa.int32()), pa.array([top[2]]), *(pa.array([x], pa.binary()) for x in (ids, rows, norms, vectors))],
            ["dim", "longest", "ids", "rows", "norms", "vectors"],
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "norm", "v", "row"))):
            if held and (len(held) >= rows or held[0][1] != row[1]):
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products of the rows of ``a`` and ``b``; beyond 64 bits they saturate."""
    if bound < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


class Queries:
    """A block of queries of one dimension, with their k-th scores so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.least = np.full(len(ids), -np.inf)

    def search(self, ids, rows, norms, vectors, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query number, vec_id, score) of each query's best in one bucket, whole rows at a time."""
        reach = self.norms * norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, self.least / reach, np.where(self.least > 0, np.inf, -np.inf))
        bound = float(reach.max(initial=0.0))
        ordered: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_coordinate = (cosine >= COORDINATE_FROM) & (cosine <= 1 + SLACK)
        by_length = np.flatnonzero(cosine < COORDINATE_FROM)
        unit = None
        for q in np.flatnonzero(by_coordinate).tolist():
            if unit is None:
                unit = vectors / np.maximum(norms, 1e-300)[:, None]
            direction = self.vectors[q] / self.norms[q]
            f = int(np.abs(direction).argmax())
            if f not in ordered:
                turn = np.argsort(unit[:, f])
                ordered[f] = turn, unit[turn, f]
            turn, values = ordered[f]
            spread = np.sqrt(max(0.0, 1 - direction[f] ** 2) * max(0.0, 1 - cosine[q] ** 2)) + 1e-7
            lo, hi = direction[f] * cosine[q] - spread, direction[f] * cosine[q] + spread
            if direction[f] > cosine[q]:  # the cone holds the axis itself
                hi = 1.0
            elif -direction[f] > cosine[q]:
                lo = -1.0
            some = turn[np.searchsorted(values, lo - SLACK) : np.searchsorted(values, hi + SLACK, "right")]
            some = some[norms[some] * self.norms[q] * (1 + SLACK) >= self.least[q]]
            if len(some):
                yield self._best(q, ids[some], rows[some], _products(vectors[some], self.vectors[q : q + 1], bound)[:, 0], k)
        for at in range(0, len(by_length), 256):
            part = by_length[at : at + 256]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.norms[part] > 0, self.least[part] / self.norms[part], -np.inf).min()
            n = int(np.searchsorted(-norms, -need * (1 - SLACK) if need > 0 else np.inf, "right"))
            scores = _products(vectors[:n], self.vectors[part], bound)
            for j, q in enumerate(part.tolist()):
                yield self._best(q, ids[:n], rows[:n], scores[:, j], k)

    def _best(self, q: int, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int):
        ok = (rows != self.rows[q]) & (scores >= self.least[q])
        ids, scores = ids[ok], scores[ok]
        if len(scores) > k:
            ok = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[ok], scores[ok]
        turn = np.lexsort((ids, -scores))[:k]
        return np.full(len(turn), q), ids[turn], scores[turn]


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(rows, dim) if dim else np.zeros((rows, 0), np.int64)


def _search(batches: Iterator[pa.RecordBatch], held, k: int) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, Queries] = held.value
    for batch in batches:
        for dim, ids, rows, norms, vectors in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "rows", "norms", "vectors"))):
            block = blocks.get(dim)
            if block is None:
                continue
            ids, rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
            got = list(block.search(ids, rows, np.frombuffer(norms), _matrix(vectors, len(ids), dim), k))
            if got:
                q, vec, score = (np.concatenate(c) for c in zip(*got))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.rows[q]), pa.array(block.ids[q]), pa.array(vec), pa.array(score)], ["row", "query_id", "vec_id", "score"]
                )


FOUND = "row long, query_id long, vec_id long, score long"


def top_products(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = SCALE, id_col: str = "vec_id",
                 vector_col: str = "embedding", bucket_rows: int = BUCKET_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products.

    Components become floor(``scale`` * x).  Queries are the rows whose id is
    divisible by ``every``; every row but the query's own is a candidate.  Ties
    go to the smaller id, a query with fewer than ``k`` candidates gets all of
    them.  Rows with a null id, and vectors that are null or hold null or
    non-finite components, take no part; vectors of different dimensions have
    no product, empty ones have 0 with each other.  Repeated rows are
    candidates, and queries, each for itself, also for rows of the same id.
    Scores beyond 64 bits saturate.  Other columns are ignored.

    Buckets are packed once, after one range shuffle, and scanned in place; the
    queries come to them in broadcasts of at most ``query_bytes``.  The longest
    bucket gives every query its first threshold.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long"), F.col(vector_col))
    ints = slim.mapInArrow(lambda b: _integers(b, scale), "vec_id long, dim int, norm double, v binary")
    ints = store(ints.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = ints.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    parts = max(1, -(-total["n"] // bucket_rows))
    spread = ints.repartitionByRange(parts, F.col("dim"), F.col("norm").desc(), F.col("vec_id"))
    spread = spread.sortWithinPartitions(F.col("dim"), F.col("norm").desc(), F.col("vec_id"))
    buckets = spread.select("vec_id", "dim", "norm", "v", "row").mapInArrow(
        lambda b: _buckets(b, bucket_rows), "dim int, longest double, ids binary, rows binary, norms binary, vectors binary"
    )
    buckets = store(buckets, "buckets")
    longest = {r["dim"]: r["longest"] for r in buckets.groupBy("dim").agg(F.max("longest").alias("longest")).collect()}
    asked = ints.filter(F.col("vec_id") % every == 0)
    size = asked.agg(F.sum(F.length("v") + 32)).first()[0] or 0
    passes = max(1, -(-size // query_bytes))
    found = None
    for i in range(passes):
        block = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == i)
        rows = block.select("row", "vec_id", "dim", "v").collect()
        blocks = {}
        for dim in {r["dim"] for r in rows}:
            mine = [r for r in rows if r["dim"] == dim]
            blocks[dim] = Queries(
                np.array([r["row"] for r in mine]), np.array([r["vec_id"] for r in mine]),
                _matrix(b"".join(bytes(r["v"]) for r in mine), len(mine), dim),
            )
        first = spark.sparkContext.broadcast(blocks)
        top = F.lit(False)
        for dim, norm in longest.items():
            top = top | ((F.col("dim") == dim) & (F.col("longest") == norm))
        seen = buckets.filter(top).mapInArrow(lambda b, h=first: _search(b, h, k), FOUND)
        least = seen.withColumn("nth", F.row_number().over(_best_first())).filter(F.col("nth") == k).select("row", "score").collect()
        floor = {r["row"]: r["score"] for r in least}
        for q in blocks.values():
            q.least = np.array([floor.get(r, -np.inf) for r in q.rows.tolist()])
        held = spark.sparkContext.broadcast(blocks)
        part = buckets.mapInArrow(lambda b, h=held: _search(b, h, k), FOUND)
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(_best_first())).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best_first():
    return Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
