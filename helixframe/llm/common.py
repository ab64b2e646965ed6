"""Helpers shared by the text operators: inputs, shared storage, Arrow buffers."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the classes ``[\x20\x09-\x0D]`` of the contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a folder of its own; on a
    cluster, where a folder of one machine is of no use, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage at a place that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`store` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_prefix(columns: list[str]) -> str:
    """The start of names of our own, which no column has."""
    prefix = "_hf_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def utf8_runs(array: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of rows of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets); a null counts as empty, a row
    longer than the limit is a run of its own.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    n = len(array)
    if not n:
        return
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(int(np.searchsorted(off, off[start] + limit, "right")) - 1, start + 1)
        end = min(end, n)
        yield start, end, raw[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number; past the end there are zeros."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))[at].astype(np.uint64)


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of the bytes from each start to its end.

    Up to seven bytes and their number are the key itself, so that different
    short spans have different keys; longer ones have a cryptographic digest.
    """
    size = end - start
    few = np.minimum(size, 7).astype(np.uint64) << np.uint64(3)
    keys = mix64(byte_words(data, start) & ((np.uint64(1) << few) - np.uint64(1)) | few << np.uint64(53))
    long = np.flatnonzero(size > 7)
    if len(long):
        raw = data.tobytes()
        spans = [raw[s:e] for s, e in zip(start[long].tolist(), end[long].tolist())]
        digest = {x: hashlib.blake2b(x, digest_size=8).digest() for x in set(spans)}
        keys[long] = np.frombuffer(b"".join(map(digest.__getitem__, spans)), np.uint64)
    return keys
