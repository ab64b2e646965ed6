"""Line dedup over batches with levelled sorted runs of line hashes.

The store keeps, per level, runs of (line hash, owner document): tables
bucketed and sorted by hash, so that a join by hash reads a run where it lies.
A batch groups its own line hashes, merge-anti-joins the runs, and adds the
hashes that were new as a run of level 0; a level that has gathered ``fanout``
runs is compacted into one run of the next.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import ASCII_SPACE, discard, free_prefix, lower_ascii, new_path

MIN_CHARS = 10


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


class LineRuns:
    """Sorted runs of line hashes, bucketed tables in the shared folder.

    A run has (h, owner, last, new): only its rows with ``new`` are the run's
    own, the others say which lines of its batch an older run holds.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}

    def known(self) -> list[DataFrame]:
        return [self.spark.table(name).filter("new").select("h", "owner") for level in self.levels for name in level]

    def write(self, rows: DataFrame) -> str:
        """A table of the rows, dealt by hash into buckets, each sorted."""
        name, path = f"helixframe_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        out = rows.select("h", "owner", "last", "new").write.bucketBy(self.buckets, "h").sortBy("h")
        out.option("path", path).format("parquet").saveAsTable(name)
        self.paths[name] = path
        return name

    def plain(self, name: str) -> DataFrame:
        """The table without its buckets: a join with it can be split where a line is very common."""
        return self.spark.read.schema("h binary, owner long, last long, new boolean").parquet(self.paths[name])

    def drop(self, names: list[str]) -> None:
        for name in names:
            discard(self.plain(name))
            self.spark.sql(f"drop table {name}")

    def add(self, name: str) -> None:
        """Add a run, then compact the levels that are full."""
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            old = self.levels[level]
            merged = self.plain(old[0])
            for run in old[1:]:
                merged = merged.unionByName(self.plain(run))
            self.levels[level + 1].append(self.write(merged.filter("new").repartition(self.buckets, "h")))
            self.levels[level] = []
            self.drop(old)
            level += 1


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(batch, doc, mark, pos, h) of every line whose key has at least ``min_chars`` characters.

    ``mark`` is a hash of the text, which tells rows of one id apart; ``h`` the
    first 128 bits of SHA-256.
    """
    lines = docs.select("batch", "doc", F.xxhash64("text").alias("mark"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    key = lines.select("batch", "doc", "mark", "pos", line_key(F.col("line")).alias("key"))
    return key.filter(F.length("key") >= min_chars).select("batch", "doc", "mark", "pos", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("h"))


def add_batch(runs: LineRuns, lines: DataFrame) -> DataFrame:
    """Verdicts (doc, mark, positions to drop) of one batch of lines; its new hashes join the runs.

    A hash belongs to the batch that first held it and there to the smallest
    doc; every line with it in another document is to be dropped.  Hashes are
    grouped, with partial results, before a shuffle sees them; the runs are not
    shuffled.
    """
    owned = lines.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    older = []
    for i, run in enumerate(runs.known()):
        owned = owned.join(run.withColumnRenamed("owner", f"owner{i}").hint("merge"), "h", "left")
        older.append(f"owner{i}")
    new = F.coalesce(*older).isNull() if older else F.lit(True)
    name = runs.write(owned.select("h", F.coalesce(*older, "first").alias("owner"), "last", new.alias("new")))
    shared = runs.plain(name).filter("last > owner").select("h", "owner")
    path = new_path(runs.spark, "line-drops")
    dropped = lines.join(shared.hint("merge"), "h").filter("doc > owner")
    dropped.groupBy("doc", "mark").agg(F.collect_set("pos").alias("drops")).write.parquet(path)
    runs.add(name)
    return runs.spark.read.schema("doc long, mark long, drops array<int>").parquet(path)


OWN = ("kept_text", "n_lines", "n_dropped", "kept_sha256")


def _rebuild(batches: Iterator[pa.RecordBatch], text: str, drops: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_lines, n_dropped, digests = [], [], [], []
        for raw, gone in zip(batch.column(text), batch.column(drops)):
            raw = raw.as_py() or ""
            gone = gone.values if gone.is_valid else None
            if gone is None or not len(gone):
                kept, n, k = raw, raw.count("\n") + 1, 0
            else:
                lines = raw.split("\n")
                stay = np.ones(len(lines), bool)
                stay[gone.to_numpy(zero_copy_only=False)] = False
                kept, n, k = "\n".join(x for x, s in zip(lines, stay) if s), len(lines), int((~stay).sum())
            texts.append(kept)
            n_lines.append(n)
            n_dropped.append(k)
            digests.append(hashlib.sha256(kept.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
             pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())],
            [*keep, *OWN],
        )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop repeated lines, keeping each where it has the smallest document id.

    The documents go through the store in ``batches`` ranges of ascending id,
    so that the first batch to hold a line also holds its smallest id.  Returns
    all columns of ``docs`` and ``kept_text``, ``n_lines`` (before dropping),
    ``n_dropped`` and ``kept_sha256``; these four replace columns of the same
    name.

    A null or empty text is one empty line.  Lines whose key has fewer than
    ``min_chars`` characters stay.  Rows with a null id neither lose lines nor
    make others lose them; rows that repeat an id count as the same document.
    Texts are read twice: for their hashes, dealt by batch, and to be rebuilt.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    cuts = slim.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    number = sum(((F.col("doc") > c).cast("int") for c in cuts), F.lit(0))
    path = new_path(spark, "line-hashes")
    line_hashes(slim.withColumn("batch", number), min_chars).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc long, mark long, pos int, h binary, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    verdicts = None
    for batch in range(len(cuts) + 1):
        drops = add_batch(runs, lines.filter(F.col("batch") == batch).drop("batch"))
        verdicts = drops if verdicts is None else verdicts.unionByName(drops)
    for level in runs.levels:
        runs.drop(level)
    discard(lines)
    base = docs.drop(*(c for c in OWN if c not in (id_col, text_col)))
    p = free_prefix(docs.columns)
    same = (F.col(f"{p}id") == F.col(f"{p}doc")) & (F.xxhash64(f"{p}text") == F.col(f"{p}mark"))
    wide = base.withColumns({f"{p}id": F.col(id_col).cast("long"), f"{p}text": F.col(text_col)}).join(
        verdicts.toDF(f"{p}doc", f"{p}mark", f"{p}drops").hint("merge"), same, "left"
    )
    schema = T.StructType([*base.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    keep = base.columns
    return wide.mapInArrow(lambda b: _rebuild(b, f"{p}text", f"{p}drops", keep), schema)
