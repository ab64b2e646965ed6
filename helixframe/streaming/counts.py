"""Incremental molecule counts on a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_molecules(stream: DataFrame) -> DataFrame:
    """(cb, umi, gene, reads) as a streaming aggregate: sums of reads are associative."""
    return stream.groupBy("cb", "umi", "gene").agg(F.count(F.lit(1)).alias("reads"))


def append_molecules(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch's partial molecule counts to ``path``; sum them by key to read."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("cb", "umi", "gene").agg(F.count(F.lit(1)).alias("reads"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
