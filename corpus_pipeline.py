"""A corpus pipeline of five stages, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the documents are written as Parquet and read again.  Stages accept nulls in
any column, empty and repeated rows, empty tables, and extra columns of any
name: the operators see columns under names of our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontam, langid, linededup, minhash, packing
from helixframe.llm.common import discard, read_table, store

#: 36 bands miss a pair at 0.8 with a probability of 6e-7, as 24 do at 0.85.
NEAR = minhash.Params(percent=80, bands=36)


def _shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(new).alias(old) for old, new in names.items()))


#: A text is no language if its cosine is below this share of the cosine that all but ``ODD`` of the labelled texts of its size reach.
FLOOR_SHARE, ODD = 0.5, 0.001


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language.

    Texts that are null or have no letter go, and those that are like no
    language.  What a clean text's cosine is depends on its size, so the floor
    is calibrated for each power of two of the length, on the labelled texts
    whose language is predicted right; it is ``FLOOR_SHARE`` of their
    ``ODD`` quantile.  A size without such texts has no floor.
    """
    rows, at = _shielded(docs)
    scored = langid.identify(rows, id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"], keep=True)
    scored = scored.withColumn("size", F.floor(F.log2(F.length(at["text"]) + 1)))
    right = scored.filter(F.col("lang_pred") == F.col(at["lang"]))
    floors = right.groupBy("size").agg((FLOOR_SHARE * F.percentile_approx("score", ODD, 10_000)).alias("floor"))
    # one row a power of two
    out = scored.join(F.broadcast(floors), "size", "left")
    return _restored(out.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= F.coalesce("floor", F.lit(0.0)))), at)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of a smaller id has; ``n_chars`` follows."""
    rows, at = _shielded(docs)
    out = linededup.dedup_lines(rows, id_col=at["doc_id"], text_col=at["text"])
    out = out.withColumn(at["text"], F.col("kept_text"))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.length("kept_text").cast(rows.schema[at["n_chars"]].dataType))
    return _restored(out, at)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; null ids stay.

    Near duplicates share at least 0.8 of their five-word shingles.
    """
    rows, at = _shielded(docs)
    marked = minhash.near_duplicates(rows, id_col=at["doc_id"], text_col=at["text"], params=NEAR, with_mark=True)
    gone = marked.filter(~F.col("kept")).select(F.col("doc_id").alias("gone"), "mark").distinct()
    same = (F.col(at["doc_id"]) == F.col("gone")) & (F.xxhash64(at["text"]) == F.col("mark"))
    return _restored(rows.join(gone.hint("merge"), same, "left_anti"), at)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages."""
    rows, at = _shielded(docs)
    out = decontam.contamination(rows, read_table(spark, sf_dir, "benchmark"), id_col=at["doc_id"], text_col=at["text"], keep=True)
    return _restored(out.filter(~F.col("contaminated")), at)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]

#: Language ID, near-duplicate groups and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what the first ones keep is deleted as soon as the next is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, f"stage-{i}")
            if before is not None:
                discard(before)
            before = docs
    return docs
