"""Sequencing-shaped views of the star-schema tables, in Spark and in SQL.

Each view is a fixed projection with integer arithmetic, written twice so that
both engines agree: as a function here and as a WITH clause in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CB_BASES = 8
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bases(n, size: int = CB_BASES):
    """The base-4 digits of ``n`` as letters."""
    return F.concat(*(F.substring(F.lit("ACGT"), F.shiftright(n, 2 * i).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) for i in reversed(range(size))))


def dense(spark, d):
    """(cb, umi, gene): few UMIs, several reads a molecule."""
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_suppkey").alias("cb"), (F.col("l_partkey") % 64).alias("umi"), (F.col("l_orderkey") % 8).alias("gene"))


def sparse(spark, d):
    """(cb, umi, gene, n): UMIs of five bases with mismatch neighbours."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("cb"), (F.col("l_partkey") % 1024).alias("umi"), (F.col("l_orderkey") % 40).alias("gene"), F.col("l_linenumber").alias("n")
    )


READ_ID = "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey"


def barcodes(spark, d):
    """(read_id, cb_seq): a list entry, with its third base changed on line 3 and an N on line 4."""
    x = table(spark, d, "lineitem")
    s = _bases(F.col("l_suppkey"))
    third = F.substring(s, 3, 1)
    swapped = F.concat(F.substring(s, 1, 2), F.translate(third, "ACGT", "CGTA"), F.substring(s, 4, 8))
    lost = F.concat(F.substring(s, 1, 7), F.lit("N"))
    seq = F.when(F.col("l_linenumber") == 3, swapped).when(F.col("l_linenumber") == 4, lost).otherwise(s)
    return x.select(F.expr(READ_ID).alias("read_id"), seq.alias("cb_seq")).distinct()


def whitelist(spark, d):
    return table(spark, d, "supplier").select(_bases(F.col("s_suppkey")).alias("cb_seq"), F.col("s_suppkey").alias("cb_idx"))


def alignments(spark, d):
    """(read_id, chr, start, end, is_reverse, n_loci)."""
    x = table(spark, d, "lineitem")
    start = F.col("l_partkey") * 50 + F.col("l_orderkey") % 50
    return x.select(
        F.expr(READ_ID).alias("read_id"), (F.col("l_suppkey") % 5).alias("chr"), start.alias("start"), (start + F.floor("l_quantity")).alias("end"),
        (F.col("l_returnflag") == "R").alias("is_reverse"), (F.col("l_linenumber") % 4).alias("n_loci"),
    ).distinct()


def gene_intervals(spark, d):
    x = table(spark, d, "part")
    return x.select(
        (F.col("p_partkey") % 5).alias("chr"), (F.col("p_partkey") * 50).alias("r_start"), (F.col("p_partkey") * 50 + F.col("p_size") * 10).alias("r_end"),
        F.col("p_partkey").alias("gene"), (F.col("p_size") % 2 == 0).alias("gene_reverse"),
    )


def junction_obs(spark, d):
    """(read_id, chr, start, end, strand, motif, overhang, annotated, is_unique)."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = (F.col("o_custkey") % 50) * 100
    motif = F.col("l_linenumber") % 7
    return x.select(
        F.col("l_orderkey").alias("read_id"), (F.col("l_suppkey") % 5).alias("chr"), start.alias("start"),
        (start + 21 + (F.col("l_partkey") % 20) * 25).alias("end"), (motif % 3).alias("strand"), motif.alias("motif"),
        F.floor("l_quantity").alias("overhang"), (F.col("l_partkey") % 97 == 0).alias("annotated"), (F.col("l_suppkey") % 3 > 0).alias("is_unique"),
    )


def cells(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("cb"), F.greatest(F.floor("c_acctbal"), F.lit(0)).alias("n_umis"))


def positions(spark, d):
    """(chr, start, end): events as intervals of seconds."""
    at = F.unix_timestamp("ts")
    return table(spark, d, "events").select(
        (F.col("user_id") % 5).alias("chr"), at.alias("start"), (at + F.floor(F.abs("value")) % 600 + 1).alias("end")
    )


def _gene_rows(spark, d):
    """(cb, molecule, gene), each once; dealt by molecule, so what is done by molecule deals nothing again."""
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 20).alias("cb"), F.col("l_orderkey").alias("molecule"), (F.col("l_partkey") % 40).alias("gene"))
    return x.repartition("molecule").distinct()


def gene_sets(spark, d):
    """(cb, molecule, gene): molecules with several genes, one row for each."""
    n = F.count(F.lit(1)).over(Window.partitionBy("cb", "molecule"))
    return _gene_rows(spark, d).withColumn("k", n).filter("k > 1").drop("k")


def unique_genes(spark, d):
    """(cb, gene, value) of molecules with one gene."""
    one = _gene_rows(spark, d).groupBy("cb", "molecule").agg(F.count(F.lit(1)).alias("k"), F.min("gene").alias("gene")).filter("k = 1")
    return one.groupBy("cb", "gene").agg(F.count(F.lit(1)).alias("value"))


def scored(spark, d):
    """(read_id, chr, start, is_reverse, score, n_junction, read_len, n_match, n_mismatch): alignments of a read."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    x = x.repartition("l_orderkey")  # what follows is done by read, so nothing is dealt again
    return x.select(
        F.col("l_orderkey").alias("read_id"), (F.col("l_suppkey") % 5).alias("chr"), F.expr(READ_ID).alias("start"), (F.col("l_returnflag") == "R").alias("is_reverse"),
        (F.col("l_quantity").cast("int") + 50).alias("score"), (F.col("l_linenumber") % 3).alias("n_junction"), F.lit(100).alias("read_len"),
        (F.col("l_quantity").cast("int") + 50).alias("n_match"), (F.col("l_partkey") % 14).alias("n_mismatch"),
    ).distinct()


def sequences(spark, d):
    """(doc_id, seq): letters of a text as bases, others N."""
    s = F.translate(F.coalesce("text", F.lit("")), LOWER, LOWER.upper())
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.translate(s, "EOISNRHLDUMFPGWYBV", "ACGTACGTACGTACGTAC"), "[^ACGT]", "N").alias("seq"))


def chain_blocks(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select((n % 5).alias("chr"), (n * 4000).cast("long").alias("s1"), (n * 4100 + 7).cast("long").alias("s2"), (n * 10 + 3000).cast("long").alias("len"))


#: The same views as WITH clauses.
SQL = {
    "dense": "select l_suppkey as cb, l_partkey % 64 as umi, l_orderkey % 8 as gene from lineitem",
    "sparse": "select l_suppkey as cb, l_partkey % 1024 as umi, l_orderkey % 40 as gene, l_linenumber as n from lineitem",
    "barcodes": f"""select distinct {READ_ID} as read_id,
        case l_linenumber when 3 then substr(s, 1, 2) || translate(substr(s, 3, 1), 'ACGT', 'CGTA') || substr(s, 4)
                          when 4 then substr(s, 1, 7) || 'N' else s end as cb_seq
        from (select *, array_to_string(list_transform(range(8), lambda i: substr('ACGT', ((l_suppkey >> (14 - 2 * i)) & 3) + 1, 1)), '') as s from lineitem)""",
    "whitelist": """select array_to_string(list_transform(range(8), lambda i: substr('ACGT', ((s_suppkey >> (14 - 2 * i)) & 3) + 1, 1)), '') as cb_seq,
        s_suppkey as cb_idx from supplier""",
    "aln": f"""select distinct {READ_ID} as read_id, l_suppkey % 5 as chr, l_partkey * 50 + l_orderkey % 50 as "start",
        l_partkey * 50 + l_orderkey % 50 + cast(floor(l_quantity) as bigint) as "end", l_returnflag = 'R' as is_reverse, l_linenumber % 4 as n_loci from lineitem""",
    "genes": """select p_partkey % 5 as chr, p_partkey * 50 as r_start, p_partkey * 50 + p_size * 10 as r_end, p_partkey as gene,
        p_size % 2 = 0 as gene_reverse from part""",
    "obs": """select l_orderkey as read_id, l_suppkey % 5 as chr, (o_custkey % 50) * 100 as "start",
        (o_custkey % 50) * 100 + 21 + (l_partkey % 20) * 25 as "end", (l_linenumber % 7) % 3 as strand, l_linenumber % 7 as motif,
        cast(floor(l_quantity) as bigint) as overhang, l_partkey % 97 = 0 as annotated, l_suppkey % 3 > 0 as is_unique
        from lineitem join orders on l_orderkey = o_orderkey""",
    "cells": "select c_custkey as cb, greatest(cast(floor(c_acctbal) as bigint), 0) as n_umis from customer",
    "pos": """select user_id % 5 as chr, cast(epoch(ts) - (epoch(ts) % 1) as bigint) as "start",
        cast(epoch(ts) - (epoch(ts) % 1) as bigint) + cast(floor(abs(value)) as bigint) % 600 + 1 as "end" from events""",
    "rows_": "select distinct l_orderkey % 20 as cb, l_orderkey as molecule, l_partkey % 40 as gene from lineitem",
    "sets_": "select * from rows_ where (cb, molecule) in (select (cb, molecule) from rows_ group by cb, molecule having count(*) > 1)",
    "uniq": """select cb, gene, count(*) as value from (select cb, molecule, min(gene) as gene from rows_ group by cb, molecule having count(*) = 1)
        group by cb, gene""",
    "scored": f"""select distinct l_orderkey as read_id, l_suppkey % 5 as chr, {READ_ID} as "start", l_returnflag = 'R' as is_reverse,
        cast(floor(l_quantity) as integer) + 50 as score, l_linenumber % 3 as n_junction, 100 as read_len,
        cast(floor(l_quantity) as integer) + 50 as n_match, l_partkey % 14 as n_mismatch from lineitem""",
    "seqs": """select doc_id, regexp_replace(translate(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'EOISNRHLDUMFPGWYBV', 'ACGTACGTACGTACGTAC'), '[^ACGT]', 'N', 'g') as seq
        from documents""",
    "chain": "select n_nationkey % 5 as chr, n_nationkey * 4000 as s1, n_nationkey * 4100 + 7 as s2, n_nationkey * 10 + 3000 as len from nation",
}


def letters(col, size: int):
    """Hexadecimal digits as pairs of bases."""
    digits = "0123456789abcdef"
    first, second = F.translate(col, digits, "AAAACCCCGGGGTTTT"), F.translate(col, digits, "ACGTACGTACGTACGT")
    return F.concat(*(F.concat(F.substring(first, i, 1), F.substring(second, i, 1)) for i in range(1, size // 2 + 1)))


def with_views(*names: str) -> str:
    return "with recursive " + ",\n".join(f"{n} as ({SQL[n]})" for n in names)
