"""Every registered query against its SQL, and the entry's contract."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

import __spark_entry__
from helixframe.plans import queries as sequencing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(sequencing.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    same_rows(sequencing.QUERIES[name](spark, SF), tables, sequencing.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(sequencing.QUERIES) - set(sequencing.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert sequencing.QUERIES[name](spark, SF).count() > 0


def test_entry_runs_and_names_are_registered(spark):
    assert __spark_entry__.entry(spark).columns == ["gene_idx", "cb_idx", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_introns_of_tied_and_scattered_exons(spark):
    from helixframe.operators.junctions import from_exons

    rows = [("t", 1, 10, 20), ("t", 1, 10, 20), ("t", 2, 30, 40), ("t", 1, 30, 35), ("t", 1, 30, 40), ("t", 1, 60, 70)]
    got = from_exons(spark.createDataFrame(rows, "transcript string, chr int, start long, end long")).collect()
    assert sorted(map(tuple, got)) == [(1, 21, 29), (1, 41, 59)]
