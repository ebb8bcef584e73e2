"""Every query with SQL gives what DuckDB gives on the smallest tables; the rest give rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 9) if isinstance(v, (int, float, Decimal)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[k] for c, k in df.dtypes} == dict(zip(result.columns, map(str, result.types), strict=True))
    assert rows(df.columns, df.collect()) == rows(result.columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if n != "pipeline" and not n.startswith("op")))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_draw_rules_read_the_candidates_once(spark):
    assert not QUERIES["training_draw_rules"](spark, SF).inputFiles()
