"""Every registered query against its equivalent SQL, on whole tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from curalith.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(records):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = canonical([tuple(r[c] for c in columns) for r in df.collect()])
    assert got, "a query without rows shows nothing"
    sql = ORACLES.get(name)
    if sql is None:
        return
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    kinds = {d[0]: TYPES.get(str(d[1])) for d in answer.description}
    assert sorted(names) == columns
    assert kinds == {f.name: f.dataType.simpleString() for f in df.schema.fields}
    order = [names.index(c) for c in columns]
    assert got == canonical([tuple(r[i] for i in order) for r in answer.fetchall()])


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(ORACLES) == set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
    assert contract.entry(spark).columns == ["column_name", "check_no", "check", "passed", "failed_count"]
