from __future__ import annotations

import pytest

from conftest import rows
from pyspark.sql import functions as F
from curalith.operators import asof, joins

LEFT = [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e"), (None, "f")]
RIGHT = [(1, 10), (1, 11), (2, 20), (4, 40), (None, 50)]


def brute(how):
    out = []
    for k, v in LEFT:
        hits = [(k, v, rk, rv, None, "L,R") for rk, rv in RIGHT if k is not None and rk == k]
        out += hits or ([] if how == "inner" else [(k, v, None, None, False, "L")])
    if how == "full_outer":
        keys = {k for k, _ in LEFT if k is not None}
        out += [(None, None, rk, rv, False, "R") for rk, rv in RIGHT if rk not in keys]
    return sorted(out, key=repr)


def told(df):
    return sorted(
        (
            (r.primary_k, r.primary_v, r.secondary_k, r.secondary_v, r["__join__"].matched, ",".join(r["__join__"].sources))
            for r in df.collect()
        ),
        key=repr,
    )


@pytest.fixture
def sides(spark, stored):
    return stored(spark.createDataFrame(LEFT, "k int, v string")), stored(spark.createDataFrame(RIGHT, "k bigint, v int"))


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("how", ["inner", "left_outer", "full_outer", "full_outer_compat"])
def test_joins_equal_brute_force(sides, how, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    got = joins.keyed_join(*sides, "k", how, primary_name="L", secondary_name="R")
    assert told(got) == brute(how)
    origin = got.head()["__join__"]
    assert (origin.type, origin.key) == (how, "k")
    matched = sum(r[4] is None for r in brute(how))
    assert rows(joins.join_stats(got)) == [(len(brute(how)), matched)]


def test_joining_a_table_to_itself(sides, no_broadcast):
    left, _ = sides
    got = joins.keyed_join(left, left, "k", "full_outer")
    assert got.count() == 4 + 1 + 1 + 2 + 2


def test_empty_and_absent_secondary(spark, sides):
    left, right = sides
    empty = joins.keyed_join(left, right.limit(0), "k", "left_outer")
    assert empty.count() == len(LEFT) and {r["__join__"].matched for r in empty.collect()} == {False}
    through = joins.keyed_join(left, None, "k", "left_outer", primary_name="L")
    assert through.columns == ["k", "v", "__join__"]
    assert through.head()["__join__"].asDict() == {
        "type": "passthrough", "key": None, "key_value": None, "matched": None, "sources": ["L"],
    }
    assert rows(joins.join_stats(through)) == [(6, 0)]


def test_keys_must_be_comparable(spark, sides):
    left, _ = sides
    texts = spark.createDataFrame([("1", "x"), ("zz", "y")], "k string, w string")
    doubles = spark.createDataFrame([(1.0, "x"), (2.5, "y")], "k double, w string")
    assert joins.keyed_join(left, doubles, "k").count() == 2
    with pytest.raises(ValueError, match="key_types"):
        joins.keyed_join(left, texts, "k")
    assert joins.keyed_join(left, texts, "k", key_types="string").count() == 2
    with pytest.raises(ValueError, match="not a column"):
        joins.keyed_join(left, texts, "absent")
    with pytest.raises(ValueError, match="join_type"):
        joins.keyed_join(left, doubles, "k", "sideways")


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_custkey", "o_orderstatus")
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").withColumnRenamed("c_custkey", "o_custkey")
    joined = joins.keyed_join(joins.filtered(orders, {"o_orderstatus": ["F", "O"]}), customers.select("o_custkey"), "o_custkey")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderstatus, [F,O])" in plan
    assert "o_totalprice" not in plan and "c_acctbal" not in plan


def test_large_outer_joins_can_split_hot_keys(spark, sides, no_broadcast):
    """Neither side of a plain full outer join can be split, nor the right of a left one."""
    plan = joins.keyed_join(*sides, "k", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "LeftOuter" not in plan
    assert "Inner" in plan and "LeftAnti" in plan


def test_many_sources(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (3, 30), (None, 0)], "k bigint, w int")
    c = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, v string")

    def joined(how):
        df = joins.join_many([("a", a), ("b", b), ("c", c)], "k", how)
        j = F.col("__join__")
        return rows(df.select("a_v", "b_w", "c_v", j["key_value"], j["matched"], F.array_join(j["sources"], ",")))

    whole = [(v, 10, w, "1", None, "a,b,c") for v in "xy" for w in "pq"]
    lone = [("z", None, None, "2", False, "a"), ("n", None, None, None, False, "a")]
    assert joined("inner") == sorted(whole, key=repr)
    assert joined("left_outer") == sorted(whole + lone, key=repr)
    others = [(None, 30, "r", "3", False, "b,c"), (None, 0, None, None, False, "b")]
    assert joined("full_outer") == sorted(whole + lone + others, key=repr)
    assert joins.join_many([("a", a), ("c", c.limit(0)), ("b", b)], "k", "full_outer").count() == 6
    with pytest.raises(ValueError, match="alias"):
        joins.join_many([("a", a), ("a", b)], "k")
    with pytest.raises(ValueError, match="one name"):
        joins.join_many([("a", a.withColumnRenamed("v", "b_w")), ("a_b", b)], "k")


@pytest.mark.parametrize(("how", "exchanges"), [("inner", 3), ("left_outer", 3), ("full_outer", 4)])
def test_many_sources_are_shuffled_once_each(spark, no_broadcast, stored, how, exchanges):
    sources = [(n, stored(spark.range(200).select(F.col("id").alias("k"), F.lit(n).alias("v")))) for n in "abc"]
    df = joins.join_many(sources, "k", how)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == exchanges
    assert df.count() == 200


@pytest.mark.parametrize("how", ["inner", "left_outer", "full_outer"])
def test_keys_that_many_sources_share_are_cut_into_cells(spark, monkeypatch, how):
    """Three keys of which two make most rows, equal rows, keys that a source lacks, rows without a key."""
    a = spark.createDataFrame([(k, i % 7) for k, n in ((1, 30), (2, 9), (3, 1), (None, 2), (4, 40)) for i in range(n)], "k int, v int")
    b = spark.createDataFrame([(k, f"w{i}") for k, n in ((1, 25), (2, 20), (5, 50), (None, 1)) for i in range(n)], "k bigint, w string")
    c = spark.createDataFrame([(k, [i]) for k, n in ((1, 2), (3, 3), (4, 30), (2, 1)) for i in range(n)], "k int, x array<int>")
    sources = [("a", a), ("b", b), ("c", c)]

    def joined():
        df = joins.join_many(sources, "k", how)
        assert not {"__cell", "__held", "__parts"} & set(df.columns)
        return rows(df)

    whole = joined()
    for cell_rows in (4, 40, 400):
        monkeypatch.setattr(joins, "CELL_ROWS", cell_rows)
        assert joined() == whole


def test_the_rows_of_one_key_are_made_in_many_tasks(spark):
    a = spark.range(1000).selectExpr("1 AS k", "id AS v")
    b = spark.range(1000).selectExpr("1 AS k", "id AS w")
    for how in ("inner", "left_outer", "full_outer"):
        parts = joins.join_many([("a", a), ("b", b)], "k", how).groupBy(F.spark_partition_id()).count().collect()
        assert sum(p["count"] for p in parts) == 1_000_000
        assert max(p["count"] for p in parts) < 800_000


@pytest.mark.parametrize("how", ["inner", "full_outer"])
def test_provenance_is_made_before_the_rows_of_a_key_multiply(spark, no_broadcast, stored, how):
    a = stored(spark.range(400).selectExpr("id % 2 AS k", "id AS v"))
    b = stored(spark.range(400).selectExpr("cast(id % 2 AS int) AS k", "id AS w"))
    c = stored(spark.createDataFrame([(0.0, "x"), (5.0, "y")], "k double, x string"))
    df = joins.join_many([("a", a), ("b", b), ("c", c)], "k", how)
    above, _, below = df._jdf.queryExecution().optimizedPlan().toString().partition("Join")
    assert "struct(type" not in above and "struct(type" in below
    j = F.col("__join__")
    want = [("0.0", None, "a,b,c", 40_000)]
    if how == "full_outer":
        want += [("1.0", False, "a,b", 40_000), ("5.0", False, "c", 1)]
    assert rows(df.groupBy(j["key_value"], j["matched"], F.array_join(j["sources"], ",")).count()) == want
    assert df.columns == ["a_k", "a_v", "b_k", "b_w", "c_k", "c_x", "__join__"]


def test_nearest_of_each(spark):
    at = "timestamp_seconds"
    a = spark.createDataFrame([(1, 100, 0), (1, 200, 1), (2, 100, 2), (None, 100, 3)], "k int, t int, i int")
    b = spark.createDataFrame([(1, 90, 0), (1, 195, 1)], "k int, t int, i int")
    c = spark.createDataFrame([(1, 150, 0), (2, 40, 1)], "k int, t int, i int")
    sources = [(n, df.selectExpr("k", f"{at}(t) AS t", "i")) for n, df in (("a", a), ("b", b), ("c", c))]
    got = asof.nearest_of_each(sources, ["k"], time="t", tie_by="i", seconds=50)
    origin = F.col("__join__")
    assert rows(got.select("a_i", "b_i", "c_i", origin["matched"], F.array_join(origin["sources"], ","))) == [
        (0, 0, None, False, "a,b"), (1, 1, 0, None, "a,b,c"), (2, None, None, False, "a"), (3, None, None, False, "a"),
    ]
