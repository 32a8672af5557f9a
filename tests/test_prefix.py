from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from curalith.operators import asof, prefix


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(3)
    # One group holds most rows; values are sparse.
    data = [
        (rng.choice(["hot", "hot", "hot", "b", None]), t, i, rng.randint(0, 50) if rng.random() < 0.3 else None)
        for i, t in enumerate(rng.choices(range(0, 400), k=500))
    ]
    return spark.createDataFrame(data, "g string, t int, i int, v int").repartition(5), data


def expected(data, how, descending, inclusive, partition):
    groups = {}
    for row in data:
        groups.setdefault(row[0] if partition else 0, []).append(row)
    out = {}
    for group in groups.values():
        group.sort(key=lambda r: (r[1], r[2]), reverse=descending)
        for n, row in enumerate(group):
            seen = [r[3] for r in group[: n + inclusive] if r[3] is not None]
            out[row[2]] = (None if not seen else {"sum": sum(seen), "max": max(seen), "last": seen[-1]}[how])
    return out


@pytest.mark.parametrize("how", ["sum", "max", "last"])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("partition", [True, False])
def test_prefix_scan_equals_a_plain_running_value(stream, how, descending, inclusive, partition):
    df, data = stream
    got = prefix.prefix_scan(
        df, "out", F.col("v"), how, order_by=["t", "i"], partition_by=["g"] if partition else [],
        bucket=F.shiftright("t", 4), descending=descending, inclusive=inclusive,
    )
    assert got.columns == [*df.columns, "out"]
    assert {r.i: r.out for r in got.collect()} == expected(data, how, descending, inclusive, partition)


def test_sequence_and_index(stream):
    df, data = stream
    ordered = sorted(data, key=lambda r: (r[1], r[2]))
    got = prefix.record_index(df, order_by=["t", "i"], bucket=F.floor(F.col("t") / 7))
    assert {r.i: r.record_index for r in got.collect()} == {row[2]: n for n, row in enumerate(ordered)}
    per_group = prefix.sequence_numbers(df, order_by=["t", "i"], partition_by=["g"])
    counts, want = {}, {}
    for row in ordered:
        counts[row[0]] = counts.get(row[0], 0) + 1
        want[row[2]] = counts[row[0]]
    assert {r.i: r.seq for r in per_group.collect()} == want


def test_groups_are_split_by_bucket(stream):
    df, _ = stream
    plan = prefix.sequence_numbers(df, order_by=["t", "i"], partition_by=["g"], bucket=F.shiftright("t", 4))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in text and "__bucket" in text


@pytest.mark.parametrize("how", ["sum", "max", "last"])
@pytest.mark.parametrize("order", [["at", "i"], ["name", "i"], ["day", "amount", "i"], ["raw", "i"], ["wall", "i"]])
@pytest.mark.parametrize("descending", [False, True])
def test_ranges_split_one_group_of_any_order_type(spark, how, order, descending):
    """All rows of the group lie in one hour; texts, decimals, dates and bytes order as well as times."""
    rng = random.Random(4)
    data = [("hot" if i % 9 else None, rng.choice([None, *range(3000)]), i, rng.choice([None, rng.randint(0, 50)])) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, t int, i int, v int").repartition(5)
    df = df.selectExpr(
        "*", "timestamp_seconds(1700000000 + t) at", "concat('order ', lpad(t, 5, '0')) name", "date_add(date'2024-01-01', cast(t div 7 as int)) day",
        "cast(t / 3 as decimal(12, 4)) amount", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, t) wall", "cast(lpad(t, 6, '0') as binary) raw",
    )
    number = prefix.range_number(df, ["g", *order])
    sizes = [r["count"] for r in df.groupBy(number.alias("n")).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.4 * len(data)
    lead = (lambda r: (r[1] is not None, r[1] or 0, r[2])) if order[0] != "day" else (lambda r: (r[1] is not None, (r[1] or 0) // 7, r[1] or 0, r[2]))
    got = prefix.prefix_scan(df, "out", F.col("v"), how, order_by=order, partition_by=["g"], descending=descending)
    want = {}
    for g in ("hot", None):
        own = sorted((r for r in data if r[0] == g), key=lead, reverse=descending)
        for n, row in enumerate(own):
            seen = [r[3] for r in own[: n + 1] if r[3] is not None]
            want[row[2]] = None if not seen else {"sum": sum(seen), "max": max(seen), "last": seen[-1]}[how]
    assert {r.i: r.out for r in got.collect()} == want


def test_ranges_of_empty_constant_and_unsortable_columns(spark):
    df = spark.createDataFrame([(1, [2]), (1, [1]), (1, None)], "a int, b array<int>")
    assert {r.n for r in df.select(prefix.range_number(df, ["b"]).alias("n")).collect()} == {0}
    assert len({r.n for r in df.select(prefix.range_number(df, ["a", "b"]).alias("n")).collect()}) == 1
    assert prefix.record_index(df.limit(0), order_by=["a"]).collect() == []


def nearest(left, right, direction, tolerance):
    out = {}
    for key, at, i in left:
        before = [(t, j) for k, t, j in right if k == key and k is not None and at is not None and t is not None and t <= at]
        after = [(t, j) for k, t, j in right if k == key and k is not None and at is not None and t is not None and t >= at]
        b, a = max(before, default=None), min(after, default=None)
        pick = {"backward": b, "forward": a}.get(direction)
        if direction == "nearest":
            pick = b if a is None or (b is not None and at - b[0] <= a[0] - at) else a
        if pick is not None and tolerance is not None and abs(pick[0] - at) > tolerance:
            pick = None
        out[i] = pick[1] if pick else None
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 40])
def test_temporal_join_equals_brute_force(spark, direction, tolerance):
    rng = random.Random(11)
    make = lambda n, base: [
        (rng.choice(["x", "x", "y", None]), rng.choice([None, *range(0, 2000, 7)]), base + i) for i in range(n)
    ]
    left, right = make(120, 0), make(150, 1000)
    frame = lambda data: spark.createDataFrame(data, "k string, s int, i int").select(
        "k", F.timestamp_seconds("s").alias("at"), "i"
    )
    got = asof.temporal_join(
        frame(left), frame(right), keys=["k"], time="at", tie_by="i", direction=direction,
        tolerance_seconds=tolerance, bucket_seconds=60,
    )
    assert got.columns == ["primary_k", "primary_at", "primary_i", "secondary_k", "secondary_at", "secondary_i"]
    assert {r.primary_i: r.secondary_i for r in got.collect()} == nearest(left, right, direction, tolerance)
    inner = asof.temporal_join(
        frame(left), frame(right), keys=["k"], time="at", tie_by="i", direction=direction,
        tolerance_seconds=tolerance, join_type="inner",
    )
    assert inner.count() == sum(v is not None for v in nearest(left, right, direction, tolerance).values())


def test_temporal_join_forms_no_pairs(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts")
    plan = asof.temporal_join(t, t, keys=["user_id"], time="ts", tie_by="event_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "CartesianProduct" not in text
    assert len(rows(plan)) == t.count()
