from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from conftest import rows
from curalith.operators import keys, quality, schema_rules

MODEL = {
    "columns": [
        {"column_name": "name", "quality_checks": [{"check": "not_null"}]},
        {"column_name": "n", "quality_checks": [{"check": "positive"}, {"check": "range", "params": {"max": 5}}]},
        {"column_name": "gone", "quality_checks": [{"check": "not_null"}, {"check": "custom"}]},
        {"column_name": "free"},
    ]
}


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("a", 1, "x"), (" ", -1, None), (None, 9, "y"), ("d", None, "z")], "name string, n int, free string")


def test_report_counts_failures_per_check(people):
    assert rows(quality.quality_report(people, MODEL)) == [
        ("gone", 1, "not_null", False, 4),
        ("gone", 2, "custom", True, 0),
        ("n", 1, "positive", False, 2),
        ("n", 2, "range", False, 2),
        ("name", 1, "not_null", False, 2),
    ]


def test_rollup_sums_checks_and_keeps_columns_without_any(people):
    got = rows(quality.quality_by_column(people, MODEL, missing="skip"))
    assert got == [("free", True, 0), ("n", False, 4), ("name", False, 2)]


def test_overall(people):
    assert rows(quality.quality_overall(people, MODEL)) == [(5, 1, 4, "FAILED")]
    assert rows(quality.quality_overall(people, {"columns": []})) == [(0, 0, 0, "PASSED")]
    with pytest.raises(ValueError, match="missing"):
        quality.quality_overall(people, MODEL, missing="ignore")


def test_report_is_one_scan(people, spark):
    big = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    model = {"columns": [{"column_name": c, "quality_checks": [{"check": "not_null"}, {"check": "positive"}]} for c in big.columns]}
    plan = quality.quality_report(big, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "SinglePartition" in plan and "hashpartitioning" not in plan


def test_conformance(people):
    declared = {
        "columns": [
            {"column_name": "name", "data_type": "string", "constraints": {"is_nullable": False}},
            {"column_name": "n", "data_type": "float"},
            {"column_name": "free", "data_type": "integer"},
            {"column_name": "gone", "data_type": "string", "constraints": {"is_nullable": False}},
        ]
    }
    assert rows(quality.conformance(people, declared)) == [
        ("free", "integer", "string", False, 1, True),
        ("gone", "string", None, False, 4, False),
        ("n", "float", "int", True, 1, True),
        ("name", "string", "string", True, 1, False),
    ]


SCHEMA = {
    "primary_key": ["k"],
    "fields": [
        {"name": "k", "type": "integer", "nullable": False},
        {"name": "year", "type": "number", "constraints": [{"type": "check", "expression": "year >= 1900 AND year <= 2100"}]},
        {"name": "word", "type": "integer", "nullable": True},
        {"name": "odd", "type": "geometry"},
    ],
}


@pytest.fixture
def records(spark):
    data = [
        (0, 1, 2000, None, "a"),
        (1, 1, 1800, "w", "a"),
        (2, None, 1800, None, "a"),
        (3, None, 2000, "w", "a"),
        (4, 2, 1800, None, None),
        (5, 1, 2100, None, "a"),
    ]
    return spark.createDataFrame(data, "i int, k int, year int, word string, odd string")


def test_violations(records):
    got = schema_rules.find_violations(records, SCHEMA, order_by=["i"])
    found = {r.i: [(v.field, v.rule) for v in r.violations] for r in got.collect()}
    assert found == {
        0: [],
        1: [("year", "check"), ("word", "type"), ("k", "primary_key")],
        2: [("k", "nullable")],  # a null elsewhere in the row lets the check pass
        3: [("k", "nullable"), ("word", "type"), ("k", "primary_key")],  # null keys equal each other
        4: [],
        5: [("k", "primary_key")],
    }


def test_checks_can_be_limited_to_their_own_columns(records):
    got = schema_rules.find_violations(records, SCHEMA, order_by=["i"], null_scope="referenced")
    assert {r.i for r in got.collect() if ("year", "check") in [(v.field, v.rule) for v in r.violations]} == {1, 2, 4}


def test_split_is_a_partition(records):
    judged = schema_rules.find_violations(records, SCHEMA, order_by=["i"])
    valid, aside = schema_rules.split_valid(judged)
    assert sorted(r.i for r in valid.collect()) == [0, 4]
    assert sorted(r.record.i for r in aside.collect()) == [1, 2, 3, 5]
    assert valid.columns == records.columns
    assert rows(schema_rules.quarantine_stats(judged)) == [(6, 4, 2)]


def test_what_cannot_be_evaluated_passes(spark):
    df = spark.createDataFrame([("abc", 1, 0), ("7", 2, 1)], "word string, n int, zero int")
    evaluate = lambda e: [r[0] for r in df.select(schema_rules.holds(df, e)).collect()]
    assert evaluate("word > 10") == [True, False]
    assert evaluate("word = 'abc'") == [True, False]
    assert evaluate("n / zero > 5") == [True, False]
    assert evaluate("word > 10 AND word <> 'word'") == [True, False]
    assert evaluate("length(word) > 2 AND n > 0") == [True, False]
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert evaluate("n >>> nonsense(") == [True, True]
        assert evaluate("absent > 3") == [True, True]
    assert sum("cannot be evaluated" in str(w.message) for w in caught) == 2


def test_type_checks_on_text_cells(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("x",), ("",), (None,)], "c string")
    judge = lambda t: [
        r[0] for r in df.select(schema_rules.has_type(F.col("c"), df.schema["c"].dataType, t, "text")).collect()
    ]
    assert judge("integer") == [True, False, False, True, True]
    assert judge("float") == [True, True, False, True, True]
    assert judge("string") == [False, False, True, True, True]
    assert judge("boolean") == [False, False, False, True, True]
    assert judge("whatever") == [True] * 5


@pytest.mark.parametrize("broadcast", [True, False])
def test_primary_key_duplicates(spark, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    df = spark.createDataFrame(
        [(0, "a", 1), (1, "a", 1), (2, None, None), (3, "a", 1), (4, None, None), (5, "b", None), (6, "b", 2)],
        "i int, k string, l int",
    )
    got = keys.primary_key_duplicates(df, ["k", "l"], ["i"]).select("i", "first_i")
    assert rows(got) == [(1, 0), (3, 0), (4, 2)]
    several = keys.primary_key_duplicates(df, ["k"], ["k", "i"]).select("i", "first_i")
    assert rows(several) == [(1, 0), (3, 0), (4, 2), (6, 5)]
    marked = keys.mark_duplicates(df, ["absent"], ["i"])
    assert marked.columns == [*df.columns, keys.FIRST]
    assert sorted(r.i for r in marked.where("__first is not null").collect()) == [1, 2, 3, 4, 5, 6]


def test_a_key_needs_an_order(records):
    with pytest.raises(ValueError, match="order_by"):
        schema_rules.find_violations(records, SCHEMA)


def test_rules_as_rows_equal_the_models_report(spark):
    """Three hundred rules over texts, numbers, NaN and nulls; absent columns fail or are left out."""
    import random

    r = random.Random(6)
    data = [(r.choice([None, 1, -2, 30]), r.choice([None, "", " ", "7", "x"]), r.choice([None, float("nan"), 0.5, -3.0])) for _ in range(200)]
    df = spark.createDataFrame(data, "a int, b string, c double")
    rules, columns = [], {}
    for k in range(300):
        name, check = r.choice(["a", "b", "c", "absent"]), r.choice(["not_null", "positive", "range", "odd"])
        low, high = r.choice([None, -5.0, 0.0, 7.0]), r.choice([None, 0.0, 8.0, 40.0])
        own = columns.setdefault(name, [])
        own.append({"check": check, "params": {"min": low, "max": high}})
        rules.append((name, len(own), check, low, high))
    table = spark.createDataFrame([*rules, rules[0], ("a", None, None, None, None)], "column_name string, check_no int, check string, min double, max double")
    model = {"columns": [{"column_name": n, "quality_checks": c} for n, c in columns.items()]}
    for missing in ("fail", "skip"):
        assert rows(quality.report_from_rules(df, table, missing)) == rows(quality.quality_report(df, model, missing))
    assert quality.report_from_rules(df, table.limit(0)).collect() == []
    assert {x.failed_count for x in quality.report_from_rules(df.limit(0), table).collect()} == {0}


def test_rules_as_rows_never_meet_the_rows_in_pairs(spark):
    """As many bounds as rows, some equal to values, crossed, infinite or NaN: no join makes more rows than there are rules."""
    nan, inf = float("nan"), float("inf")
    values = [None, nan, inf, -inf, -0.0, 0.0, *(float(i % 97) / 4 for i in range(2000))]
    df = spark.createDataFrame([(v, [1]) for v in values], "a double, held array<int>")
    bounds = [None, nan, inf, -inf, -0.0, 0.0, 3.0, 3.1, 24.0, 99.0]
    rules = [("a", i, "range", low, high) for i, (low, high) in enumerate((low, high) for low in bounds for high in bounds)]
    rules += [("a", 100 + i, "range", i / 100, 24 - i / 100) for i in range(1900)]
    table = spark.createDataFrame([*rules, ("held", 1, "not_null", None, None)], "column_name string, check_no int, check string, min double, max double")
    report = quality.report_from_rules(df, table)
    got = {r.check_no: r.failed_count for r in report.where("column_name = 'a'").collect()}
    numbers = [v for v in values if v is not None and v == v]
    at_least = lambda v, low: low is None or low == low and v >= low
    at_most = lambda v, high: high is None or high != high or v <= high
    assert got == {no: len(values) - sum(at_least(v, low) and at_most(v, high) for v in numbers) for _, no, _, low, high in rules}
    assert report.count() == len(rules) + 1
    report.collect()
    node, most = [report._jdf.queryExecution().executedPlan()], 0
    while node:
        plan = node.pop()
        if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
        if plan.nodeName() == "AdaptiveSparkPlan":
            node.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            node.append(plan.plan())
        node += [plan.children().apply(i) for i in range(plan.children().size())]
    assert "CartesianProduct" not in report._jdf.queryExecution().toString()
    assert most <= 2 * len(rules)
