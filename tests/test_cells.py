from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalith.functions import cells, text
from curalith.functions.checks import passes


def python_reading(value: str):
    """What the cell rule means, one cell at a time."""
    value = value.strip()
    try:
        return float(value) if "." in value else int(value)
    except ValueError:
        return value if value else None


EDGE = [
    " 1.5 ", "", "  ", "1e5", "1.0e5", "3.", ".5", ".", "1.5d", "1.5.2", "01", "+7", "-0", "- 1", "1_000", "1__0", "_1",
    "99999999999999999999", "9223372036854775807", "9223372036854775808", "nan", "inf", "1.e3", "1.5f", "x.y", "\t8\n", "0x10",
]


def class_of(value) -> int:
    if value is None:
        return cells.EMPTY
    if isinstance(value, float):
        return cells.FLOAT
    if isinstance(value, int):
        return cells.LONG if -(2**63) <= value < 2**63 else cells.BIG_INTEGER
    return cells.TEXT


def test_cell_classes_follow_the_rule(spark):
    rng = random.Random(7)
    made = ["".join(rng.choice("0123456789._eE+- x") for _ in range(rng.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(c,) for c in EDGE + made], "c string")
    got = df.select("c", cells.cell_class(F.col("c")).alias("k"), *[
        cells.read_cell(F.col("c"), t).alias(n) for n, t in (("i", T.LongType()), ("d", T.DoubleType()), ("s", T.StringType()))
    ]).collect()
    for row in got:
        want = python_reading(row.c)
        assert row.k == class_of(want), row.c
        if row.k == cells.LONG:
            assert row.i == want
        if row.k == cells.FLOAT:
            assert row.d == want
        assert row.s == (row.c.strip() or None)


@pytest.mark.parametrize(
    ("of_type", "check", "params", "good", "bad"),
    [
        ("string", "not_null", {}, ["x", " x "], [None, "", "  ", "\t"]),
        ("double", "not_null", {}, [0.0, float("nan")], [None]),
        ("double", "positive", {}, [0.1, float("inf")], [None, 0.0, -1.0, float("nan")]),
        ("string", "positive", {}, ["1", " 2.5 ", "1e5", "inf"], [None, "", "0", "-1", "x", "1.5d", "nan"]),
        ("boolean", "positive", {}, [True], [False, None]),
        ("date", "positive", {}, [], [None]),
        ("int", "range", {"min": 1, "max": 3}, [1, 2, 3], [None, 0, 4]),
        ("double", "range", {"min": 1}, [1.0, 1e300], [None, 0.5, float("nan")]),
        ("double", "range", {}, [1.0, -1e300], [None, float("nan")]),
        ("string", "range", {"max": 9}, ["9", "-3"], ["10", "ten", None]),
        ("string", "never_heard_of", {}, ["x", None], []),
    ],
)
def test_checks(spark, of_type, check, params, good, bad):
    df = spark.createDataFrame([(v,) for v in [*good, *bad]], f"v {of_type}")
    got = [r[0] for r in df.select(passes(F.col("v"), df.schema["v"].dataType, check, params)).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_path_and_log_functions(spark):
    paths = ["wild/jobs/a.csv", "people/b.tar.gz", "wild//c", "", "wild/x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(text.agency_of(F.col("p"))).collect()] == ["jobs", "people", "unknown", "unknown", "x"]
    assert [r[0] for r in df.select(text.stem(F.col("p"))).collect()] == ["a", "b.tar", "c", "", "x"]
    logs = spark.createDataFrame([("DONE: a.csv -> raw-1",), ("nothing",), ("DONE: a.csv",)], "m string")
    assert [tuple(r) for r in logs.select(text.copied_from(F.col("m")), text.copied_to(F.col("m"))).collect()] == [
        ("a.csv", "raw-1"), ("unknown", "unknown"), ("unknown", "unknown"),
    ]
    seqs = spark.createDataFrame([(7,), (12345,)], "n bigint")
    assert [r[0] for r in seqs.select(text.sequence_label("raw", F.col("n"))).collect()] == ["raw-0007", "raw-12345"]


def test_version_keys_order_as_numbers(spark):
    versions = ["1.10.0", "1.2.1", "1.0", "1.0.0", "1.0.0-beta", "beta", "2"]
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    ordered = [r.v for r in df.orderBy(text.version_key(F.col("v")), "v").collect()]
    want = sorted(versions, key=lambda v: (tuple(int(p) for p in v.split(".") if p.isdigit()), v))
    assert ordered == want
