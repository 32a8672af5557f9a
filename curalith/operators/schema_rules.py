"""Row validation against a declared schema, with quarantine instead of failure.

A schema is ``{"primary_key": [...], "fields": [{"name", "type", "nullable",
"constraints": [{"type": "check", "expression"}]}]}``. Every rule becomes one entry of
the array column ``violations``; valid rows hold an empty one.
"""

from __future__ import annotations

import logging
import re
import warnings
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalith.functions.cells import BIG_INTEGER, EMPTY, FLOAT, FLOAT_TEXT, LONG, TEXT, cell_class
from curalith.operators.keys import FIRST, mark_duplicates
from curalith.operators.project import column

VIOLATIONS = "violations"

#: Which kinds of value each declared type takes. Types not named here take any value.
ACCEPTED = {
    "string": ("text",),
    "integer": ("whole",),
    "float": ("whole", "fraction"),
    "number": ("whole", "fraction"),
    "boolean": ("truth",),
}


def _kind(of_type: T.DataType) -> str:
    if isinstance(of_type, T.StringType):
        return "text"
    if isinstance(of_type, T.BooleanType):
        return "truth"
    if isinstance(of_type, T.IntegralType) or (isinstance(of_type, T.DecimalType) and of_type.scale == 0):
        return "whole"
    if isinstance(of_type, (T.FractionalType, T.DecimalType)):
        return "fraction"
    return "other"


def has_type(value: Column, of_type: T.DataType, declared: str, cells: str = "typed") -> Column:
    """Whether a value has the declared type; null does. With ``cells="text"`` the column
    holds unparsed cells, and each is judged by the number grammar it follows."""
    accepted = ACCEPTED.get(declared.lower())
    if accepted is None:
        return F.lit(True)
    if cells == "text":
        classes = {"whole": (LONG, BIG_INTEGER), "fraction": (FLOAT,), "text": (TEXT,), "truth": ()}
        allowed = [EMPTY, *[c for kind in accepted for c in classes[kind]]]
        return cell_class(value).isin(allowed)
    return value.isNull() | F.lit(_kind(of_type) in accepted)


def _evaluates(spark: SparkSession, schema: T.StructType, expression: str) -> str | None:
    """Why Spark rejects a condition over columns of these types; None when it does not."""
    log = logging.getLogger("SQLQueryContextLogger")  # a rejection is an answer here, not an error
    was, log.disabled = log.disabled, True
    try:
        spark.createDataFrame([], schema).select(F.expr(expression).cast("boolean")).schema
    except (AnalysisException, ParseException) as problem:
        return str(problem)
    finally:
        log.disabled = was
    return None


def _read_texts_as_numbers(df: DataFrame, expression: str) -> str:
    """The condition with those text columns read as numbers that it uses as numbers.

    Left alone, a word in such a column is an error in each row that holds one. A column
    is used as a number if the condition suits a double in its place, but not a boolean,
    which texts can be compared with.
    """

    def retyped(name: str, of_type: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(f.name, of_type if f.name == name else f.dataType) for f in df.schema.fields])

    spark = df.sparkSession
    for field in df.schema.fields:
        named = re.compile(rf"(?<![\w.`]){re.escape(field.name)}(?![\w.`(])")
        if not isinstance(field.dataType, T.StringType) or not named.search(expression):
            continue
        if _evaluates(spark, retyped(field.name, T.BooleanType()), expression) is None:
            continue
        if _evaluates(spark, retyped(field.name, T.DoubleType()), expression) is not None:
            continue
        # The pattern comes first: a failing try_cast is far slower than a failing match.
        number = f"CASE WHEN rlike({field.name}, r'{FLOAT_TEXT}') THEN try_cast({field.name} AS double) END"
        outside_quotes = re.split(r"('[^']*')", expression)
        outside_quotes[::2] = [named.sub(lambda _: f"({number})", part) for part in outside_quotes[::2]]
        expression = "".join(outside_quotes)
    return expression


def holds(df: DataFrame, expression: str, null_scope: str = "row") -> Column:
    """Whether a SQL condition holds for a row.

    A row with a null in any column passes (``null_scope="row"``); with ``"referenced"``
    only a condition that itself comes out null passes. What cannot be evaluated passes
    too: a text Spark rejects with a warning, an error in a row (a word compared with a
    number, a division by zero) silently.
    """
    if null_scope not in ("row", "referenced"):
        raise ValueError(f"null_scope must be row or referenced, not {null_scope!r}")
    problem = _evaluates(df.sparkSession, df.schema, expression)
    if problem is not None:
        warnings.warn(f"check {expression!r} cannot be evaluated and passes: {problem}", stacklevel=2)
        return F.lit(True)
    safe = _read_texts_as_numbers(df, expression)
    # try_to_binary turns an error raised below it into null, which is what lets a failing
    # evaluation pass under ANSI mode.
    outcome = F.expr(f"try_to_binary(cast(cast(({safe}) as boolean) as string), 'utf-8')")
    passed = F.coalesce(outcome.cast("string") != "false", F.lit(True))
    if null_scope == "referenced":
        return passed
    any_null = F.lit(False)
    for name in df.columns:
        any_null = any_null | column(name).isNull()
    return any_null | passed


_ENTRIES = "array<struct<field:string,rule:string,detail:string>>"


def _violation(broken: Column, field: str, rule: str, detail: str | Column) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    entry = F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), detail.alias("detail"))
    return F.when(broken, F.array(entry)).otherwise(F.array().cast(_ENTRIES))


def find_violations(
    df: DataFrame,
    schema: Mapping,
    *,
    order_by: Sequence[str] = (),
    cells: str = "typed",
    null_scope: str = "row",
) -> DataFrame:
    """Every row, with its ``violations``. A primary key needs ``order_by`` to tell which
    row of a key comes first."""
    types = {f.name: f.dataType for f in df.schema.fields}
    found: list[Column] = []
    for field in schema.get("fields", []):
        name, declared = field["name"], field.get("type", "string")
        value = column(name) if name in types else F.lit(None).cast("string")
        typed = has_type(value, types.get(name, T.StringType()), declared, cells)
        found.append(_violation(~typed, name, "type", declared))
        if not field.get("nullable", True):
            missing = cell_class(value) == EMPTY if cells == "text" else value.isNull()
            found.append(_violation(missing, name, "nullable", "null"))
        for constraint in field.get("constraints", []):
            if constraint.get("type") == "check":
                expression = constraint.get("expression", "")
                found.append(_violation(~holds(df, expression, null_scope), name, "check", expression))

    keys = list(schema.get("primary_key", []))
    if keys:
        if not order_by:
            raise ValueError("a primary key needs order_by: without an order no row is the first")
        marked = mark_duplicates(df, keys, order_by)
        found.append(_violation(F.col(FIRST).isNotNull(), ",".join(keys), "primary_key", F.concat(F.lit("duplicate of row "), F.col(FIRST).cast("string"))))
    else:
        marked = df
    return marked.withColumn(VIOLATIONS, F.concat(F.array().cast(_ENTRIES), *found)).drop(FIRST)


def split_valid(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows as they came, and the quarantined ones as ``record`` and ``violations``.
    Each row goes to exactly one side."""
    rows = [c for c in annotated.columns if c != VIOLATIONS]
    valid = annotated.where(F.size(VIOLATIONS) == 0).drop(VIOLATIONS)
    quarantined = annotated.where(F.size(VIOLATIONS) > 0).select(
        F.struct(*[column(c) for c in rows]).alias("record"), F.col(VIOLATIONS)
    )
    return valid, quarantined


def quarantine_stats(annotated: DataFrame) -> DataFrame:
    """One row: total, quarantined and valid rows."""
    return annotated.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.size(VIOLATIONS) > 0).alias("quarantined_count"),
        F.count_if(F.size(VIOLATIONS) == 0).alias("valid_count"),
    )
