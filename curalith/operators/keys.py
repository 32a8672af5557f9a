"""Primary keys: which rows repeat a key, and which row had it first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.operators.matching import match
from curalith.operators.project import column

FIRST = "__first"


def order_value(order_by: Sequence[str]) -> Column:
    """The order as one comparable column."""
    return column(order_by[0]) if len(order_by) == 1 else F.struct(*[column(c) for c in order_by])


def repeated_keys(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keys held by several rows, with the order value of the first. Null key parts equal
    each other. The count and the minimum combine before the shuffle, so a key that fills
    a third of the table sends one row per task.

    The minimum of several columns is that of a struct, for which Spark has to sort; so the
    keys that repeat are counted first, and only their rows are looked at for it.
    """
    names = [f"__key_{i}" for i in range(len(keys))]
    rows = df.select(*[column(k).alias(n) for k, n in zip(keys, names)], order_value(order_by).alias("__order"))
    if len(order_by) == 1:
        counted = rows.groupBy(*names).agg(F.min("__order").alias(FIRST), F.count(F.lit(1)).alias("__rows"))
        return counted.where(F.col("__rows") > 1).drop("__rows")
    several = rows.groupBy(*[F.col(n).alias(f"{n}_s") for n in names]).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > 1)
    again = rows.join(several, match(*[(F.col(n), F.col(f"{n}_s")) for n in names]), "left_semi")
    return again.groupBy(*names).agg(F.min("__order").alias(FIRST))


def same_key(keys: Sequence[str]) -> Column:
    """Match of ``keys`` against :func:`repeated_keys`, in which null parts equal each other."""
    return match(*[(column(key), F.col(f"__key_{i}")) for i, key in enumerate(keys)])


def mark_duplicates(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Every row, with ``__first`` set on those whose key an earlier row holds.

    ``order_by`` must tell the rows of a key apart (a record index does). Key columns the
    data lacks read as null, so a key of only such columns makes all rows but the first
    duplicates.
    """
    absent = [k for k in keys if k not in df.columns]
    full = df.withColumns({k: F.lit(None).cast("string") for k in absent}) if absent else df
    joined = full.join(repeated_keys(full, keys, order_by), same_key(keys), "left")
    later = F.when(order_value(order_by) > F.col(FIRST), F.col(FIRST))
    return joined.withColumn(FIRST, later).drop(*[f"__key_{i}" for i in range(len(keys))], *absent)


def primary_key_duplicates(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Only the rows that repeat a key, with the order value of the first as ``first_<name>``."""
    firsts = repeated_keys(df, keys, order_by)
    later = df.join(firsts, same_key(keys), "inner").where(order_value(order_by) > F.col(FIRST))
    seen = [F.col(FIRST)] if len(order_by) == 1 else [F.col(FIRST)[c] for c in order_by]
    return later.withColumns({f"first_{c}": value for c, value in zip(order_by, seen)}).drop(
        FIRST, *[f"__key_{i}" for i in range(len(keys))]
    )
