"""Lookup of codes in reference data: exact name first, then regardless of case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalith.operators.matching import match
from curalith.operators.project import column


def _is_set(value: Column, of_type: T.DataType) -> Column:
    """Neither null nor empty, zero or false."""
    if isinstance(of_type, T.StringType):
        return F.coalesce(value != "", F.lit(False))
    if isinstance(of_type, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(of_type, T.NumericType):
        return F.coalesce(value != 0, F.lit(False))
    return value.isNotNull()


def _is_unset_text(name: Column, of_type: T.DataType) -> Column:
    """Whether a text is that of a value which is not set, such as the empty text or zero."""
    if isinstance(of_type, T.BooleanType):
        return name.isin("", "false")
    if isinstance(of_type, T.NumericType):
        return (name == "") | F.coalesce(name.try_cast("double") == 0, F.lit(False))
    return name == ""


def _dimension(dim: DataFrame, name: Column, code: Column, order: Column | None, of_type: T.DataType) -> DataFrame:
    """One row per folded name: the codes of its spellings, and the code of any spelling.

    Of several entries the last by ``order`` holds. Values that are not set share the
    folded name of the empty text.
    """
    entries = dim.select(name.alias("n"), code.cast("string").alias("c"), (order if order is not None else code).alias("o"))
    entries = entries.where(F.col("n").isNotNull())
    spelled = entries.groupBy("n").agg(F.max_by("c", "o").alias("c"), F.max("o").alias("o"))
    folded = F.when(_is_unset_text(F.col("n"), of_type), F.lit("")).otherwise(F.lower("n"))
    here = F.lower("n") == F.col("__name")
    return (
        spelled.withColumn("__name", folded)
        .groupBy("__name")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("n", "c"))).alias("__spellings"),
            F.max_by("c", F.when(here, F.col("o"))).alias("__any"),
        )
    )


def enrich(
    df: DataFrame,
    dim: DataFrame,
    source: str,
    target: str,
    *,
    name: str = "name",
    code: str = "code",
    order: str | None = None,
) -> DataFrame:
    """Add ``target``: the code of the value in ``source``; null where there is none.

    The row count never changes. Both tiers are in one row of the dimension, so the rows
    are joined once: Spark broadcasts a small dimension, and splits the rows of a hot value
    where it is not small.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    of_type = fields.get(source, T.StringType())
    value = column(source) if source in fields else F.lit(None).cast("string")
    text = value.cast("string")
    folded = F.when(_is_set(value, of_type), F.lower(text)).otherwise("")
    known = _dimension(dim, column(name), column(code), column(order) if order else None, of_type)
    exact = F.when(text.isNotNull(), F.try_element_at("__spellings", text))
    resolved = F.coalesce(F.nullif(exact, F.lit("")), F.nullif("__any", F.lit("")))
    keyed = df.withColumn("__folded", folded)
    hit = keyed.join(known, match((F.col("__folded"), F.col("__name"))), "left")
    return hit.withColumn(target, resolved).drop("__folded", "__name", "__spellings", "__any")


def enrichment_stats(df: DataFrame, source: str, target: str) -> DataFrame:
    """One row: rows matched, rows in all, rows with a value but no code."""
    of_type = df.schema[source].dataType
    missed = _is_set(column(source), of_type) & column(target).isNull()
    return df.agg(
        F.count_if(column(target).isNotNull()).alias("matched"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(missed).alias("unmapped"),
    )


def unmapped_values(df: DataFrame, source: str, target: str) -> DataFrame:
    """Each source value without a code, with its row count; one row per value."""
    of_type = df.schema[source].dataType
    return (
        df.where(_is_set(column(source), of_type) & column(target).isNull())
        .groupBy(column(source).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
