"""Column-wise projections: case, renames, concepts, prefixes, constants, output fields."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalith.operators.matching import match

CONTEXT = "__context__"
JOIN = "__join__"
RAW_PREFIX = "_raw_"


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold_case(df: DataFrame, case: str = "keep") -> DataFrame:
    """Every string column in ``lower`` or ``upper`` case, or all columns as they are."""
    if case == "keep":
        return df
    if case not in ("lower", "upper"):
        raise ValueError(f"case must be keep, lower or upper, not {case!r}")
    fold = F.lower if case == "lower" else F.upper
    return df.select(
        *[
            fold(column(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) and not f.name.startswith("__")
            else column(f.name)
            for f in df.schema.fields
        ]
    )


def _land(targets: Iterable[tuple[str, Column]]) -> list[Column]:
    """Where several columns land on one name, the last one's value takes the first one's place."""
    landed: dict[str, Column] = {}
    for name, value in targets:
        landed[name] = value
    return [value.alias(name) for name, value in landed.items()]


def rename_fields(df: DataFrame, mappings: Mapping[str, str] | None) -> DataFrame:
    """Rename by ``{old: new}``; unmapped columns stay, names that are not there are ignored."""
    if not mappings:
        return df
    return df.select(*_land((mappings.get(name, name), column(name)) for name in df.columns))


def to_concepts(
    df: DataFrame, mapping: Sequence[Mapping[str, str]], context: Mapping[str, object] | None = None
) -> DataFrame:
    """Project physical columns to business concepts.

    A mapped column takes its concept's name, any other is kept as ``_raw_<name>``. An
    entry may carry a SQL ``transformation`` that computes the concept instead; entries
    lacking a source or a concept, and sources that are not there, are ignored. With a
    ``context`` every row gets it as the constant struct ``__context__``.
    """
    entries = [
        (m.get("source_key"), m.get("target_concept"), m.get("transformation"))
        for m in mapping
        if m.get("source_key") and m.get("target_concept")
    ]
    concepts = {source: (concept, formula) for source, concept, formula in entries}
    targets = []
    for name in df.columns:
        concept, formula = concepts.get(name, (f"{RAW_PREFIX}{name}", None))
        targets.append((concept, F.expr(formula) if formula else column(name)))
    out = df.select(*_land(targets))
    return out if context is None else attach_context(out, context)


def attach_context(df: DataFrame, context: Mapping[str, object]) -> DataFrame:
    """The same struct on every row; null entries are kept as null strings."""
    entries = [
        (F.lit(None).cast("string") if value is None else F.lit(value)).alias(key) for key, value in context.items()
    ]
    return df.withColumn(CONTEXT, F.struct(*entries) if entries else F.lit(None).cast("string"))


def prefix_side(df: DataFrame, prefix: str) -> DataFrame:
    """Prefix every column name; bookkeeping columns (``__...``) are left out."""
    return df.select(*[column(c).alias(f"{prefix}{c}") for c in df.columns if not c.startswith("__")])


def attach_envelope(df: DataFrame, **metadata: object) -> DataFrame:
    """Run metadata as constant columns."""
    return df.withColumns({k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in metadata.items()})


def identity_first(df: DataFrame, identity: Sequence[str] = ("run_id", "doc_id")) -> DataFrame:
    """Identity columns first, the others in their order."""
    lead = [c for c in identity if c in df.columns]
    return df.select(*[column(c) for c in lead], *[column(c) for c in df.columns if c not in lead])


def inherit_parent(df: DataFrame, parents: DataFrame, new_doc_id: str) -> DataFrame:
    """Take ``doc_id`` and ``curation_run_id`` from the bound parent run.

    ``parents`` holds one row per ``run_id``; where it knows no document the id minted
    for this run, ``new_doc_id``, is used.
    """
    known = parents.where(F.col("run_id").isNotNull()).select(F.col("run_id").alias("__run"), F.col("doc_id").alias("__doc"))
    joined = df.join(known, match((F.col("curation_run_id"), F.col("__run"))), "left")
    return joined.withColumn("doc_id", F.coalesce("__doc", F.lit(new_doc_id))).drop("__run", "__doc")


def output_fields(
    df: DataFrame, include_fields: Sequence[str] = (), exclude_fields: Sequence[str] = ()
) -> DataFrame:
    """Keep only ``include_fields`` (all when empty), then drop ``exclude_fields``."""
    kept = [c for c in df.columns if not include_fields or c in include_fields]
    return df.select(*[column(c) for c in kept if c not in exclude_fields])


def distinct_documents(*ids: Column) -> Column:
    """Distinct document ids of several parents in their order, nulls left out."""
    return F.array_distinct(F.array_compact(F.array(*ids)))
