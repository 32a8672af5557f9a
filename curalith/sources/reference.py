"""Reference data and quality models kept as JSON documents."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_SCHEMA = (
    "schema_version string, columns array<struct<column_name: string, data_type: string, "
    "constraints: struct<is_nullable: boolean>, "
    "quality_checks: array<struct<check: string, params: struct<min: double, max: double>>>>>"
)


def load_document(spark: SparkSession, path: str) -> dict:
    """One specification or model, JSON or YAML, as a dict. A ``manifest:`` wrapper is taken
    off. These documents are written by hand and small."""
    text = spark.read.text(path, wholetext=True).head().value
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional: only YAML documents need it

        loaded = yaml.safe_load(text)
    else:
        loaded = json.loads(text)
    return loaded.get("manifest", loaded)


def read_reference_data(spark: SparkSession, path: str) -> DataFrame:
    """``{"mappings": {name: code}}`` as rows ``name, code, position``. A document that is no
    JSON, or has no ``mappings``, is an error; it would read as a table without codes."""
    refusal = F.raise_error(F.lit(f"no reference data with mappings in {path}")).cast("map<string,string>")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", "mappings map<string,string>").alias("doc"))
        .select(F.coalesce("doc.mappings", refusal).alias("mappings"))
        .select(F.posexplode("mappings").alias("position", "name", "code"))
        .select("name", "code", "position")
    )


def find_reference_data(spark: SparkSession, catalog: Mapping[str, str], name: str) -> DataFrame:
    """Reference data by its name in a catalog of paths."""
    if name not in catalog:
        raise ValueError(f"reference data {name!r} not found; available: {sorted(catalog)}")
    return read_reference_data(spark, catalog[name])


def read_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    """A quality model as rows, one per check; a column without checks has one null check."""
    model = spark.read.schema(MODEL_SCHEMA).json(path, multiLine=True)
    columns = model.select(F.explode("columns").alias("c"))
    return columns.select(
        F.col("c.column_name"),
        F.col("c.data_type"),
        F.col("c.constraints.is_nullable"),
        F.posexplode_outer("c.quality_checks").alias("check_no", "q"),
    ).select(
        "column_name",
        "data_type",
        "is_nullable",
        (F.col("check_no") + 1).alias("check_no"),
        F.col("q.check"),
        F.col("q.params.min"),
        F.col("q.params.max"),
    )
