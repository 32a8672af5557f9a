"""Spec versions: their order, what a deployment replaces, and what it may not do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.functions.text import version_key
from curalith.operators.matching import match
from curalith.operators.prefix import prefix_scan, sequence_numbers


def _rank() -> Column:
    """Comparable rank of a deployment: the higher version; of equal ones the earlier."""
    return F.struct(
        version_key(F.col("version")).alias("key"),
        (-F.unix_micros(F.col("deployed_at").cast("timestamp"))).alias("earlier"),
        F.col("version").alias("version"),
    )


def version_order(deployed: DataFrame) -> DataFrame:
    """Every version of each spec once, with its position: ``1.2.1`` comes before ``1.10.0``."""
    versions = deployed.select("spec_id", "version").distinct().withColumn("__key", version_key(F.col("version")))
    return sequence_numbers(
        versions, order_by=["__key", "version"], partition_by=["spec_id"], bucket=F.slice("__key", 1, 2), name="position"
    ).drop("__key")


def version_summary(deployed: DataFrame) -> DataFrame:
    """Per spec its latest version and how many it has; :func:`version_order` lists them."""
    versions = deployed.groupBy("spec_id", "version").agg(F.min("deployed_at").alias("deployed_at"))
    return versions.groupBy("spec_id").agg(
        F.max(_rank()).getField("version").alias("latest_version"), F.count(F.lit(1)).alias("version_count")
    )


def previous_versions(deployed: DataFrame) -> DataFrame:
    """Each deployment with the version that was the latest when it came: the highest
    deployed before it, whether or not that was the last one."""
    scanned = prefix_scan(
        deployed, "__before", _rank(), "max", order_by=["deployed_at", "version"], partition_by=["spec_id"], inclusive=False
    )
    return scanned.withColumn("previous_version", F.col("__before.version")).drop("__before")


def classify_publish(candidates: DataFrame, registered: DataFrame, force: bool = False) -> DataFrame:
    """What publishing each candidate means, given what is registered.

    The same version with the same content is SKIPPED, with other content a VIOLATION
    (deployed all the same with ``force``), and a new version is DEPLOYED. It becomes the
    latest only when it is higher than the current latest.
    """
    named = registered.where(F.col("spec_id").isNotNull() & F.col("version").isNotNull())
    known = named.groupBy("spec_id", "version").agg(
        F.max_by("content_hash", "deployed_at").alias("__hash"), F.min("deployed_at").alias("deployed_at")
    )
    latest = known.groupBy(F.col("spec_id").alias("__spec")).agg(F.max(_rank()).getField("version").alias("__latest"))
    known = known.select(F.col("spec_id").alias("__id"), F.col("version").alias("__version"), "__hash")
    same = F.col("__hash") == F.col("content_hash")
    status = (
        F.when(F.col("__hash").isNull(), "DEPLOYED")
        .when(same, "SKIPPED")
        .otherwise("DEPLOYED" if force else "VIOLATION")
    )
    newer = F.col("__latest").isNull() | (version_key(F.col("version")) > version_key(F.col("__latest")))
    return (
        candidates.join(known, match((F.col("spec_id"), F.col("__id")), (F.col("version"), F.col("__version"))), "left")
        .join(latest, match((F.col("spec_id"), F.col("__spec"))), "left")
        .withColumn("status", status)
        .withColumn("previous_version", F.when(F.col("status") == "DEPLOYED", F.col("__latest")))
        .withColumn("is_latest", (F.col("status") == "DEPLOYED") & newer)
        .drop("__id", "__version", "__hash", "__spec", "__latest")
    )
