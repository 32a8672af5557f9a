"""Content fingerprints of rows and of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.functions.digest import chunks, lane_sums, row_digest, seal
from curalith.operators.project import column


def row_fingerprints(df: DataFrame, columns: Sequence[str] | None = None, name: str = "row_sha256") -> DataFrame:
    """Every row with the SHA-256 of its values."""
    return df.withColumn(name, row_digest(df, columns))


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One fingerprint of all rows, or one per group of ``by``.

    It depends on the rows and how often each occurs, not on their order or partitioning.
    Row digests are summed lane by lane, which combines map-side, so neither a large
    table nor a large group ever meets in one task.
    """
    digested = df.select(*[column(c) for c in by], row_digest(df, columns).alias("__digest"))
    numbered = digested.withColumns(chunks(F.col("__digest")))
    sums = numbered.groupBy(*[column(c) for c in by]).agg(F.count(F.lit(1)).alias("record_count"), *lane_sums())
    return sums.select(*[column(c) for c in by], "record_count", seal(F.col("record_count")).alias("content_hash"))
