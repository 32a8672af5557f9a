"""The run ledger: append-only events per run, folded to its current state on reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.operators.prefix import sequence_numbers
from curalith.operators.project import column

# The states a run goes through, and their time stamps.
STATUSES = ("QUEUED", "STARTED", "SUCCESS", "FAILURE")


def same_layer(layer: Column, wanted: str) -> Column:
    """Layer test in which ``semantic`` and ``semantics`` are one."""
    names = ("semantic", "semantics") if wanted in ("semantic", "semantics") else (wanted,)
    return layer.isin(*names)


def fold_runs(
    events: DataFrame, *, run: str = "run_id", order_by: Sequence[str] = ("ts", "seq"), fields: Sequence[str] | None = None
) -> DataFrame:
    """One row per run: for each field the last value an event set (null sets nothing),
    with ``created_at`` of the first event and ``updated_at`` of the last. It does not
    matter in which order the events were stored."""
    fields = [c for c in events.columns if c not in (run, *order_by)] if fields is None else fields
    when = F.struct(*[column(c) for c in order_by])
    return events.groupBy(column(run).alias(run)).agg(
        *[F.max_by(column(c), F.when(column(c).isNotNull(), when)).alias(c) for c in fields],
        F.min(column(order_by[0])).alias("created_at"),
        F.max(column(order_by[0])).alias("updated_at"),
    )


def status_times(
    events: DataFrame,
    *,
    run: str = "run_id",
    status: str = "status",
    ts: str = "ts",
    statuses: Sequence[str] = STATUSES,
) -> DataFrame:
    """One row per run with the last time of each status, as ``<status>_at``."""
    return events.groupBy(column(run).alias(run)).agg(
        *[F.max(F.when(column(status) == s, column(ts))).alias(f"{s.lower()}_at") for s in statuses]
    )


def matching_runs(
    runs: DataFrame,
    *,
    spec_id: str | None = None,
    spec_version: str | None = None,
    status: str | None = None,
    layer: str | None = None,
    replays: bool = True,
    contains: str | None = None,
) -> DataFrame:
    """Ledger filters; ``contains`` matches any spec id that holds the text."""
    if spec_id is not None:
        runs = runs.where(F.col("spec_id") == spec_id)
    if spec_version is not None:
        runs = runs.where(F.col("spec_version") == spec_version)
    if status is not None:
        runs = runs.where(F.col("status") == status)
    if layer is not None:
        runs = runs.where(same_layer(F.col("layer"), layer))
    if not replays:
        runs = runs.where(~F.coalesce(F.col("replay_mode"), F.lit(False)))
    if contains is not None:
        runs = runs.where(F.contains("spec_id", F.lit(contains)))
    return runs


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of each key. Equal orders are settled by the other columns, so the
    result is the same on every run; the maximum combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    ranked = F.struct(*[column(c) for c in (*order_by, *rest)])
    picked = df.groupBy(*[column(k) for k in keys]).agg(F.max(ranked).alias("__row"))
    return picked.select(
        *[column(c) if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns]
    )


def latest_evidence(runs: DataFrame, layer: str | None = None) -> DataFrame:
    """The most recent run, of a layer or of all; records without a run id are left out."""
    found = runs.where(F.col("run_id").isNotNull())
    if layer is not None:
        found = found.where(same_layer(F.col("layer"), layer))
    order = F.struct("created_at", "run_id")
    picked = found.agg(F.max_by(F.struct(*[column(c) for c in found.columns]), order).alias("__row"))
    return picked.where(F.col("__row").isNotNull()).select("__row.*")


def first_success(runs: DataFrame) -> DataFrame:
    """Per spec and version the oldest run that succeeded and was no replay."""
    originals = matching_runs(runs, status="SUCCESS", replays=False)
    return originals.groupBy("spec_id", "spec_version").agg(
        F.min(F.struct("created_at", "run_id")).alias("__first")
    ).select("spec_id", "spec_version", F.col("__first.run_id").alias("run_id"), F.col("__first.created_at").alias("created_at"))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs, newest first."""
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id")).limit(limit)


def deployment_history(deployments: DataFrame, spec_id: str, version: str | None = None) -> DataFrame:
    """Deployments of one spec, or of one version of it, newest first."""
    found = deployments.where(F.col("spec_id") == spec_id)
    if version is not None:
        found = found.where(F.col("version") == version)
    return found.orderBy(F.col("deployed_at").desc())


def store_sequence(rows: DataFrame, store: str, created: str = "created_at", run: str = "run_id") -> DataFrame:
    """1-based sequence number of each row within its store, by creation time."""
    return sequence_numbers(rows, order_by=[created, run], partition_by=[store])


def bill_of_materials(runs: DataFrame) -> DataFrame:
    """The components of each run, one row per step in order of ``step_no``."""
    return runs.select("run_id", "status", "spec_id", F.inline("components"))
