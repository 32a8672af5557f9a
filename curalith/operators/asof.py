"""Join to the nearest row in time, per key, within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.operators import joins
from curalith.operators.joins import PRIMARY, SECONDARY
from curalith.operators.prefix import prefix_scan
from curalith.operators.project import JOIN, column

DIRECTIONS = ("backward", "forward", "nearest")


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def temporal_join(
    primary: DataFrame,
    secondary: DataFrame,
    *,
    keys: Sequence[str],
    time: str,
    tie_by: str,
    tolerance_seconds: float | None = None,
    direction: str = "backward",
    join_type: str = "left_outer",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Each primary row with the nearest secondary row of its keys.

    ``backward`` looks at times up to the row's own, ``forward`` from it on, ``nearest``
    at both, preferring the earlier of two equally near. Equal times count. Of secondary
    rows at one time the last by ``tie_by`` is taken (the first when looking forward).
    ``tie_by`` names a column of both sides that tells rows at one time apart.

    Both sides are laid into one ordered stream and the last secondary row is carried
    along it, so no pairs are formed. Even ranges of (keys, time, tie) split a key of any size;
    buckets of ``bucket_seconds`` do so without the ranges' sampling job. Times without a zone
    are compared in the session's, which should then have no summer time (UTC).
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
    if join_type not in ("inner", "left_outer"):
        raise ValueError(f"join_type must be inner or left_outer, not {join_type!r}")
    keys = list(keys)
    positions = [column(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    has_keys = F.lit(True)
    for k in keys:
        has_keys = has_keys & column(k).isNotNull()

    p = primary.select(
        *positions,
        _micros(column(time)).alias("__at"),
        column(tie_by).alias("__tie"),
        F.lit(True).alias("__primary"),
        F.struct(*[column(c).alias(f"{PRIMARY}{c}") for c in primary.columns if not c.startswith("__")]).alias("__p"),
    )
    s = secondary.where(has_keys & column(time).isNotNull()).select(
        *positions,
        _micros(column(time)).alias("__at"),
        column(tie_by).alias("__tie"),
        F.lit(False).alias("__primary"),
        F.struct(
            _micros(column(time)).alias("__at"),
            *[column(c).alias(f"{SECONDARY}{c}") for c in secondary.columns if not c.startswith("__")],
        ).alias("__s"),
    )
    names = [f"__k{i}" for i in range(len(keys))]
    stream = p.unionByName(s, allowMissingColumns=True)
    bucket = F.floor(F.col("__at") / F.lit(bucket_seconds * 1_000_000)) if bucket_seconds else None

    def carried(df: DataFrame, name: str, backwards: bool) -> DataFrame:
        # At one time the secondary rows come before the primary ones in the running order.
        lead = F.col("__primary") if not backwards else ~F.col("__primary")
        return prefix_scan(
            df.withColumn("__lead", lead),
            name,
            F.col("__s"),
            "last",
            order_by=["__at", "__lead", "__tie"],
            partition_by=names,
            bucket=bucket,
            descending=backwards,
        ).drop("__lead")

    if direction != "forward":
        stream = carried(stream, "__before", backwards=False)
    if direction != "backward":
        stream = carried(stream, "__after", backwards=True)
    rows = stream.where(F.col("__primary"))

    if direction == "nearest":
        gap_before = F.col("__at") - F.col("__before")["__at"]
        gap_after = F.col("__after")["__at"] - F.col("__at")
        earlier = F.col("__after").isNull() | (F.col("__before").isNotNull() & (gap_before <= gap_after))
        match = F.when(earlier, F.col("__before")).otherwise(F.col("__after"))
    else:
        match = F.col("__before" if direction == "backward" else "__after")
    rows = rows.withColumn("__m", match)
    near = F.col("__m").isNotNull() & F.col("__at").isNotNull()
    if tolerance_seconds is not None:
        near &= F.abs(F.col("__at") - F.col("__m")["__at"]) <= F.lit(int(tolerance_seconds * 1_000_000))
    rows = rows.withColumn("__m", F.when(near, F.col("__m")))
    if join_type == "inner":
        rows = rows.where(F.col("__m").isNotNull())
    return rows.select("__p.*", "__m.*").drop("__at")


def nearest_of_each(
    sources: Sequence[tuple[str, DataFrame]],
    keys: Sequence[str],
    *,
    time: str,
    tie_by: str,
    seconds: float | None = None,
    direction: str = "backward",
    join_type: str = "left_outer",
) -> DataFrame:
    """Each row of the first source with the nearest row of every other, ``(alias, rows)`` each.

    Columns are prefixed by alias. The sources are taken one after the other, each by
    :func:`temporal_join`. ``__join__`` names the sources that a row has; ``matched`` is false
    where one is absent.
    """
    (first, out), others = sources[0], sources[1:]
    shown = [f"{name}_{c}" for name, df in sources for c in df.columns if not c.startswith("__")]
    if len(set(shown)) < len(shown):
        raise ValueError(f"aliases make columns of one name: {sorted({c for c in shown if shown.count(c) > 1})}")
    own = [c for c in out.columns if not c.startswith("__")]
    out, held = out.select(*[column(c) for c in own]), []
    for _, df in others:
        # A row found rides along as a struct, under a name that the first source does not have.
        name = f"found_{len(held)}"
        while name in own:
            name += "_"
        met = temporal_join(
            out, df, keys=keys, time=time, tie_by=tie_by, tolerance_seconds=seconds, direction=direction, join_type=join_type
        )
        fields = [column(f"{SECONDARY}{c}").alias(c) for c in df.columns if not c.startswith("__")]
        there = column(f"{SECONDARY}{keys[0]}").isNotNull()  # only rows with all keys are found
        out = met.select(
            *[column(f"{PRIMARY}{c}").alias(c) for c in [*own, *held]], F.when(there, F.struct(*fields)).alias(name)
        )
        held.append(name)
    has = [F.lit(True), *[F.col(h).isNotNull() for h in held]]
    text = joins.key_text([column(k) for k in keys])
    return out.select(
        *[column(c).alias(f"{first}_{c}") for c in own],
        *[
            F.col(h).getField(c).alias(f"{name}_{c}")
            for h, (name, df) in zip(held, others)
            for c in df.columns
            if not c.startswith("__")
        ],
        joins.present_sources(join_type, keys, text, [name for name, _ in sources], has).alias(JOIN),
    )
