"""Running values over ordered groups of any size.

A window over a group runs in one task, however large the group. Here the rows are cut into
even ranges of (group, order), whatever their types: the bounds come from a uniform sample of
bounded size. A small summary with one row per range of a group yields what each range inherits
from those before it; that carry enters the range as its first row, and one window per
(group, range) does the rest. The rows move once, and a hot group spreads over as many tasks
as it has ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalith.operators.project import column

_BUCKET, _VALUE, _ROW = "__bucket", "__value", "__is_row"
#: Ranges for each shuffle partition, and sampled rows for each range.
RANGES_PER_PARTITION, SAMPLE_PER_RANGE = 2, 40


def _sortable(df: DataFrame, name: str) -> Column | None:
    """A column that orders as ``name`` does and whose values can be written as literals; None if there is none."""
    of_type, c = df.schema[name].dataType, column(name)
    if isinstance(of_type, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(of_type, T.DateType):
        return F.unix_date(c)
    if isinstance(of_type, T.TimestampNTZType):
        seconds = (F.unix_date(F.to_date(c)).cast("bigint") * 24 + F.hour(c)) * 3600 + F.minute(c) * 60
        return seconds + F.date_part(F.lit("SECOND"), c)
    if isinstance(of_type, T.BinaryType):
        return F.hex(c)
    return c if isinstance(of_type, (T.NumericType, T.StringType, T.BooleanType)) else None


def range_number(df: DataFrame, names: Sequence[str]) -> Column:
    """Number of the range of ``names`` that a row lies in, non-decreasing in their order (nulls first).

    One job reads the named columns and keeps a uniform sample, which alone reaches the
    driver. A column of a type without literals ends the ranges' key: rows that differ only
    from there on share a range. A row finds its range by bisection.
    """
    keys: list[Column] = []
    for name in names:
        key = _sortable(df, name)
        if key is None:
            break
        keys.append(key)
    ranges = RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not keys or ranges < 2:
        return F.lit(0)
    fields = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    drawn = df.select(*fields).orderBy(F.rand(11)).limit(SAMPLE_PER_RANGE * ranges)
    sample = drawn.orderBy(*(f"k{i}" for i in range(len(keys)))).collect()
    cuts = list(dict.fromkeys(tuple(sample[k * len(sample) // ranges]) for k in range(1, ranges))) if sample else []
    kinds = [f.dataType for f in drawn.schema.fields]
    own = F.struct(*fields)

    def place(low: int, high: int) -> Column:
        """How many cuts from ``low`` to ``high`` are at most the row's key, and ``low``."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        bound = F.struct(*(F.lit(v).cast(kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(cuts[middle], kinds))))
        return F.when(own >= bound, place(middle + 1, high)).otherwise(place(low, middle))

    return place(0, len(cuts))


def prefix_scan(
    df: DataFrame,
    name: str,
    value: Column,
    how: str,
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    bucket: Column | None = None,
    descending: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add ``name``: the running ``sum``, ``max`` or ``last`` (non-null) of ``value``.

    ``order_by`` must tell the rows of a group apart. ``inclusive=False`` leaves the row
    itself out. With ``descending`` the order, and the ranges, run backwards. A ``bucket`` of
    one's own, non-decreasing in the order, spares the sampling job.
    """
    bucket = range_number(df, [*partition_by, *order_by]) if bucket is None else bucket
    groups = [column(c) for c in partition_by]
    tagged = df.withColumns({_BUCKET: bucket, _VALUE: value, _ROW: F.lit(1)})
    within = [column(c).desc() if descending else column(c).asc() for c in order_by]
    across = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()

    held = F.col(_VALUE)
    if how == "sum":
        total, running = F.sum(held), F.sum
    elif how == "max":
        total, running = F.max(held), F.max
    elif how == "last":
        pick = F.min_by if descending else F.max_by
        total = pick(held, F.when(held.isNotNull(), F.struct(*[column(c) for c in order_by])))
        running = lambda c: F.last(c, ignorenulls=True)
    else:
        raise ValueError(f"how must be sum, max or last, not {how!r}")

    summary = tagged.groupBy(*groups, F.col(_BUCKET)).agg(total.alias(_VALUE))
    earlier = Window.partitionBy(*groups).orderBy(across).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumn(_VALUE, running(held).over(earlier)).withColumn(_ROW, F.lit(0))

    here = (
        Window.partitionBy(*groups, F.col(_BUCKET))
        .orderBy(F.col(_ROW), *within)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        tagged.unionByName(carry, allowMissingColumns=True)
        .withColumn(name, running(F.col(_VALUE)).over(here))
        .where(F.col(_ROW) == 1)
        .drop(_BUCKET, _VALUE, _ROW)
    )


def sequence_numbers(
    df: DataFrame,
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    bucket: Column | None = None,
    name: str = "seq",
) -> DataFrame:
    """1-based position of each row of a group in the given order."""
    return prefix_scan(
        df, name, F.lit(1).cast("bigint"), "sum", order_by=order_by, partition_by=partition_by, bucket=bucket
    )


def record_index(
    df: DataFrame, *, order_by: Sequence[str], bucket: Column | None = None, name: str = "record_index"
) -> DataFrame:
    """0-based position of each row over the whole table in the given order."""
    return sequence_numbers(df, order_by=order_by, bucket=bucket, name=name).withColumn(name, F.col(name) - 1)
