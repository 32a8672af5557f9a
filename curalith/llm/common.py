"""What several operators share: scratch tables, split points and batched mapping."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.session import ensure_checkpoint_dir

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Characters of text that a Python worker turns into arrays at one time.
CHUNK_CHARS = 1_000_000
#: Bytes of an Arrow batch, which both the JVM and the worker hold.
BATCH_BYTES = 4 << 20
#: An allocation of so many bytes goes back to the system as soon as it is let go.
RETURNED_BYTES = 256 << 10
#: glibc's name for where this begins; unset, it rises to the largest allocation let go (up to 32 MB).
_MMAP_THRESHOLD = -3


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/curalith-llm/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts its lineage, and is computed once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smaller_batches(spark: SparkSession) -> None:
    """Hands Python a few megabytes of texts at a time instead of Spark's default of 64, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    smaller_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_points(df: DataFrame, column: str, parts: int) -> np.ndarray:
    """At most ``parts - 1`` rising values that cut a whole-number column into even ranges.

    One narrow aggregate; the driver gets only the points. Nulls belong to the first range.
    """
    if parts < 2:
        return np.empty(0, np.int64)
    shares = [k / parts for k in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(column).cast("long"), shares, 20 * parts + 10_000).alias("p")).first()
    return np.unique(np.asarray(row["p"] or [], np.int64))


def range_of(column: str, points: np.ndarray) -> Column:
    """Number of the range that a value lies in; a range begins with its split point."""

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = np.zeros(len(values), np.int32)
        out[known] = np.searchsorted(points, values[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    return place(F.col(column).cast("long"))


def set_aside(docs: DataFrame, reserved) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of reserved names renamed, and what selects all columns under their own names."""
    taken, used = {}, {c.lower() for c in docs.columns} | {r.lower() for r in reserved}
    for c in docs.columns:
        if c.lower() in {r.lower() for r in reserved}:
            new = f"_{c}"
            while new.lower() in used:
                new = f"_{new}"
            taken[c] = new
            used.add(new.lower())
    back = [F.col(taken.get(c, c)).alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(taken), back


def partitions_for(spark: SparkSession) -> int:
    """How many pieces a full shuffle is dealt into: Spark's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def releasing(work: Batches) -> Batches:
    """A function of batches that gives memory back: arrays when they are let go, the rest at a task's end.

    A Python worker lives on for later tasks, of other stages too; what its allocators keep
    would count against the executor while others work. So Arrow takes memory from the
    system's allocator, as numpy does, and that keeps no large allocation for later ones.
    """

    @functools.wraps(work)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").mallopt(_MMAP_THRESHOLD, RETURNED_BYTES)
        try:
            yield from work(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list]]:
    """Slices of a batch as (first row, texts) with about ``limit`` bytes; null is empty.

    Only one slice at a time becomes Python texts. A single longer text is a slice of its
    own, so memory follows the longest text. A rest of at most a quarter goes with the last slice.
    """
    values = batch.column(column)
    none = b"" if pa.types.is_binary(values.type) else ""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        if ends[-1] - before <= limit + limit // 4:
            last = len(ends)
        yield first, [none if t is None else t for t in values.slice(first, last - first).to_pylist()]
        first = last


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
