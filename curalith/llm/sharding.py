"""Shards along a Hilbert curve over metadata, so that files are pruned by any of its dimensions.

Each dimension is cut at its own quantiles into ``2 ** BITS`` cells. Documents are sorted by
the curve's index of their cell; runs of the order are the shards. The law is ``rows``:
counts of shards are at most one apart.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalith.llm.common import partitions_for, releasing, stored
from curalith.operators.prefix import prefix_scan

BITS = 5
SHARDS = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the curve of each row of ``cells`` (points x dimensions, below ``2 ** bits``).

    Works from the highest bit down: a bit that is set reflects the lower bits of the first
    axis, one that is not exchanges them with the axis' own; then the Gray code is undone.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit = 1 << level
        low = bit - 1
        for d in range(dims):
            flip = (x[:, d] & bit) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    carry = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[:, dims - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= carry[:, None]
    out = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[:, d] >> level) & 1)
    return out


def as_dimension(df: DataFrame, name: str) -> Column:
    """What a column's values are ordered by: whole numbers, seconds and doubles as such, anything else as text."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name).cast("long")
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.col(name).cast("double")
    if kind in ("date", "timestamp"):
        return F.unix_timestamp(F.col(name).cast("timestamp"))
    return F.col(name).cast("string")


def cuts(df: DataFrame, dims: list[str], bits: int) -> list[list]:
    """Per dimension, the values at which a new cell begins, so that cells hold even shares of all rows.

    Numbers are cut at their quantiles by one aggregate. Whole texts are counted by value, and
    their counts added up in order; the first value of each share is a cut. The driver gets
    at most ``2 ** bits`` values of a dimension.
    """
    n = 1 << bits
    kinds = dict(df.dtypes)
    numbers = [d for d in dims if kinds[d] != "string"]
    shares = [k / n for k in range(1, n)]
    row = df.agg(*(F.percentile_approx(d, shares, 10_000).alias(d) for d in numbers)).first() if numbers else {}
    out = {d: sorted(set(row[d] or [])) for d in numbers}
    for d in dims:
        if d not in out:
            counts = df.where(F.col(d).isNotNull()).groupBy(d).agg(F.count("*").alias("rows"))
            below = prefix_scan(counts, "below", F.col("rows"), "sum", order_by=[d], inclusive=False)
            total = df.where(F.col(d).isNotNull()).count()
            first = below.groupBy(F.expr(f"coalesce(below, 0L) * {n} div {max(total, 1)}").alias("cell")).agg(F.min(d).alias("first"))
            out[d] = sorted((r["first"] for r in first.where("cell > 0").collect()), key=str.encode)
    return [out[d] for d in dims]


def curve(df: DataFrame, dims: list[str], bits: int = BITS) -> Column:
    """Index of each row along the curve. Null lies in the first cell; a value that many rows share fills one cell."""
    texts = {k for k, d in enumerate(dims) if dict(df.dtypes)[d] == "string"}
    points = cuts(df, dims, bits)

    @F.pandas_udf("long")
    def index(*values: pd.Series) -> pd.Series:
        cells = np.zeros((len(values[0]), len(points)), np.int64)
        for k, v in enumerate(values):
            known = v.notna().to_numpy()
            if k in texts:  # as Spark orders texts: by their bytes
                own = [p.encode() for p in points[k]]
                cells[known, k] = [bisect.bisect_right(own, t.encode()) for t in v[known]]
            else:
                cells[known, k] = np.searchsorted(np.array(points[k], np.float64 if v.dtype.kind == "f" else np.int64), v[known].to_numpy(), side="right")
        return pd.Series(hilbert_index(cells, bits))

    return index(*dims)


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``rank`` from 0 in the given order, and the number of rows.

    Rows are dealt by ranges and numbered within each; only a count per range reaches the
    driver. The numbered rows are written, so ranks stay as they are if a task is run again.
    """
    spark = df.sparkSession
    fields = df.schema

    @releasing
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            arrays = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_part", "_place"])
            seen += n

    dealt = df.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order)
    held = stored(dealt.mapInArrow(number, fields.add("_part", "integer").add("_place", "long")), "ranked")
    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect())
    bases, total = [], 0
    for part, n in counts:
        bases.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(bases, "_part int, _base long"))
    out = held.join(base, "_part")
    return out.withColumn("rank", F.col("_base") + F.col("_place")).drop("_part", "_place", "_base"), total


def shards(docs: DataFrame, dims: list[str], n: int = 16) -> DataFrame:
    """One row per document; see :data:`SHARDS`. ``slot`` counts a shard's rows from 0.

    ``size`` is the text's UTF-8 bytes plus 1; null text has none, and the checksum of
    empty text. Dimensions may be null. Repeated rows each get a place. Fewer documents
    than shards leave shards empty; an empty table gives an empty table. The text is read
    once, for its size and checksum, and never shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    chosen = [as_dimension(docs, d).alias(f"dim{k}") if d != "size" else F.octet_length(text).cast("long").alias(f"dim{k}") for k, d in enumerate(dims)]
    narrow = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *chosen), "metadata")
    names = [f"dim{k}" for k in range(len(dims))]
    placed = stored(narrow.withColumn("curve", curve(narrow, names)).drop(*names), "curve")
    out, total = ranked(placed, ["curve", "doc_id", "text_crc32", "size"])
    shard = F.expr(f"rank * {n} div {max(total, 1)}")
    out = out.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(cast(shard as long) * {total} + {n - 1}) div {n}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes whole documents as Parquet under ``path``, a folder per shard, in slot order.

    Copies of a row are numbered on both sides, so each takes one place.
    """
    keys = ["doc_id", "size", "text_crc32"]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    copy = Window.partitionBy(*(f"_{k}" for k in keys)).orderBy(F.lit(1))
    own = docs.withColumns({"_doc_id": F.col("doc_id").cast("long"), "_size": (F.octet_length(text) + 1).cast("long"), "_text_crc32": F.crc32(text)})
    own = own.withColumn("_copy", F.row_number().over(copy))
    places = placed.select(*(F.col(k).alias(f"p_{k}") for k in keys), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    places = places.withColumn("p_copy", F.row_number().over(Window.partitionBy(*(f"p_{k}" for k in keys)).orderBy("_shard", "_slot")))
    same = [F.col(f"_{k}").eqNullSafe(F.col(f"p_{k}")) for k in keys] + [F.col("_copy") == F.col("p_copy")]
    rows = own.join(places, same).select(*docs.columns, "_shard", "_slot")
    rows.repartition("_shard").sortWithinPartitions("_shard", "_slot").withColumnRenamed("_shard", "shard_no").drop("_slot").write.partitionBy("shard_no").parquet(path)
