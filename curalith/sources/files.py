"""Content hashes of source files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.functions.digest import chunks, lane_sums, seal

#: Bytes of a file that a task holds at one time.
CHUNK_BYTES = 8 << 20


def _sha256(path: str) -> str:
    """Digest of a file's bytes, read chunk by chunk."""
    if path.startswith("file:"):
        system, place = pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    else:
        system, place = pyarrow.fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with system.open_input_stream(place) as stream:
        while chunk := stream.read(CHUNK_BYTES):
            digest.update(chunk)
    return digest.hexdigest()


def file_hashes(spark: SparkSession, path: str | Sequence[str], *, how: str = "bytes") -> DataFrame:
    """``path, length, content_hash`` of each file.

    ``how="bytes"`` is ``sha256:`` of the bytes, for files of any kind and size: Spark lists
    the files and deals them out, and a task streams each of its files through one digest in
    constant memory. Spark lists no empty files. ``how="lines"`` is ``lines-sha256:``, a fingerprint of the lines of a
    text file, which is read in splits.
    """
    files = spark.read.format("binaryFile").load(path)
    if how == "bytes":

        @F.pandas_udf("string")
        def digest(paths: pd.Series) -> pd.Series:
            return paths.map(lambda p: f"sha256:{_sha256(p)}")

        parts = spark.sparkContext.defaultParallelism
        listed = files.select("path", "length").repartition(parts, "path")
        return listed.select("path", "length", digest("path").alias("content_hash"))
    if how != "lines":
        raise ValueError(f"how must be bytes or lines, not {how!r}")
    lines = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.sha2("value", 256).alias("digest"))
        .withColumns(chunks(F.col("digest")))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("n"), *lane_sums())
    )
    sealed = F.concat(F.lit("lines-"), seal(F.coalesce(F.col("n"), F.lit(0))))
    return files.select("path", "length").join(lines, "path", "left").select("path", "length", sealed.alias("content_hash"))
