"""Tokenized corpora as binary files in ascending document order, and their readers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm import idcodec
from curalith.llm.common import batch_of, partitions_for, range_of, releasing, scratch_dir, split_points, stored, text_chunks
from curalith.llm.tokens import SLICE_BYTES, release, tokenizer, vocabulary_size

#: Ids in a block; a document with more is a block of its own.
BLOCK_IDS = 500_000


@dataclass(frozen=True)
class TokenFiles:
    """A written corpus: ``part=N`` folders in document order, and the ranks' dictionary beside them."""

    path: str

    @property
    def data(self) -> str:
        return f"{self.path}/ids"

    @property
    def dictionary(self) -> str:
        return f"{self.path}/dictionary"


def coded(docs: DataFrame, tokenizer_path: str, points: np.ndarray, end_id: int) -> DataFrame:
    """Tokenizes each text once: ``part, doc_id, n, ids`` (two or four bytes each), and a task's counts.

    The last row of a task has only ``counts``: how often it met each id.
    """
    wide = vocabulary_size(tokenizer_path) > 1 << 16
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])))])
    kind = "<u4" if wide else "<u2"

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = tokenizer(tokenizer_path), np.zeros(1 << 16, np.int64)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, texts in text_chunks(batch, limit=SLICE_BYTES):
                found, lengths = coder.encode(texts)
                seen = np.bincount(found)
                if len(seen) > len(total):
                    total = np.append(total, np.zeros(len(seen) - len(total), np.int64))
                total[: len(seen)] += seen
                total[end_id] += len(texts)
                own = names[first : first + len(texts)]
                ends = np.cumsum(lengths + 1)
                raw = np.empty(int(ends[-1]), kind)
                raw[ends - 1] = end_id
                is_own = np.ones(len(raw), bool)
                is_own[ends - 1] = False
                raw[is_own] = found
                offsets = np.concatenate([[0], ends * raw.itemsize]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                parts = [0 if x is None else int(np.searchsorted(points, x, side="right")) for x in own]
                arrays = [pa.array(c, t.type) for c, t in zip((parts, own, lengths + 1), schema)]
                yield pa.RecordBatch.from_arrays([*arrays, ids, pa.nulls(len(own), schema.field("counts").type)], schema=schema)
        release()
        met = np.flatnonzero(total)
        yield batch_of(schema, [None], [None], [0], [None], [[{"id": i, "n": n} for i, n in zip(met.tolist(), total[met].tolist())]])

    return docs.mapInArrow(work, "part int, doc_id long, n long, ids binary, counts array<struct<id:long,n:long>>")


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, parts: int | None = None) -> TokenFiles:
    """Tokenizes whole texts and writes their ids, then ``end_id``, as files under ``path``.

    Null text is empty (only ``end_id``). Documents lie in ascending ``doc_id``, null
    first; documents of equal id by their ids' number and bytes. The ranks come from counts over all documents; the
    driver gets one row per id of the vocabulary, never a row per document. Texts are
    tokenized once, where they are read; only ids are written and shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    points = split_points(docs, "doc_id", parts or partitions_for(spark))
    held = stored(coded(docs, tokenizer_path, points, end_id), "ids")
    each = held.where("counts is not null").select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    counts = {end_id: 0} | {r["id"]: r["n"] for r in each.collect()}
    ids = np.array(sorted(counts, key=lambda i: (-counts[i], i)), np.uint32)
    ranks = np.zeros(int(ids.max()) + 1, np.uint32)
    ranks[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(ranks)

    @releasing
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("block", pa.binary())])
        rank_of, part, names, lengths, raw, size = shared.value, None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            joined = b"".join(raw)
            found = np.frombuffer(joined, "<u2" if len(joined) == 2 * size else "<u4")
            out = batch_of(schema, [part], [idcodec.write_block(names, np.array(lengths), rank_of[found])])
            names.clear(), lengths.clear(), raw.clear()
            return out

        for batch in batches:
            for number, name, n, own in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids"))):
                if names and (number != part or size + n > BLOCK_IDS):
                    yield flush()
                    size = 0
                part = number
                names.append(name)
                lengths.append(n)
                raw.append(own)
                size += n
        if names:
            yield flush()

    ordered = held.where("part is not null").select("part", "doc_id", "n", "ids").repartition(len(points) + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n", "ids")
    files = TokenFiles(path)
    # The text writer puts a value's bytes into the file as they are, and a line feed after them.
    written = ordered.mapInArrow(block, "part int, block binary").select("part", F.col("block").cast("string"))
    written.write.partitionBy("part").text(files.data)
    spark.createDataFrame([(bytearray(ids.astype("<u4").tobytes()),)], "ids binary").coalesce(1).select(F.col("ids").cast("string")).write.text(files.dictionary)
    return files


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """A row per document from the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    ``start`` is the number of ids of all documents before it. Block heads are read first,
    for the number of ids in each file (a row per file reaches the driver).
    """
    table = spark.read.format("binaryFile").load(files.dictionary).where("length > 1").select("content").first()
    ids_of = np.frombuffer(bytes(table["content"])[:-1], "<u4")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(files.data)
    part = F.regexp_extract(F.col("path"), r"part=(\d+)/", 1).cast("int").alias("part")
    sizes_schema = pa.schema([("part", pa.int32()), ("n", pa.int64())])

    @releasing
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("part").to_pylist(), batch.column("content")):
                total = sum(int(counts.sum()) for _, counts, _ in idcodec.read_blocks(data.as_py(), ranks=False))
                yield batch_of(sizes_schema, [number], [total])

    totals = dict(sorted((r["part"], r["n"]) for r in content.select(part, "content").mapInArrow(sizes, "part int, n long").collect()))
    bases = dict(zip(totals, np.cumsum([0, *totals.values()]).tolist()))
    shared = spark.sparkContext.broadcast((ids_of, bases))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    @releasing
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_table, first = shared.value
        for batch in batches:
            for number, data in zip(batch.column("part").to_pylist(), batch.column("content")):
                start = first[number]
                for names, counts, ranks in idcodec.read_blocks(data.as_py()):
                    ends = np.cumsum(counts)
                    found = ids_table[ranks].astype("<u4", copy=False)
                    each = [found[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
                    columns = [names, start + ends - counts, counts, [zlib.crc32(x) for x in each]]
                    yield batch_of(schema, *columns, *([each] if with_ids else []))
                    start += int(counts.sum())

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return content.select(part, "content").mapInArrow(documents, out)


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, tokenizer_path, scratch_dir(spark, "token-files"), end_id))
