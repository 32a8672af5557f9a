"""Ranked lexical search turned round: documents stream through an inverted index of the items.

The index over the items' terms is broadcast. A first pass over the texts finds the index's
terms in each document, exactly, and stores their counts beside the document's number of
terms; what the weights need (documents, terms, documents by term) is added up on the way. A
second pass streams the stored counts through the postings: scores of a slice of documents
are added up per item, and those that beat an item's worst held score enter its bounded heap.
The tasks' heaps are merged in two steps, so no item's rows all go to one task at once.

Items are held in blocks of bounded bytes, each with its own two passes, so there is no limit
on their number. Texts are neither shuffled nor exploded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from curalith.llm.common import batch_of, releasing, stored, text_chunks
from curalith.llm.words import byte_class, split_words, word_bytes

#: Terms are runs of ASCII letters and digits and all bytes of non-ASCII characters, A-Z folded.
IN_TERM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Bytes of item text whose index is broadcast at one time.
BLOCK_BYTES = 16_000_000
#: Scores (documents times items) that a task adds up at one time.
CELLS = 2_000_000
#: Groups of tasks whose heaps are merged before those of all tasks.
MERGE_GROUPS = 64
#: Fixed values of the score: a thousandth's scale, and the share of a document's length in it.
SCALE, LENGTH_SHARE = 1000, 75

_COUNTS = "doc_id long, n long, terms array<int>, counts array<long>, is_total boolean"
_COUNTS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("is_total", pa.bool_())])
_HEAPS = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("task", pa.int32())])


class Index:
    """Postings of some items: per term, the items that hold it and how often each does."""

    def __init__(self, texts: list[bytes | None]):
        words = split_words(texts, IN_TERM)
        held = [Counter(words.text_of(w) for w in range(a, b)) for a, b in zip(words.first, words.first[1:])]
        self.n_items = len(texts)
        self.terms = sorted(set().union(*held)) if held else []
        number = {t: k for k, t in enumerate(self.terms)}
        rows = sorted((number[t], k, n) for k, own in enumerate(held) for t, n in own.items())
        term, item, times = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((), (), ())))
        self.item, self.times = item, times
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def term_set(self) -> pa.Array:
        return pa.array(self.terms, pa.large_binary())


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def term_counts(docs: DataFrame, index: Index) -> DataFrame:
    """Per document ``n`` (its terms, with repeats) and the counts of the index's terms.

    The last row of each task, ``is_total``, has the number of its documents with a term as
    ``doc_id``, all their terms as ``n``, and per term the number of documents that hold it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index.term_set())

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        held, documents, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for first, texts in text_chunks(batch):
                words = split_words(texts, IN_TERM)
                found = pc.index_in(word_bytes(words, IN_TERM), value_set=terms)
                ours = found.is_valid().to_numpy(zero_copy_only=False)
                key = words.owner()[ours] * len(terms) + found.drop_null().to_numpy().astype(np.int64)
                key, counts = np.unique(key, return_counts=True)
                owner, term = (key // len(terms), key % len(terms)) if len(terms) else (key, key)
                n = np.diff(words.first)
                held += np.bincount(term, minlength=len(terms))
                documents, total = documents + int(np.count_nonzero(n)), total + int(n.sum())
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                names = batch.column("doc_id").slice(first, len(texts))
                columns = [names, pa.array(n, pa.int64()), _lists(term, bounds, pa.int32()), _lists(counts, bounds, pa.int64()), pa.array(np.zeros(len(texts), bool))]
                yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS_SCHEMA)
        met = np.flatnonzero(held)
        yield batch_of(_COUNTS_SCHEMA, [documents], [total], [met], [held[met]], [True])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(work, _COUNTS)


def weights(counts: DataFrame, index: Index) -> tuple[np.ndarray, int, int]:
    """Weight of each term, and over all documents how many have a term and how many terms they have."""
    totals = counts.where("is_total")
    sums = totals.agg(F.sum("doc_id").alias("documents"), F.sum("n").alias("terms")).first()
    documents = sums["documents"] or 0
    pairs = totals.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("df")).collect()
    weight = np.zeros(len(index.terms), np.int64)
    for r in pairs:
        weight[r["terms"]] = math.floor(SCALE * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    return weight, documents, sums["terms"] or 0


class Heaps:
    """The ``k`` best (score, document) of each item, better first; equal scores by rising id, null last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.floor = np.ones(n_items, np.int64)  # the least score that may still enter
        self.item, self.score, self.name = (np.empty(0, np.int64) for _ in range(3))
        self.null = np.empty(0, bool)

    def add(self, scores: np.ndarray, names: np.ndarray, null: np.ndarray) -> None:
        """``scores`` is documents x items."""
        row, item = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        columns = [self.item, self.score, self.name, self.null], [item, scores[row, item], names[row], null[row]]
        item, score, name, null = (np.concatenate(c) for c in zip(*columns))
        order = np.lexsort((name, null, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[place < self.k]
        self.item, self.score, self.name, self.null = item[order], score[order], name[order], null[order]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.floor[self.item[full]] = self.score[full]


def scored(counts: DataFrame, index: Index, k: int) -> DataFrame:
    """``item, doc_id, score, task``: the heaps of every task over the stored counts."""
    weight, documents, terms = weights(counts, index)
    shared = counts.sparkSession.sparkContext.broadcast((weight, index.first, index.item, index.times))
    n_items = index.n_items

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, first, item, times = shared.value
        heaps = Heaps(n_items, k)
        rows_at_once = max(1, CELLS // max(n_items, 1))
        for whole in batches:
            for low in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(low, rows_at_once)
                names = batch.column("doc_id")
                n = batch.column("n").to_numpy()
                size = np.diff(batch.column("terms").offsets.to_numpy())
                term, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
                owner = np.repeat(np.arange(batch.num_rows), size)
                m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(terms, 1)
                part = weight[term] * ((1_000_000_000 * tf) // (SCALE * tf + 8 * m[owner]))
                scores = np.zeros(batch.num_rows * n_items, np.int64)
                # Postings by slices, so that a batch of common terms does not swell.
                reach = np.cumsum(first[term + 1] - first[term])
                cut = 0
                while cut < len(term):
                    end = max(cut + 1, int(np.searchsorted(reach, (reach[cut - 1] if cut else 0) + CELLS)))
                    own = slice(cut, end)
                    many = first[term[own] + 1] - first[term[own]]
                    at = np.repeat(first[term[own]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                    np.add.at(scores, np.repeat(owner[own] * n_items, many) + item[at], np.repeat(part[own], many) * times[at])
                    cut = end
                heaps.add(scores.reshape(-1, n_items), names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False))
        name = pa.array(heaps.name, pa.int64(), mask=heaps.null)
        task = np.full(len(heaps.item), TaskContext.get().partitionId() % MERGE_GROUPS)
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item, pa.int32()), name, pa.array(heaps.score), pa.array(task, pa.int32())], schema=_HEAPS)

    return counts.where("not is_total and n > 0").select("doc_id", "n", "terms", "counts").mapInArrow(work, "item int, doc_id long, score long, task int")


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """Different rows of ``item_id, text`` in blocks of about ``block_bytes``, each read by itself."""
    own = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).where("text is not null").distinct()
    total = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-total // block_bytes)
    for k in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        if rows:
            yield rows


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents, of those that score above 0.

    Equal scores rank by rising ``doc_id``, null last. Null and empty texts have no terms: as
    documents they count nowhere, as items they have no rows. Rows of items that are equal
    are one item; rows of one id with other texts are ranked each by itself. Repeated rows of
    documents are documents of their own. A term that occurs in no document adds nothing.
    Empty tables give an empty table, and further columns are ignored.
    """
    spark, found = docs.sparkSession, []
    field = StructField("item_id", items.schema["item_id"].dataType)
    for rows in _blocks(items, block_bytes):
        index = Index([bytes(r["text"]) for r in rows])
        heaps = scored(stored(term_counts(docs, index), "term-counts"), index, k)
        best = _best(_best(heaps, ["item", "task"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], StructType([StructField("item", IntegerType()), field]))
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], StructType([field])).selectExpr("item_id", "0 rank", "0L doc_id", "0L score")
    return reduce(DataFrame.union, found)
