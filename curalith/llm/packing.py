"""Best-fit packing after Martello-Toth dominance reduction.

The number of pieces grows with the corpus, but their lengths are whole numbers up to the
capacity. So only a histogram of lengths reaches the driver (at most ``capacity`` rows);
there it becomes a plan of *runs*: so many sequences of one pattern of lengths. Pieces get
their place from their rank among pieces of equal length, which Spark counts.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curalith.llm.common import batch_of, releasing, stored, text_chunks
from curalith.llm.tokens import SLICE_BYTES, release, tokenizer

#: Words that a worker holds: fewer than it could, as packing ends a pipeline whose stages share the workers.
MOST_WORDS = 250_000
#: Bytes of text that a worker cuts at one time, for the same reason.
CUT_BYTES = SLICE_BYTES // 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Pieces of one length are ranked in so many separate windows.
BUCKETS = 1024


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of every whole text: ids, then ``end_id``, cut only beyond ``capacity``.

    Null text is empty: one piece that holds ``end_id``. Rows with equal or null ``doc_id``
    are documents of their own.
    """

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(tokenizer_path, MOST_WORDS)
        for batch in batches:
            names = batch.column("doc_id")
            for first, texts in text_chunks(batch, limit=CUT_BYTES):
                ids, counts = coder.encode(texts)
                held: tuple[list, ...] = ([], [], [], [], [])
                at = 0
                for name, n in zip(names.slice(first, len(texts)).to_pylist(), counts.tolist()):
                    own = np.append(ids[at : at + n], end_id).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        part = own[start : start + capacity]
                        for column, value in zip(held, (name, k, start, len(part), zlib.crc32(part.tobytes()))):
                            column.append(value)
                yield batch_of(_PIECES, *held)
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, PIECES)


@dataclass(frozen=True)
class Run:
    """``count`` sequences that each hold ``pattern`` (length -> how many); numbered from ``first``."""

    first: int
    count: int
    pattern: tuple[tuple[int, int], ...]


def reduce_dominant(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Small sets that belong to some best packing, and the sizes that are left.

    For the largest size ``w`` its partner is ``p``, the largest other size that fits with
    it. The set {w} dominates when nothing fits. {w, p} dominates when it fills a sequence,
    when no three pieces fit beside ``w`` and no two that do are larger together than
    ``p``: any other set that holds ``w`` can then be changed for {w, p} without needing
    more sequences. Equal sizes are taken in bulk. Sizes for which no rule holds are left
    for the next step.
    """
    left = {w: n for w, n in sizes.items() if n}
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        order = sorted(left)
        for w in reversed(order):
            n = left.get(w, 0)
            if not n:
                continue
            room = capacity - w
            present = [x for x in order if left.get(x, 0) and (x != w or n > 1)]
            k = bisect.bisect_right(present, room)
            if k == 0:
                fixed.append(((w,), n))
                left[w], again = 0, True
                continue
            p = present[k - 1]
            if p != room and not _pairs_below(present[:k], left, w, room, p):
                continue
            if w == p:
                times = n // 2
            else:
                times = min(n, left[p])
            if times:
                fixed.append(((w, p), times))
                left[w] -= times
                left[p] -= times
                again = True
    return fixed, {w: n for w, n in left.items() if n}


def _pairs_below(fitting: list[int], left: dict[int, int], w: int, room: int, p: int) -> bool:
    """Whether no three pieces fit into ``room`` and no two fit there with more than ``p`` together."""
    least = [x for x in fitting[:3] for _ in range(min(3, left[x] - (x == w)))][:3]
    if len(least) < 2 or least[0] + least[1] > room:
        return True
    if len(least) == 3 and sum(least) <= room:
        return False
    sizes = np.array(fitting)
    other = np.searchsorted(sizes, room - sizes, side="right") - 1
    sums = np.where(other >= 0, sizes + sizes[other], 0)
    return int(sums.max()) <= p


def best_fit(sizes: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram; equal pieces and equal sequences move in bulk."""
    groups: dict[int, list[list]] = {}  # room left -> [[pattern, count], ...]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if count:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append([pattern, count])

    for w in sorted(sizes, reverse=True):
        n = sizes[w]
        while n:
            k = bisect.bisect_left(rooms, w)
            if k == len(rooms):
                each = capacity // w
                put(capacity - each * w, (w,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * w, (w,) * (n % each), 1)
                break
            room = rooms[k]
            pattern, count = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[k]
            each = room // w
            full = min(count, n // each)
            put(room - each * w, pattern + (w,) * each, full)
            n -= full * each
            rest = count - full
            if rest and n and n < each:
                put(room - n * w, pattern + (w,) * n, 1)
                n, rest = 0, rest - 1
            put(room, pattern, rest)
    return [(pattern, count) for room in rooms for pattern, count in groups[room]]


def plan(sizes: dict[int, int], capacity: int) -> list[Run]:
    """Runs that hold every piece of the histogram once."""
    if any(not 0 < w <= capacity for w in sizes):
        raise ValueError("every length must be between 1 and the capacity")
    fixed, left = reduce_dominant(sizes, capacity)
    runs, first = [], 0
    for pattern, count in fixed + best_fit(left, capacity):
        runs.append(Run(first, count, tuple(sorted(Counter(pattern).items(), reverse=True))))
        first += count
    return runs


def _places(runs: list[Run]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, pieces in a sequence and offset of its runs."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    for run in runs:
        offset = 0
        for w, each in run.pattern:
            rows.setdefault(w, []).append((seen[w], run.first, each, offset))
            seen[w] += each * run.count
            offset += each * w
    return {w: tuple(np.array(c, np.int64) for c in zip(*r)) for w, r in rows.items()}


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (columns of :data:`PIECES`).

    Sequences overlap nowhere and are filled from 0 without gaps. An empty table gives no
    row. Pieces of one length are ranked by document and piece; fully equal rows (of a
    repeated document) may change places, which changes no row of the result. ``cut`` is
    read three times, so it should be a stored table.
    """
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = cut.sparkSession.sparkContext.broadcast(_places(plan(sizes, capacity)))
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])
    columns = cut.columns
    ranked = ranked.select(*columns, (F.col("rank") + F.col("base")).alias("_rank"))
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for w in np.unique(lengths):
                own = lengths == w
                firsts, bins, each, starts = table[int(w)]
                run = np.searchsorted(firsts, ranks[own], side="right") - 1
                inside = ranks[own] - firsts[run]
                sequence[own] = bins[run] + inside // each[run]
                offset[own] = starts[run] + inside % each[run] * w
            arrays = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(work, schema)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cuts and packs whole documents; see :func:`pieces` and :func:`pack`."""
    return pack(stored(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
