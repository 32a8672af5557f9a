"""A Bloom filter of a column of longs, built by Spark and broadcast at a bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm.common import releasing
from curalith.llm.words import mix

#: Bits for a value, probes, and the bound of the filter (2 ** 28 bits are 32 MB).
BITS_PER_VALUE, PROBES, MOST_BITS = 16, 4, 28


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    h = mix(values.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Bloom:
    """Beyond its bound the filter lets more values through, and still loses none."""

    bits: int
    cells: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bloom:
        n = df.count()
        bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(max(1, n) * BITS_PER_VALUE)))))
        schema = pa.schema([("word", pa.int64()), ("mask", pa.int64())])

        @releasing
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(1 << bits, bool)
            for batch in batches:
                held[_places(batch.column(0).to_numpy(), bits).reshape(-1)] = True
            words = np.packbits(held, bitorder="little").view("<i8")
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], schema=schema)

        found = df.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(work, "word long, mask long")
        table = found.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(1 << (bits - 6), "<i8")
        words[table.column(0).to_numpy()] = table.column(1).to_numpy()
        return cls(bits, words.view(np.uint8))

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        at = _places(values, self.bits)
        return ((self.cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
