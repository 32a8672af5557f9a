"""What a Python worker holds while it works and afterwards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from curalith.llm.common import releasing, text_chunks


def test_a_worker_gives_arrays_back_while_it_works(spark):
    def held_kb():
        with open("/proc/self/smaps_rollup") as found:
            return next(int(line.split()[1]) for line in found if line.startswith("Anonymous:"))

    @releasing
    def work(batches):
        for batch in batches:
            for size in (16 << 20, 8 << 20):  # glibc keeps what is smaller than an earlier array, unless told not to
                own, buffer = np.ones(size, np.uint8), pa.allocate_buffer(size, resizable=True)
                np.frombuffer(buffer, np.uint8)[:] = 1
                full = held_kb()
                del own, buffer
                left = held_kb()
            yield pa.RecordBatch.from_arrays([pa.array([full]), pa.array([left])], names=["full", "left"])

    rows = spark.range(1, numPartitions=1).mapInArrow(work, "full long, left long").collect()
    assert [r["full"] - r["left"] > 15 << 10 for r in rows] == [True]


def test_slices_hold_all_texts_once_and_a_small_rest_goes_with_the_last():
    texts = ["x" * 40, None, "y" * 30, "z" * 30, "", "w" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for limit in (1, 30, 50, 99, 1000):
        got = list(text_chunks(batch, limit=limit))
        assert [t for _, own in got for t in own] == [t or "" for t in texts]
        assert [first for first, _ in got] == np.cumsum([0, *(len(own) for _, own in got)])[:-1].tolist()
    assert [len("".join(own)) for _, own in text_chunks(batch, limit=100)] == [120]
    assert [len("".join(own)) for _, own in text_chunks(batch, limit=70)] == [70, 50]
