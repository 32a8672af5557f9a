"""Ranked search against a plain score of every item and document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from curalith.llm import search
from tests.llm.fixtures import ODD, none, odd  # noqa: F401

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub(rb"[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall((text or "").encode())]


def brute(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for name, text in dict.fromkeys(items):
        scores = []
        for i, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(name, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "The CAT sat on a mat, the cat"), (2, "w5x5 w6x6 w7x7 nothing"), (3, None), (4, " ... "), (5, "été ISTANBUL Σίσυφος σίσυφος"), (None, "12 one"), (1, "one"), (1, "The CAT sat on a mat, the cat"), (6, "unheard")]


@pytest.mark.parametrize("block_bytes", [16_000_000, 40])
def test_odd_rows(spark, odd, none, block_bytes):
    items = spark.createDataFrame([(*r, "kept") for r in ITEMS], "item_id int, text string, score string")
    got = search.ranked(odd, items, 3, block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in ODD], ITEMS, 3)
    assert search.ranked(none, items).collect() == []
    assert search.ranked(odd, items.limit(0)).collect() == []


def test_ties_over_many_tasks(spark):
    """Few words make many equal scores; small slices and many tasks make many heaps."""
    r = random.Random(7)
    docs = [(i, " ".join(r.choice("abcdefg") for _ in range(r.randint(0, 9)))) for i in range(900)]
    r.shuffle(docs)
    items = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 6)))) for i in range(40)]
    got = search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(70), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_heaps_stay_bounded():
    import numpy as np

    heaps = search.Heaps(3, 2)
    for low in range(0, 40, 4):
        names = np.arange(low, low + 4)
        heaps.add(np.stack([names % 5, 40 - names, np.zeros(4, np.int64)], axis=1), names, np.zeros(4, bool))
        assert len(heaps.item) <= 6
    assert list(zip(heaps.item.tolist(), heaps.score.tolist(), heaps.name.tolist())) == [(0, 4, 4), (0, 4, 9), (1, 40, 0), (1, 39, 1)]
