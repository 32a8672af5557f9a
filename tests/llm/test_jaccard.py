"""Near-duplicate groups against all pairs, and the search's parts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from curalith.llm import jaccard
from curalith.llm.components import components
from curalith.llm.divide_skip import Lists, Threshold, linked
from tests.llm.fixtures import ODD, none, odd  # noqa: F401


def shingles(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, num, den):
    """(doc_id, set size) -> smallest id reachable, through links and equal ids."""
    sets = [(name, shingles(text, size)) for name, text in rows]
    label = {name: name for name, _ in sets if name is not None}
    again = True
    while again:
        again = False
        for a, x in sets:
            for b, y in sets:
                if None in (a, b) or a == b or not x or not y or den * len(x & y) < num * len(x | y):
                    continue
                low = min(label[a], label[b])
                again |= label[a] != low or label[b] != low
                label[a] = label[b] = low
    return sorted(((name, len(s), label.get(name)) for name, s in sets), key=repr)


def corpus(seed):
    """Families of edited copies, some borderline, and passages that many texts share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(25)]
    rows = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 6)):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.4:
                words += passage
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, size, num", [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, seed, size, num):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)  # several blocks in a cluster
    rows = corpus(seed)
    got = jaccard.grouped(spark.createDataFrame(rows, "doc_id long, text string"), size, num, 100).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, size, num, 100)


def test_odd_rows(odd, none):
    got = jaccard.grouped(odd, 4, 85, 100).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([r[:2] for r in ODD], 4, 85, 100)
    assert jaccard.grouped(none).collect() == []


def test_texts_of_one_id_are_linked_through_it(spark):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "x")]
    got = jaccard.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_first_of_each_group_stays(odd):
    kept = jaccard.one_of_each(odd, 4, 85, 100)
    assert kept.columns == odd.columns
    gone = {2}
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted((tuple(r) for r in odd.collect() if r["doc_id"] not in gone), key=repr)


def test_divide_skip_finds_what_counting_finds():
    r, t = np.random.default_rng(5), Threshold(85, 100)
    base = r.integers(0, 2**63, 60)
    sets = [np.unique(np.concatenate([base[r.random(60) < 0.97], r.integers(0, 2**63, r.integers(0, 6))])).astype(np.int64) for _ in range(80)]
    lists = Lists(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    met = 0
    for k, s in enumerate(sets):
        wanted = np.arange(len(sets)) != k
        want = [j for j, o in enumerate(sets) if j != k and 100 * len(np.intersect1d(s, o)) >= 85 * len(np.union1d(s, o))]
        assert lists.search(s, t, wanted).tolist() == want
        met += len(want)
    assert met


def test_joined_sets_are_not_compared_again():
    tokens = [[1, 2, 3]] * 5
    table = pa.table({"asks": [True] * 5, "label": [0, 0, 2, 3, 4], "tokens": pa.array(tokens, pa.list_(pa.int64()))})
    assert linked(table, Threshold(85, 100)).to_pydict() == {"a": [2, 3, 4], "b": [0, 0, 0]}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100), (103, 100)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_words_of_an_old_collision_stay_apart(spark):
    """Two sequences whose polynomials agree modulo any power of two are other words."""
    bit = [bin(i).count("1") % 2 for i in range(2048)]
    texts = ["".join("ab"[x] for x in bit), "".join("ba"[x] for x in bit)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.grouped(docs, size=4, num=85, den=100).collect()} == {1, 2}


def test_hashes_do_not_depend_on_neighbours():
    """Words of all lengths, alone and beside each other."""
    from curalith.llm.words import split_words

    words = [b"x" * n + b"y" for n in (0, 1, 6, 7, 8, 9, 62, 63, 64, 65, 500, 511, 512, 513, 4095, 4096, 40_000)]
    together = split_words([b" ".join(words)], jaccard.IN_WORD).hashes.tolist()
    assert together == [int(split_words([w], jaccard.IN_WORD).hashes[0]) for w in words] and len(set(together)) == len(words)
