"""Tokens, their files and packing, against the tokenizers library, round trips and brute force."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curalith.llm import idcodec, packing, token_files
from curalith.llm.tokens import WordTokenizer
from tests.llm.fixtures import ODD, none, odd, tokenizer_path  # noqa: F401


@pytest.fixture(scope="module")
def coder(tokenizer_path):
    return WordTokenizer(tokenizer_path)


def library_ids(coder, text):
    return coder.library.encode(text, add_special_tokens=False).ids


PIECES = st.lists(st.sampled_from(["word,", "Word.", "it's", "x", "É", "é", "́", " ", "\n", "\t", "\r\n", "..", "!,", "12,", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "😀", "　", ",", ".", "ß."]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(PIECES, st.text(max_size=20)), max_size=4))
def test_ids_are_the_librarys(coder, texts):
    ids, counts = coder.encode(texts)
    assert counts.tolist() == [len(library_ids(coder, t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in library_ids(coder, t)]


def test_a_worker_forgets_words_but_not_results(coder, monkeypatch):
    monkeypatch.setattr("curalith.llm.tokens.CACHED_WORDS", 3)
    for text in ("a b c, d", "d. e f", "a b"):
        assert coder.encode([text])[0].tolist() == library_ids(coder, text)


def test_signs_beside_a_word_make_no_new_pieces(tokenizer_path):
    coder = WordTokenizer(tokenizer_path)
    words = [f"{'straße' if k % 2 else 'word'}{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(100)]
    signs = [a + b for a in "!#$%&()*+,-./:;" for b in "?@[]^_`{}~"]
    texts = [" ".join(f"{b}{w}{a}{w}7" for w in words) for a, b in zip(signs, reversed(signs))]
    ids, counts = coder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library_ids(coder, t)]
    assert len(coder.numbers) == len(words) + len(signs) + 1


def test_each_character_beside_letters_digits_and_signs(coder):
    odd = [chr(k) for k in (*range(0x250), 0x300, 0x301, 0x2028, 0x3000, 0xFB01, 0x1F600)]
    texts = [t for c in odd for t in (f"ab{c}cd", f"1{c}2", f".{c},", f"é{c}", f"{c}it's{c}", f"<|endoftext|>{c}A")]
    assert coder.encode(texts)[0].tolist() == [i for t in texts for i in library_ids(coder, t)]
    for text in texts:
        assert coder.encode([text])[0].tolist() == library_ids(coder, text)


@settings(deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
def test_codec_round_trip(ranks):
    control, data = idcodec.encode(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert idcodec.decode(control, data, len(ranks)).tolist() == ranks


def test_codec_notices_damage():
    control, data = idcodec.encode(np.arange(10, dtype=np.uint32))
    with pytest.raises(ValueError):
        idcodec.decode(control, data[:-1], 10)


def test_token_files_of_odd_rows(spark, odd, none, coder, tokenizer_path, tmp_path):
    files = token_files.write_token_files(odd, tokenizer_path, str(tmp_path / "files"), end_id=1, parts=3)
    got = sorted(token_files.read_token_files(spark, files, with_ids=True).collect(), key=lambda r: r["start"])
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, len(library_ids(coder, r[1] or ""))))
    start = 0
    for row, (name, text, *_) in zip(got, order, strict=True):
        ids = [*library_ids(coder, text or ""), 1]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (name, start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.token_table(none, tokenizer_path).collect() == []


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_rows(odd, none, coder, tokenizer_path):
    rows = packing.packed(odd, tokenizer_path, capacity=64, end_id=0).collect()
    check_packing(rows, 64)
    want = Counter()
    for name, text, *_ in ODD:
        ids = [*library_ids(coder, text or ""), 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want[name, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.packed(none, tokenizer_path).collect() == []


def fewest(sizes, capacity):
    """Number of bins of a best packing, by search."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def used(runs):
    total = Counter()
    for run in runs:
        for w, n in run.pattern:
            total[w] += n * run.count
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_an_optimum(sizes):
    fixed, left = packing.reduce_dominant(dict(Counter(sizes)), 20)
    rest = sorted((w for w, n in left.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sorted(sizes, reverse=True), 20)
    assert all(sum(p) <= 20 for p, _ in fixed)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), min_size=1, max_size=30))
def test_a_plan_holds_each_piece_once(sizes):
    runs = packing.plan(sizes, 100)
    assert used(runs) == Counter(sizes)
    assert all(sum(w * n for w, n in r.pattern) <= 100 for r in runs)
    numbers = list(itertools.chain.from_iterable(range(r.first, r.first + r.count) for r in runs))
    assert sorted(numbers) == list(range(len(numbers)))
    assert len(numbers) <= 2 * -(-sum(w * n for w, n in sizes.items()) // 100)
