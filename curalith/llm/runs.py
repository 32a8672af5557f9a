"""Periodic runs of words: suffix automaton whose link tree is coloured by link-cut access.

Words are appended to a suffix automaton one by one. A state's strings share their places;
its colour is where they ended last. The prefix that the new word completes is accessed in a
link-cut tree over the suffix links: the path from its state to the root falls into segments
of one colour, and all of it takes the new colour. A segment of colour ``j`` holds suffixes of
lengths ``low < n <= high`` that ended last at ``j``; so if the distance ``d`` from ``j`` to
the new end lies within these lengths, the last ``2 d`` words are the square of a word that is
itself no power. Squares of one period that end at neighbouring words are one run.

Before that, a sieve leaves out what no run can hold. A run is at least six words and four
periods long, so each of its shingles of five words occurs again in the same run, at most a
period away. Only stretches whose shingles all recur within a quarter of the stretch's length
are appended; this is exact, and prose has few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm.common import releasing, set_aside, text_chunks
from curalith.llm.words import Words, byte_class, split_words

#: Words are runs of bytes other than the blank and 09-0D; nothing is folded.
IN_WORD = byte_class((0x20, 0x20), (0x09, 0x0D))
#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the sieve's shingles; longer ones would miss a run of six equal words.
SIEVE_WORDS = 5
ADDED = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """``(end, period)`` of the squares of non-powers in a sequence, by rising end.

    State 1 is the root, 0 is none. ``size`` and ``link`` are the automaton's; ``left``,
    ``right`` and ``up`` make splay trees of preferred paths, ordered by size, whose roots
    point up to the state above the path. ``ended`` is the colour of a path, kept at its
    splay tree's root. A state has mostly one transition (``word``, ``to``), others are in ``more``.
    """
    size, link, word, to = [0, 0], [0, 0], [-1, -1], [0, 0]
    left, right, up, ended = [0, 0], [0, 0], [0, 0], [0, -(1 << 62)]
    more: dict[int, dict[int, int]] = {}
    columns = ((size, 0), (link, 0), (word, -1), (to, 0), (left, 0), (right, 0), (up, 0), (ended, 0))

    def new_state() -> int:
        for column, value in columns:
            column.append(value)
        return len(size) - 1

    def follow(state: int, w: int) -> int:
        if word[state] == w:
            return to[state]
        return more[state].get(w, 0) if state in more else 0

    def lead(state: int, w: int, target: int) -> None:
        if word[state] == -1 or word[state] == w:
            word[state], to[state] = w, target
        else:
            more.setdefault(state, {})[w] = target

    def turn(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:
            ended[x] = ended[p]
        up[x], up[p] = g, x
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p

    def splay(x: int) -> None:
        while True:
            p = up[x]
            on_left = left[p] == x
            if not on_left and right[p] != x:
                return
            g = up[p]
            if left[g] == p:
                turn(p if on_left else x)
            elif right[g] == p:
                turn(x if on_left else p)
            turn(x)

    def divide(state: int, w: int, q: int, n: int) -> int:
        """The state of ``q``'s strings up to length ``n``, put above it in both trees."""
        own = new_state()
        size[own], link[own], word[own], to[own] = n, link[q], word[q], to[q]
        if q in more:
            more[own] = dict(more[q])
        link[q] = own
        # These strings ended where q's did, so they belong to the same path.
        splay(q)
        above = left[q]
        left[own], left[q], up[own] = above, own, q
        if above:
            up[above] = own
        while state and follow(state, w) == q:
            lead(state, w, own)
            state = link[state]
        return own

    last = 1
    for i, w in enumerate(words):
        own = new_state()
        size[own] = i + 1
        p = last
        while p and not follow(p, w):
            lead(p, w, own)
            p = link[p]
        if not p:
            link[own] = 1
        else:
            q = follow(p, w)
            link[own] = q if size[q] == size[p] + 1 else divide(p, w, q, size[p] + 1)
        last = own
        # Access: the path from the new state to the root becomes one, segment by segment.
        below, x = own, link[own]
        up[own] = x
        while x:
            splay(x)
            top, j = up[x], ended[x]
            if size[top] < i - j <= size[x]:
                yield i, i - j
            deeper = right[x]
            if deeper:
                ended[deeper] = j
            right[x] = below
            below, x = x, top
        ended[below] = i


def runs_of(words: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all maximal runs of at least so many words and periods, sorted.

    A run's squares end at each of its words from the second period on; the first of them
    gives its start.
    """
    found, growing = [], {}

    def close(start: int, end: int, period: int) -> None:
        if end - start + 1 >= max(least, periods * period):
            found.append((start, end - start + 1, period))

    for end, period in squares(words):
        run = growing.get(period)
        if run and run[1] == end - 1:
            run[1] = end
            continue
        if run:
            close(*run, period)
        growing[period] = [end - 2 * period + 1, end]
    for period, run in growing.items():
        close(*run, period)
    return sorted(found)


def stretches(words: Words) -> list[tuple[int, int]]:
    """Ranges of words (end excluded) outside of which no run has any word; each lies in one text."""
    n = SIEVE_WORDS
    at = np.flatnonzero(words.last_start(n))
    grams, owner = words.shingles(n)[at], words.owner()[at]
    order = np.lexsort((at, grams, owner))
    same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    gap = np.where(same, np.diff(at[order]), np.iinfo(np.int64).max)
    nearest = np.full(len(at), np.iinfo(np.int64).max)
    if len(gap):
        nearest[order[1:]] = gap
        nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gap)
    while len(at):
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0)) + 1
        first, last = np.append(0, breaks), np.append(breaks, len(at))
        lengths = last - first + n - 1
        ok = nearest <= np.repeat(lengths // LEAST_PERIODS, last - first)
        if ok.all():
            return [(a, a + k) for a, k in zip(at[first].tolist(), lengths.tolist())]
        at, owner, nearest = at[ok], owner[ok], nearest[ok]
    return []


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def _joined(words: Words, kept: np.ndarray) -> pa.Array:
    """Per text, its kept words joined by one blank."""
    at = np.flatnonzero(kept)
    sizes = words.ends[at] - words.starts[at] + 1
    ends = np.cumsum(sizes)
    source = np.repeat(words.starts[at] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
    raw = np.append(words.data, np.uint8(32))[np.minimum(source, len(words.data))]
    raw[ends - 1] = 32
    # Kept words before each text; every text loses the blank after its last word.
    before = np.concatenate([[0], np.cumsum(kept)])[words.first]
    offsets = np.concatenate([[0], ends])[before]
    filled = np.diff(before) > 0
    keep = np.ones(len(raw), bool)
    keep[offsets[1:][filled] - 1] = False
    offsets = offsets - np.concatenate([[0], np.cumsum(filled)])
    if len(raw) > np.iinfo(np.int32).max:
        return pa.LargeStringArray.from_buffers(len(filled), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[keep])).cast(pa.string())
    return pa.StringArray.from_buffers(len(filled), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[keep]))


def found_in(texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, int]]], pa.Array]:
    """Per text: number of words, runs, and the text without repeated words."""
    words = split_words(texts, IN_WORD, fold=False)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kept = np.ones(len(words.starts), bool)
    for a, b in stretches(words):
        k = int(np.searchsorted(words.first, a, side="right")) - 1
        found = runs_of(np.unique(words.hashes[a:b], return_inverse=True)[1].tolist())
        kept[a:b] &= ~repeated(b - a, found)
        runs[k] += [(start + a - int(words.first[k]), length, period) for start, length, period in found]
    return np.diff(words.first).tolist(), runs, _joined(words, kept)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``; columns of these names are replaced.

    ``runs`` holds every maximal run of at least :data:`LEAST_WORDS` words and
    :data:`LEAST_PERIODS` periods as ``start`` (word number from 0), ``length`` and smallest
    ``period``, by start and period. ``collapsed`` has the words that no run contains after
    its first period, joined by one blank. Null, empty and blank texts have no words, no runs
    and an empty ``collapsed``. Rows are independent: repeated rows and null ids give equal
    results each; an empty table gives an empty table. Nothing is shuffled. A task holds one
    slice of texts, and for one stretch of repetitions at a time a few hundred bytes a word.
    """
    own, back = set_aside(docs, ["_run_text", *ADDED])
    kept = own.columns
    schema = own.withColumns({c: F.lit(None).cast(t) for c, t in ADDED.items()}).schema
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, "_run_text"):
                counts, runs, collapsed = found_in(texts)
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs]
                columns = [batch.column(c).slice(first, len(texts)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(rows, run_type), collapsed], names=[*kept, *ADDED])

    found = own.withColumn("_run_text", F.col("text").cast("binary")).mapInArrow(work, schema)
    names = {c.lower() for c in ADDED}
    return found.select(*(b for c, b in zip(docs.columns, back) if c.lower() not in names), *ADDED)
