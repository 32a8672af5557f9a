"""Benchmark decontamination: a prefix-filtered set join of item windows with whole texts.

A window is ``size`` consecutive words of an item (the whole item if it has fewer). Its
tokens are its short shingles. Windows have to be contained whole, so the prefix that a
match cannot miss is one token, and the rarest one by counts over all documents makes the
fewest candidates. A candidate's start follows from the token's place in the window
(positional bound); it must lie in the text with its whole length (length bound); then the
words themselves are compared.

Items are held in blocks of bounded bytes. Each block is one pass over the documents, so
there is no limit on the benchmark; text is neither shuffled nor exploded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm.common import releasing, set_aside, text_chunks
from curalith.llm.words import Words, byte_class, split_words

#: Words are runs of ASCII letters, digits and all bytes of non-ASCII characters.
IN_WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Bytes of item text whose windows are broadcast at one time.
BLOCK_BYTES = 16_000_000
TOKEN_WORDS = 3
#: Columns that a pass adds; a column of that name in the input is replaced.
ADDED = {"_words": "long", "_hits": "array<struct<first:long,last:long>>", "_items": "array<string>"}
_BITS = np.uint64(44)  # a filter of 2**20 cells is asked before the sorted tokens


class Index:
    """Windows of some items, found by one token each."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int):
        self.size = size
        owners: dict[bytes, set[str]] = {}
        self.windows: list[bytes] = []
        words = split_words([t for _, t in items], IN_WORD)
        for k, (name, _) in enumerate(items):
            own = [words.text_of(w) for w in range(words.first[k], words.first[k + 1])]
            for at in range(max(1, len(own) - size + 1) if own else 0):
                owners.setdefault(b" ".join(own[at : at + size]), set()).add(name)
        self.windows = sorted(owners)
        self.items = [sorted(owners[w]) for w in self.windows]
        # All shingles of all windows, as (window, place, hash).
        held = split_words(self.windows, IN_WORD)
        self.lengths = np.diff(held.first)
        self.token_sizes = np.minimum(self.lengths, TOKEN_WORDS)
        rows = []
        for s in np.unique(self.token_sizes).tolist():
            hashes, owner = held.shingles(s), held.owner()
            ok = held.last_start(s) & (self.token_sizes[owner] == s)
            at = np.flatnonzero(ok)
            rows.append((owner[at], at - held.first[owner[at]], hashes[at]))
        self.all_window, self.all_place, self.all_hash = (np.concatenate(c) if rows else np.empty(0, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (np.int64, np.int64, np.uint64)))
        self.tokens = np.unique(self.all_hash)

    def choose(self, counts: np.ndarray) -> None:
        """Keeps each window's rarest token; ``counts`` belong to :attr:`tokens`."""
        rarity = counts[np.searchsorted(self.tokens, self.all_hash)] if len(self.tokens) else np.empty(0)
        order = np.lexsort((self.all_place, self.all_hash, rarity, self.all_window))
        _, best = np.unique(self.all_window[order], return_index=True)
        best = order[best]
        best = best[np.argsort(self.all_hash[best], kind="stable")]
        self.window, self.place, self.token = self.all_window[best], self.all_place[best], self.all_hash[best]
        del self.all_window, self.all_place, self.all_hash
        self.tokens = np.unique(self.token)
        self.filter = _filter(self.tokens)

    def sizes(self) -> list[int]:
        return np.unique(self.token_sizes).tolist()

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window number of every occurrence, repeated ones included."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        owner = words.owner()
        for s in self.sizes():
            at, hashes = _seen(words, s, self.tokens, self.filter)
            low, high = np.searchsorted(self.token, hashes), np.searchsorted(self.token, hashes, side="right")
            n = high - low
            entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            window = self.window[entry]
            start = np.repeat(at, n) - self.place[entry]
            text = np.repeat(owner[at], n)
            ok = (self.token_sizes[window] == s) & (start >= words.first[text]) & (start + self.lengths[window] <= words.first[text + 1])
            found.append((start[ok], window[ok]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start, window = (np.concatenate(c) for c in zip(*found))
        same = [b" ".join(words.text_of(w) for w in range(a, a + self.lengths[k])) == self.windows[k] for a, k in zip(start.tolist(), window.tolist())]
        same = np.array(same, bool)
        return start[same], window[same]


def _filter(tokens: np.ndarray) -> np.ndarray:
    cells = np.zeros(1 << 20, bool)
    cells[(tokens >> _BITS).astype(np.int64)] = True
    return cells


def _seen(words: Words, size: int, tokens: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words from which a shingle of the tokens begins, and its hash."""
    hashes = words.shingles(size)
    at = np.flatnonzero(cells[(hashes >> _BITS).astype(np.int64)] & words.last_start(size))
    own = hashes[at]
    k = np.minimum(np.searchsorted(tokens, own), max(len(tokens) - 1, 0))
    ok = tokens[k] == own if len(tokens) else np.zeros(len(own), bool)
    return at[ok], own[ok]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """Items in blocks of about ``block_bytes``, each read by itself."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-total // block_bytes) or 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        if rows:
            yield [(r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in rows]


def token_counts(docs: DataFrame, index: Index) -> np.ndarray:
    """How often each token of the index occurs in all documents; a row per token reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast((index.tokens, index.sizes()))
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes = shared.value
        cells, total = _filter(tokens), np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, texts in text_chunks(batch):
                words = split_words(texts, IN_WORD)
                for s in sizes:
                    _, found = _seen(words, s, tokens, cells)
                    total += np.bincount(np.searchsorted(tokens, found), minlength=len(tokens))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(index.tokens), np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    return counts


def marked(docs: DataFrame, items: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``_words`` (count), ``_hits`` (merged word ranges, end excluded) and ``_items`` (sorted names).

    All columns of ``docs`` stay. Null or empty text has no words and no hits; an item
    without words has no window; a null item id is named ``null``; repeated items count
    once. Without items, nothing is hit. Columns named as :data:`ADDED` or ``_text`` are replaced.
    """
    docs = docs.drop(*ADDED, "_text")
    out = docs.withColumns({c: F.lit(0).cast(t) if t == "long" else F.array().cast(t) for c, t in ADDED.items()})
    blocks = _blocks(items, block_bytes)
    block = next(blocks, [])
    while block is not None:
        index = Index(block, size)
        index.choose(token_counts(docs, index))
        out = _pass(out.withColumn("_text", F.col("text").cast("binary")), index)
        block = next(blocks, None)
    return out


def _pass(docs: DataFrame, index: Index) -> DataFrame:
    """One block of items over all documents, added to what earlier blocks found."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kept = [c for c in docs.columns if c not in (*ADDED, "_text")]
    schema = docs.select(*kept, *ADDED).schema
    hit_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            old_hits, old_items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
            counts: list[int] = []
            for first, texts in text_chunks(batch, "_text"):
                words = split_words(texts, IN_WORD)
                counts += np.diff(words.first).tolist()
                start, window = index.hits(words)
                if len(start):
                    _add(first, words, start, window, index, old_hits, old_items)
            arrays = [batch.column(c) for c in kept] + [pa.array(counts, pa.int64()), pa.array(old_hits, hit_type), pa.array(old_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *ADDED])

    return docs.mapInArrow(work, schema)


def _add(first: int, words: Words, start: np.ndarray, window: np.ndarray, index: Index, hits: list, items: list) -> None:
    text = np.searchsorted(words.first, start, side="right") - 1
    for k in np.unique(text).tolist():
        own = text == k
        base = int(words.first[k])
        ranges = sorted({(a - base, a - base + int(index.lengths[w])) for a, w in zip(start[own].tolist(), window[own].tolist())} | {(h["first"], h["last"]) for h in hits[first + k]})
        merged: list[list[int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        hits[first + k] = [{"first": a, "last": b} for a, b in merged]
        items[first + k] = sorted({x for w in np.unique(window[own]).tolist() for x in index.items[w]} | set(items[first + k]))


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """One row per document: counts, the items' digest, and whether anything was hit."""
    found = marked(docs.select("doc_id", "text"), items, size)
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"])
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any hit, unchanged."""
    own, columns = set_aside(docs, [*ADDED, "_text"])
    return marked(own, items, size).where(F.size("_hits") == 0).select(*columns)
