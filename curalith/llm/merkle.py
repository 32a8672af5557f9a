"""Document fingerprints: Merkle trees over leaves, paragraphs and sections.

A paragraph ends with a line break. A leaf is a run of words of a paragraph, up to a blank
after a word whose hash is divisible by eight; leaves cover every byte. A paragraph's digest is made of its leaves', a
section's of its paragraphs', the root of the sections'. A section ends with an empty
paragraph or one whose digest is divisible by eight. So borders follow from what stands at
them, and an edit, also an added or deleted word, moves none of the others.
Equal roots mean equal texts: the root also holds the SHA-256 of the text. Where roots
differ, the differing branches name the sections, paragraphs and leaves that changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm.common import CHUNK_CHARS, batch_of, partitions_for, range_of, releasing, split_points
from curalith.llm.words import byte_hashes, mix

LEAF_EVERY = 8
SECTION_EVERY = 8


@dataclass
class Tree:
    """Root, and per level the digests with the first child of each node (one more at the end)."""

    root: str
    sections: list[bytes]
    section_first: list[int]
    paragraphs: list[bytes]
    paragraph_first: list[int]
    leaves: np.ndarray
    leaf_first: np.ndarray


@dataclass
class Leaves:
    """Leaves of several texts: digest, first byte within all bytes, whether a paragraph ends there."""

    digests: np.ndarray
    starts: np.ndarray
    ends_paragraph: np.ndarray
    first: np.ndarray
    begins: np.ndarray


def leaves_of(texts: list[bytes]) -> Leaves:
    """Leaves of each text in order; an empty text has one empty leaf."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    line = data == 10
    stop = np.flatnonzero(line | (data == 32))
    word = byte_hashes(data, np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop, stop)
    cut = stop[line[stop] | (word % np.uint64(LEAF_EVERY) == 0)]
    ends = cut + 1
    starts = np.concatenate([[0], ends[:-1]])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Leaves(byte_hashes(data, starts, ends), starts, line[cut], np.searchsorted(starts, begins), begins)


def tree_of(leaves: Leaves, k: int, text_digest: bytes) -> Tree:
    """The tree of the ``k``-th text."""
    a, b = int(leaves.first[k]), int(leaves.first[k + 1])
    digests = leaves.digests[a:b]
    raw = digests.astype("<u8").tobytes()
    paragraph_first = [0, *(np.flatnonzero(leaves.ends_paragraph[a:b]) + 1).tolist()]
    paragraphs = [hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(paragraph_first, paragraph_first[1:])]
    section_first, lengths = [0], np.diff(np.append(leaves.starts[a:b], leaves.begins[k + 1]))
    for p, digest in enumerate(paragraphs):
        x, y = paragraph_first[p], paragraph_first[p + 1]
        if p + 1 < len(paragraphs) and (digest[0] % SECTION_EVERY == 0 or (y == x + 1 and lengths[x] == 1)):
            section_first.append(p + 1)
    section_first.append(len(paragraphs))
    sections = [hashlib.blake2b(b"".join(paragraphs[x:y]), digest_size=16).digest() for x, y in zip(section_first, section_first[1:])]
    root = hashlib.sha256(b"".join([text_digest, *sections])).hexdigest()
    return Tree(root, sections, section_first, paragraphs, paragraph_first, digests, leaves.starts[a:b] - leaves.begins[k])


def tree(text: str | None) -> Tree:
    data = (text or "").encode()
    return tree_of(leaves_of([data]), 0, hashlib.sha256(data).digest())


def differing(old: Tree, new: Tree) -> list[tuple[int, int]]:
    """Byte ranges of the old text (end excluded) whose leaves the new tree lacks.

    Only branches that the other tree does not hold are entered.
    """
    if old.root == new.root:
        return []
    sections, paragraphs, leaves = set(new.sections), set(new.paragraphs), set(new.leaves.tolist())
    ends = np.append(old.leaf_first[1:], -1)
    out: list[tuple[int, int]] = []
    for s, digest in enumerate(old.sections):
        if digest in sections:
            continue
        for p in range(old.section_first[s], old.section_first[s + 1]):
            if old.paragraphs[p] in paragraphs:
                continue
            for leaf in range(old.paragraph_first[p], old.paragraph_first[p + 1]):
                if int(old.leaves[leaf]) not in leaves:
                    out.append((int(old.leaf_first[leaf]), int(ends[leaf])))
    return out


def likeness(a: Leaves, b: Leaves, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Shared leaves of each pair of trees, as a share of both: 1 for equal leaves, 0 for none in common."""
    n = len(pairs)

    def keys(side: Leaves, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        own = np.array(which, np.int64)
        counts = side.first[own + 1] - side.first[own]
        at = np.repeat(side.first[own] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        pair = np.repeat(np.arange(n), counts)
        return mix(side.digests[at] + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), pair

    left, left_pair = keys(a, [x for x, _ in pairs])
    right, right_pair = keys(b, [y for _, y in pairs])
    both, back = np.unique(np.concatenate([left, right]), return_inverse=True)
    in_left = np.bincount(back[: len(left)], minlength=len(both))
    in_right = np.bincount(back[len(left) :], minlength=len(both))
    owner = np.zeros(len(both), np.int64)
    owner[back] = np.concatenate([left_pair, right_pair])
    shared = np.bincount(owner, np.minimum(in_left, in_right), minlength=n)
    total = np.bincount(left_pair, minlength=n) + np.bincount(right_pair, minlength=n)
    return np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """``part, lent, doc_id, text`` so that each part's rows, in order, are followed by the next row.

    Parts are ranges of doc_id. The first document of a part is also lent to the part
    before (that of the first part to the last), so a text is shuffled once, and no task
    needs another's rows. The driver learns the first id of each part, not more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    points = split_points(docs, "doc_id", 8 * partitions_for(spark))
    ids = docs.select("doc_id").withColumn("part", range_of("doc_id", points))
    heads = ids.groupBy("part").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("empty")).orderBy("part").collect()
    firsts = [None if r["empty"] else r["head"] for r in heads]
    parts = [r["part"] for r in heads]
    lender = dict(zip(firsts, parts[-1:] + parts[:-1]))

    @F.pandas_udf("int")
    def lent_to(values):
        return values.astype("object").where(values.notna(), None).map(lambda x: lender.get(None if x is None else int(x)))

    out = docs.withColumns({"part": range_of("doc_id", points), "to": lent_to("doc_id")})
    out = out.select(F.explode(F.filter(F.array(F.struct("part", F.lit(False).alias("lent")), F.struct(F.col("to").alias("part"), F.lit(True).alias("lent"))), lambda x: x["part"].isNotNull())).alias("place"), "doc_id", "text")
    return out.select("place.*", "doc_id", "text")


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
    """Results of rows that follow each other; ``following`` comes after the last."""
    texts = [t for _, t in rows] + [following]
    changed = [edited(t, n) for t, n in zip(texts, texts[1:])]
    plain_bytes, changed_bytes = [t.encode() for t in texts], [t.encode() for t in changed]
    plain, new = leaves_of(plain_bytes), leaves_of(changed_bytes)
    n = len(rows)
    digests = [hashlib.sha256(t) for t in changed_bytes]
    return batch_of(
        _SCHEMA,
        [i for i, _ in rows],
        [len(t) for t in texts[:n]],
        [d.hexdigest() for d in digests],
        [tree_of(plain, k, hashlib.sha256(plain_bytes[k]).digest()).root for k in range(n)],
        [tree_of(new, k, digests[k].digest()).root for k in range(n)],
        likeness(plain, new, [(k, k) for k in range(n)]),
        likeness(plain, plain, [(k, k + 1) for k in range(n)]),
    )


def compared(docs: DataFrame) -> DataFrame:
    """A row per document: see :data:`FINGERPRINTS`.

    Null text is empty. Documents follow each other by ascending doc_id (null first), rows
    of equal doc_id by text; the last is followed by the first, a single one by itself.
    Repeated rows are documents of their own. Other columns are ignored; an empty table
    gives an empty table.
    """

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, closed = [], 0, None, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "lent", "doc_id", "text")]
            for number, lent, name, text in zip(*columns):
                text = text or ""
                if number != part:
                    part, closed = number, False
                if closed:
                    continue
                if held and (lent or size > CHUNK_CHARS // 2):
                    yield _compare(held, text)
                    held, size = [], 0
                if lent:
                    closed = True
                else:
                    held.append((name, text))
                    size += len(text)
        assert not held, "a part lacks the row that follows it"

    rows = with_next(docs)
    ordered = rows.repartition(partitions_for(docs.sparkSession), "part").sortWithinPartitions("part", "lent", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return ordered.mapInArrow(work, FINGERPRINTS)
