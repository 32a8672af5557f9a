"""Words of many texts at once: byte positions and 64-bit hashes, by array arithmetic."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Folds A-Z; every other byte stays.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Keeps the first bytes of a lane of eight.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes outside the ranges (ends included)."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


@dataclass
class Words:
    """Folded bytes of all texts; per word its bytes' range; per text its first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends)

    def text_of(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()

    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def last_start(self, size: int) -> np.ndarray:
        """For each word, whether ``size`` words from it on lie in one text."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.starts)) + size <= ends

    def shingles(self, size: int) -> np.ndarray:
        """Hash of ``size`` words from each word on; those past a text's end mean nothing."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        for k in range(min(size, n)):
            out[: n - k] += self.hashes[k:] * np.uint64(2 * k + 1) ^ np.uint64(k)
            out = out * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
        return out


def _fold(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of ``counts`` values as a run of one value for every eight; all counts are at least one."""
    first = np.cumsum(counts) - counts
    groups = -(-counts // 8)
    inside = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups)
    at = np.repeat(first, groups) + 8 * inside
    left = np.repeat(counts, groups) - 8 * inside
    out = np.full(len(at), _STEP)
    for k in range(8):
        more = left > k
        if not more.any():
            break
        out[more] = mix(out[more] ^ values[at[more] + k]) + _STEP
    return out, groups


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal bytes have equal hashes wherever they lie.

    Lanes of eight bytes are mixed one into the other, eight lanes to a value, until each
    range is one value; so no arithmetic of the bytes' places can make ranges collide.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = (ends - starts).astype(np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes_at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    counts = np.maximum(-(-sizes // 8), 1)
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    values = lanes_at[np.repeat(starts, counts) + 8 * inside] & _KEEP[np.clip(np.repeat(sizes, counts) - 8 * inside, 0, 8)]
    values, counts = _fold(values, counts)
    while int(counts.max()) > 1:
        # Only longer ranges are folded on, so a hash does not depend on the ranges beside it.
        each = np.repeat(counts > 1, counts)
        folded, _ = _fold(values[each], counts[counts > 1])
        longer, counts = counts > 1, -(-counts // 8)
        merged = np.empty(int(counts.sum()), np.uint64)
        at = np.repeat(longer, counts)
        merged[at], merged[~at] = folded, values[~each]
        values = merged
    return mix(values + sizes.astype(np.uint64))


def split_words(texts: list[bytes | None], in_word: np.ndarray, fold: bool = True) -> Words:
    """Words are the longest runs of bytes of the class, after folding A-Z (if asked); null has none.

    The class must not hold the blank, which is put between texts.
    """
    data = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), np.uint8)
    data = _FOLD[data] if fold else data
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = in_word[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def word_bytes(words: Words, in_word: np.ndarray) -> pa.Array:
    """The words' bytes as an Arrow array, without a Python object for each; the class is that of :func:`split_words`."""
    offsets = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(offsets), pa.py_buffer(words.data[in_word[words.data]])])
