"""T-occurrence search in one block: merge short inverted lists, probe long ones."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Weight of a merge step against a probe, as in the rule that picks the number of long lists.
MU = 0.01


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least ``num / den``."""

    num: int
    den: int

    def least(self, n: int) -> int:
        """Least overlap of a set of ``n`` with any partner."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        """First tokens of a set, in any fixed order, of which every partner shares one in its own."""
        return n - self.least(n) + 1 if n else 0

    def overlap(self, n, m):
        """Least overlap of sets of ``n`` and ``m``."""
        return -(-self.num * (n + m) // (self.num + self.den))


class Lists:
    """Inverted lists of the sets of a block: token -> sets that hold it, ascending."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.posting = owner[order]
        self.tokens, first = np.unique(values[order], return_index=True)
        self.first = np.append(first, len(values))

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the tokens' lists; tokens without one are left out."""
        if not len(self.tokens):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        k = k[self.tokens[k] == tokens]
        return self.first[k], self.first[k + 1]

    def search(self, tokens: np.ndarray, t: Threshold, wanted: np.ndarray) -> np.ndarray:
        """Sets of ``wanted`` (a mask) similar to the set ``tokens``."""
        n = len(tokens)
        least = t.least(n)
        wanted = wanted & (self.sizes >= least) & (self.sizes * t.num <= n * t.den)
        if not wanted.any():
            return np.empty(0, np.int64)
        begin, end = self.of(tokens)
        if len(begin) < least:
            return np.empty(0, np.int64)
        order = np.argsort(begin - end, kind="stable")  # longest first
        begin, end = begin[order], end[order]
        longest = int(end[0] - begin[0])
        n_long = min(least - 1, int(least / (MU * np.log2(longest + 1) + 1)))
        # Short lists: a merge, done as one count over all their entries.
        lengths = end[n_long:] - begin[n_long:]
        at = np.repeat(begin[n_long:] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        counts = np.bincount(self.posting[at], minlength=len(self.sizes))
        need = t.overlap(n, self.sizes)
        found = np.flatnonzero(wanted & (counts > 0) & (counts + n_long >= need))
        # Long lists: each candidate is looked up by bisection while it can still reach its overlap.
        have = counts[found]
        for k in range(n_long):
            if not len(found):
                break
            posting = self.posting[begin[k] : end[k]]
            place = np.minimum(np.searchsorted(posting, found), len(posting) - 1)
            have = have + (posting[place] == found)
            alive = have + (n_long - k - 1) >= need[found]
            found, have = found[alive], have[alive]
        return found


def linked(table: pa.Table, t: Threshold) -> pa.Table:
    """What one task's sets join: ``a, b`` for each label and the least it is joined with.

    ``asks`` tells which sets search all. Sets of one label are known to be connected and
    are not compared; any two others, of which one asks, are in one component of the
    result if they are linked.
    """
    tokens = table.column("tokens").combine_chunks()
    values, offsets = tokens.flatten().to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
    offsets = offsets - offsets[0]
    labels, own = np.unique(table.column("label").to_numpy(), return_inverse=True)
    root, groups, lists = own.copy(), len(labels), Lists(values, offsets)
    for k in np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False)).tolist():
        if groups == 1:
            break
        for other in lists.search(values[offsets[k] : offsets[k + 1]], t, root != root[k]).tolist():
            if root[other] != root[k]:
                root[root == root[other]] = root[k]
                groups -= 1
    final = np.zeros(len(labels), np.int64)
    final[own] = root
    least = np.full(len(labels), len(labels), np.int64)
    np.minimum.at(least, final, np.arange(len(labels)))
    joined = np.flatnonzero(least[final] != np.arange(len(labels)))
    return pa.table({"a": pa.array(labels[joined], pa.int64()), "b": pa.array(labels[least[final[joined]]], pa.int64())})
