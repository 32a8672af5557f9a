"""Equality in joins against aggregated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column


def match(*pairs: tuple[Column, Column]) -> Column:
    """Null-safe equality of key pairs, for a right side that is aggregated by these keys.

    Rows aggregated by a key already lie by its hash, so for plain equality they would be
    joined where they are, and a hot key of the left side could not be split: the adaptive
    skew join needs a shuffle right below the join on both sides. Null-safe keys are hashed
    in another form, which brings that shuffle about; it moves only aggregated rows.
    Leave rows without a key out of the right side, where null must not match null.
    """
    return reduce(lambda a, b: a & b, (left.eqNullSafe(right) for left, right in pairs))
