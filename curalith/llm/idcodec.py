"""Token ids as bytes: frequency ranks in one to four bytes, lengths in control bytes.

An id is replaced by its rank (0 is the most frequent id of the corpus). Four ranks share
a control byte that holds two bits each, the byte length less one; control bytes and data
bytes lie apart. Decoding looks the four lengths of a control byte up in a table.

A file is a series of blocks. All numbers are little-endian:

    magic "TIDS" | documents u32 | ids u64 | control bytes u64 | data bytes u64
    document ids i64 each | ids per document u64 each | control bytes | data bytes | line feed

A document id that is null is written as the smallest i64.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"TIDS"
HEAD = struct.Struct("<4sIQQQ")
NULL_ID = -(2**63)
#: Byte lengths of the four ranks of each control byte, and their sum.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths - 1
    control = padded[::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    used = np.arange(4, dtype=np.uint8) < lengths[:, None]
    return control.tobytes(), np.extract(used, ranks.view(np.uint8)).tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of :func:`encode`."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    if len(lengths) != n or (n and int(lengths.sum()) != len(data)):
        raise ValueError("control and data bytes do not belong together")
    out = np.zeros((n, 4), np.uint8)
    if n:
        np.place(out, np.arange(4, dtype=np.uint8) < lengths[:, None], np.frombuffer(data, np.uint8))
    return out.reshape(-1).view("<u4")


def write_block(names: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """One block; its closing line feed is left to the writer of the file."""
    control, data = encode(ranks)
    ids = np.array([NULL_ID if x is None else x for x in names], "<i8")
    head = HEAD.pack(MAGIC, len(ids), len(ranks), len(control), len(data))
    return b"".join([head, ids.tobytes(), np.asarray(counts, "<u8").tobytes(), control, data])


def read_blocks(content: bytes, ranks: bool = True) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray | None]]:
    """Document ids, ids per document and (if wanted) the ranks of each block of a file."""
    at = 0
    while at < len(content):
        magic, documents, total, n_control, n_data = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("no block begins here")
        at += HEAD.size
        names = np.frombuffer(content, "<i8", documents, at).tolist()
        counts = np.frombuffer(content, "<u8", documents, at + 8 * documents).astype(np.int64)
        at += 16 * documents
        found = decode(content[at : at + n_control], content[at + n_control : at + n_control + n_data], total) if ranks else None
        at += n_control + n_data + 1
        yield [None if x == NULL_ID else x for x in names], counts, found
