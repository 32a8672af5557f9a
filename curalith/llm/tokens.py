"""Ids of a public word-level BPE tokenizer, encoded once per distinct piece of a worker."""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from curalith.llm.words import Words, byte_class, split_words, word_bytes

#: A worker forgets its pieces beyond so many, and beyond so many bytes each on average, which bounds its memory.
CACHED_WORDS, CACHED_CHARS = 500_000, 16
#: Bytes of text encoded at one time: larger slices have fewer distinct pieces.
SLICE_BYTES = 4_000_000
#: Pieces encoded in one call.
CALL_WORDS = 2000
_IN_WORD = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Kinds of bytes. Odd ones keep their word whole: upper case, apostrophes, control characters and all beyond Latin-1.
_BLANK, _LETTER, _SIGN, _DIGIT, _ODD = range(5)
_KIND = np.where(_IN_WORD, _ODD, _BLANK).astype(np.uint8)
_KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x61:0x7B] = _LETTER
#: ß-ö and ø-ÿ, lower-case letters that are their own normal form, are the byte C3 and one of these.
_KIND[[0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = _LETTER
#: What a piece takes at least, by its bytes: the BPE model, that model behind a byte mapping, the whole library.
_PLAIN, _MAPPED, _WHOLE = range(3)
_TAKES = np.select([_KIND > _LETTER, np.arange(256) > 0x7F], [_WHOLE, _MAPPED], _PLAIN).astype(np.uint8)


def _pieces(words: Words) -> Words:
    """Words cut where letters, single digits and runs of signs meet; those with an odd byte or ``<|`` stay whole."""
    kind = np.zeros(len(words.data) + 2, np.uint8)
    inner = kind[1:-1]
    np.take(_KIND, words.data, out=inner)
    opens = np.flatnonzero(words.data[:-1] == ord("<"))
    inner[opens[words.data[opens + 1] == ord("|")]] = _ODD
    odd = np.maximum.reduceat(inner, words.starts) == _ODD
    if odd.any():
        inner[_ranges(words.starts[odd], (words.ends - words.starts)[odd])] = _ODD
    edge = kind[1:] != kind[:-1]
    edge |= kind[1:] == _DIGIT
    starts, ends = np.flatnonzero(edge & (kind[1:] != _BLANK)), np.flatnonzero(edge & (kind[:-1] != _BLANK))
    return Words(words.data, starts, ends, np.searchsorted(starts, np.append(words.starts, len(words.data))[words.first]))


class WordTokenizer:
    """Encodes texts through the tokenizers library, piece by piece with a bounded memory.

    Holds for tokenizers that drop white space and never join across it: there the ids of a
    text are the ids of its words in order. ``word_bpe_49k`` is one; the tests compare whole
    texts with the library's own result. Where the tokenizer marks the ends of words and parts
    letters, digits and signs (both are tried out), words are cut there, and pieces of plain
    letters go to its BPE model without the steps that leave them as they are. Elsewhere a
    piece is a word. Pieces are cut and told apart in arrays, so only distinct ones reach Python.
    """

    def __init__(self, path: str, most_words: int | None = None):
        self.most_words = most_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        self.folds = ids("ABCDEFGHIJKLMNOPQRSTUVWXYZ") == ids("abcdefghijklmnopqrstuvwxyz")
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        # ASCII letters are what they are among a byte-level model's characters, so they need no mapping.
        self.plain, self.letters = Tokenizer(self.library.model), Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if suffix:
            self.ends[[n for token, n in self.library.get_vocab().items() if token.endswith(suffix) and n < len(self.ends)]] = True
        sample = ["the", "thou", "zq", "straße", "élan"]
        self.parts = bool(
            suffix
            and ids("ab12%&x") == [i for p in ("ab", "1", "2", "%&", "x") for i in ids(p)]
            and self.letters.encode(" ".join(sample), add_special_tokens=False).ids == [i for w in sample for i in ids(w)]
            and self.plain.encode(" ".join(sample[:3]), add_special_tokens=False).ids == [i for w in sample[:3] for i in ids(w)]
        )
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.bytes = 0
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)

    def _learn(self, new: list[bytes], takes: np.ndarray) -> np.ndarray:
        """Encodes pieces that are not known; their numbers."""
        numbers = np.empty(len(new), np.int64)
        for kind, coder in ((_PLAIN, self.plain), (_MAPPED, self.letters), (_WHOLE, None)):
            at = np.flatnonzero(takes == kind)
            numbers[at] = np.arange(len(self.numbers), len(self.numbers) + len(at))
            for k in range(0, len(at), CALL_WORDS):
                own = [new[i] for i in at[k : k + CALL_WORDS].tolist()]
                text = b" ".join(own).decode()
                if coder:
                    ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                    self._add(own, ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
                else:
                    self._add(own, *self._encode_words(text))
        return numbers

    def _encode_words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text of words, and how many each word has."""
        found = self.library.encode(text, add_special_tokens=False)
        begins = np.cumsum([0, *(len(w) + 1 for w in text.split(" "))])
        places = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
        return np.array(found.ids, np.uint32), np.bincount(np.searchsorted(begins, places, side="right") - 1, minlength=len(begins) - 1)

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.numbers)
        self.numbers.update(zip(words, range(first, first + len(words))))
        while len(self.numbers) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[first : len(self.numbers)] = lengths
        self.starts[first : len(self.numbers)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.bytes += sum(map(len, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        most = self.most_words or CACHED_WORDS
        if len(self.numbers) > most or self.bytes > most * CACHED_CHARS:
            self.forget()
        # A-Z may be folded beforehand unless the text may hold a special token's name.
        raw = [(t.encode().lower() if self.folds and "<|" not in t else t.encode()) for t in texts]
        words = split_words(raw, _IN_WORD, fold=False)
        if not len(words.starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.parts:
            words = _pieces(words)
        coded = word_bytes(words, _IN_WORD).dictionary_encode()
        # The distinct pieces as one text, which is split faster than an array is taken apart.
        values = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(values)], values), pa.scalar(b" ", pa.large_binary()))[0].as_py()
        distinct = joined.split(b" ")
        known = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        if len(new):
            data = np.frombuffer(joined, np.uint8)
            begins = np.append(0, np.flatnonzero(data == ord(" ")) + 1)
            takes = np.maximum.reduceat(_TAKES[data], begins)[new] if self.parts else np.full(len(new), _WHOLE)
            known[new] = self._learn([distinct[i] for i in new.tolist()], takes)
        numbers = known[coded.indices.to_numpy()]
        lengths = self.lengths[numbers]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[_ranges(self.starts[numbers], lengths)], np.diff(before[words.first])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str, most_words: int | None = None) -> WordTokenizer:
    """The worker's tokenizer for a file; :func:`release` lets it go at a task's end."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    _LOADED[path].most_words = most_words
    return _LOADED[path]


def release() -> None:
    """Lets tokenizers and their words go, so as not to hold memory while the worker serves other stages."""
    _LOADED.clear()


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
