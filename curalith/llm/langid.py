"""Language identification: script ranges, per-word scores, and Viterbi with a switching penalty.

*Training* counts character trigrams (with word borders) by language over all training
texts; Spark adds the counts of the tasks. Trigrams are hashed, so the model has a bound per
language. It also notes in which scripts a language is written.

*Prediction*: a word's script leaves the languages written in it as candidates; its trigrams
score these. Viterbi over the words finds the best labels, where a change of language costs
``penalty``. The language with most letters on the path is the document's, the runs of equal
labels are its spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm.common import releasing, text_chunks

BUCKETS = 1 << 17
#: Words of a text that are labelled in steps of one word; longer texts are cut and chained.
PIECE_WORDS = 256
#: Cost of a change of language, in nats, and the weight of a trigram that was never seen.
PENALTY, SMOOTHING = 20.0, 0.05
#: A language is written in a script that has this share of its training letters.
SCRIPT_SHARE = 0.01
#: Texts with no letter.
UNKNOWN = "und"

#: First code points of ranges of scripts in the Unicode standard.
SCRIPT_RANGES = (
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0700, "Other"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"),
    (0x0B00, "Other"),
    (0x0B80, "Tamil"),
    (0x0C00, "Telugu"),
    (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x13A0, "Other"),
    (0x1780, "Khmer"),
    (0x1800, "Mongolian"),
    (0x18B0, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Latin"),
    (0x2C60, "Latin"),
    (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"),
    (0x2E00, "Other"),
    (0x2E80, "Han"),
    (0x3040, "Hiragana"),
    (0x30A0, "Katakana"),
    (0x3100, "Other"),
    (0x3130, "Hangul"),
    (0x3190, "Han"),
    (0xA000, "Other"),
    (0xA640, "Cyrillic"),
    (0xA6A0, "Other"),
    (0xA720, "Latin"),
    (0xA800, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB13, "Other"),
    (0xFB50, "Arabic"),
    (0xFE00, "Other"),
    (0xFF00, "Latin"),
    (0xFF66, "Katakana"),
    (0x10000, "Other"),
    (0x20000, "Han"),
)
_NAMES = sorted({name for _, name in SCRIPT_RANGES})


class _Tables:
    """Per code point: whether a letter, its lower-case form, its script's number. Made once per worker."""

    def __init__(self):
        chars = [chr(c) for c in range(0x110000)]
        self.letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        self.fold = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x20000):
            low = chars[c].lower()
            if len(low) == 1:
                self.fold[c] = ord(low)
        starts = np.array([s for s, _ in SCRIPT_RANGES])
        names = np.array([_NAMES.index(n) for _, n in SCRIPT_RANGES], np.uint8)
        self.script = names[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]


_TABLES: list[_Tables] = []


def _tables() -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    return _TABLES[0]


@dataclass
class WordGrams:
    """Trigram buckets of all words of some texts, and where words and texts begin."""

    buckets: np.ndarray
    gram_first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    text_first: np.ndarray
    text_start: np.ndarray


def word_grams(texts: list[str]) -> WordGrams:
    """Words are runs of letters; each has one trigram per letter and one for its end."""
    t = _tables()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text_start = np.cumsum(lengths + 1) - lengths - 1 + 1
    raw = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), "<u4")
    letter = t.letter[raw]
    edges = np.diff(letter.astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    codes = np.where(letter, t.fold[raw], 0).astype(np.uint64)
    # A gram ends at each letter and at the place after the word; its two earlier places do not leave the word's border.
    mine = letter.copy()
    mine[ends] = True
    at = np.flatnonzero(mine)
    a, b, c = codes[np.maximum(at - 2, 0)], codes[at - 1], codes[at]
    first = letter[at] & ~letter[at - 1]
    a[first] = 0
    h = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F) + c
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    gram_first = np.searchsorted(at, starts)
    bounds = np.append(text_start, len(raw))
    return WordGrams((h >> np.uint64(64 - 17)).astype(np.int32), gram_first, starts, ends, t.script[raw[starts]], np.searchsorted(starts, bounds), text_start)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # bucket x language
    candidate: np.ndarray  # script x language
    prior: np.ndarray
    penalty: float = PENALTY

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        """Language, share of letters and labelled spans (code points) of each text."""
        g, n_lang = word_grams(texts), len(self.languages)
        count = np.diff(g.text_first)
        if not n_lang or not len(g.starts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        scores = np.add.reduceat(self.logs[g.buckets], g.gram_first, axis=0).astype(np.float64)
        allowed = self.candidate[g.scripts]
        known = allowed.any(axis=1)
        least = np.where(allowed, scores, np.inf).min(axis=1, where=allowed, initial=np.inf)
        scores = np.where(known[:, None], np.where(allowed, scores, np.minimum(scores, np.where(known, least, 0)[:, None]) - 2 * self.penalty), 0.0)
        path = self._viterbi(scores, g.text_first)
        owner = np.repeat(np.arange(len(texts)), count)
        weight = np.bincount(owner * n_lang + path, (g.ends - g.starts).astype(np.float64), minlength=len(texts) * n_lang).reshape(len(texts), n_lang)
        best, total = weight.argmax(axis=1), weight.sum(axis=1)
        names = [self.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), count.tolist())]
        share = np.where(count > 0, weight.max(axis=1) / np.maximum(total, 1), 0.0)
        return names, share, self._spans(g, path, owner, len(texts))

    def _viterbi(self, scores: np.ndarray, text_first: np.ndarray) -> np.ndarray:
        """The best label of each word, all texts side by side.

        A text longer than :data:`PIECE_WORDS` is cut into pieces, so that it does not make as
        many steps as it has words. A later piece is tried from every language that may be in
        force before it; these results are chained, and each piece is then labelled from the
        language that the best chain has there. So the path is the best one for whole texts.
        """
        n_lang, count = scores.shape[1], np.diff(text_first)
        pieces = -(-count // PIECE_WORDS)
        first = np.cumsum(pieces) - pieces
        owner = np.repeat(np.arange(len(count)), pieces)
        number = np.arange(len(owner)) - first[owner]
        start = text_first[owner] + number * PIECE_WORDS
        size = np.minimum(count[owner] - number * PIECE_WORDS, PIECE_WORDS)
        entering = np.where(np.eye(n_lang, dtype=bool), 0.0, -self.penalty)
        before = np.zeros(len(owner), np.int64)  # language in force before a later piece
        final = np.full(len(owner), -1, np.int64)  # label at a piece's end, where the next piece fixes it
        long = np.flatnonzero(pieces > 1)
        if len(long):
            tried = np.flatnonzero(pieces[owner] > 1)
            rows = np.repeat(tried, n_lang)
            init = np.where((number[rows] > 0)[:, None], np.tile(entering, (len(tried), 1)), self.prior)
            ends = np.empty((len(owner), n_lang, n_lang))
            ends[tried] = self._forward(scores, start[rows], size[rows], init).reshape(-1, n_lang, n_lang)
            came = np.zeros((len(owner), n_lang), np.int64)
            value = ends[first[long], 0]
            for k in range(1, int(pieces.max())):
                more = np.flatnonzero(pieces[long] > k)
                at = first[long[more]] + k
                through = value[more][:, :, None] + ends[at]
                came[at] = through.argmax(axis=1)
                value[more] = through.max(axis=1)
            label = value.argmax(axis=1)
            for k in range(int(pieces.max()) - 1, 0, -1):
                more = np.flatnonzero(pieces[long] > k)
                at = first[long[more]] + k
                final[at], before[at] = label[more], came[at, label[more]]
                label[more] = before[at]
            final[first[long]] = label
        init = np.where((number > 0)[:, None], entering[before], self.prior)
        return self._labels(scores, start, size, init, final)

    def _forward(self, scores: np.ndarray, start: np.ndarray, size: np.ndarray, init: np.ndarray, trace: tuple | None = None) -> np.ndarray:
        """Best value of ending a piece in each language; ``trace`` takes, per word, which languages
        stay and where those that do not come from."""
        order = np.argsort(-size, kind="stable")
        begin, active = start[order], np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        value = scores[begin] + init[order]
        for t in range(1, len(active)):
            n = active[t]
            at, v = begin[:n] + t, value[:n]
            best = v.argmax(axis=1)
            change = v[np.arange(n), best][:, None] - self.penalty
            keep = v >= change
            if trace:
                trace[0][at], trace[1][at] = keep, best
            value[:n] = np.where(keep, v, change) + scores[at]
        out = np.empty_like(value)
        out[order] = value
        return out

    def _labels(self, scores: np.ndarray, start: np.ndarray, size: np.ndarray, init: np.ndarray, final: np.ndarray) -> np.ndarray:
        """The label of each word, from each piece's end (the best one where ``final`` is -1) back."""
        trace = np.ones(scores.shape, bool), np.zeros(len(scores), np.int32)
        value = self._forward(scores, start, size, init, trace)
        label = np.where(final < 0, value.argmax(axis=1), final)
        order = np.argsort(-size, kind="stable")
        begin, label = start[order], label[order]
        active = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        out = np.zeros(len(scores), np.int64)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            out[at] = label[:n]
            if t:
                label[:n] = np.where(trace[0][at, label[:n]], label[:n], trace[1][at])
        return out

    def _spans(self, g: WordGrams, path: np.ndarray, owner: np.ndarray, n: int) -> list[list[dict]]:
        begin = np.ones(len(path), bool)
        begin[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(begin)
        last = np.append(at[1:], len(path)) - 1
        base = g.text_start[owner[at]]
        out: list[list[dict]] = [[] for _ in range(n)]
        for o, a, b, k in zip(owner[at].tolist(), (g.starts[at] - base).tolist(), (g.ends[last] - base).tolist(), path[at].tolist()):
            out[o].append({"start": a, "end": b, "lang": self.languages[k]})
        return out


def fit(labelled: DataFrame, penalty: float = PENALTY) -> Model:
    """Learns from all rows of ``text, lang`` where lang is not null.

    The driver gets, per language, a count for each bucket and script that occurs, so its
    part grows with the number of languages only.
    """
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in total.items():
                key = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(key)), pa.array(key), pa.array(counts[key])], schema=schema)
            total.clear()

        for batch in batches:
            languages = batch.column("lang").to_pylist()
            for first, texts in text_chunks(batch):
                g = word_grams(texts)
                if not len(g.starts):
                    continue
                names, code = np.unique(np.array(languages[first : first + len(texts)], object), return_inverse=True)
                by_word = code[np.repeat(np.arange(len(texts)), np.diff(g.text_first))]
                by_gram = np.repeat(by_word, np.diff(np.append(g.gram_first, len(g.buckets))))
                letters = g.ends - g.starts
                for k, name in enumerate(names.tolist()):
                    if name not in total and len(total) == 32:
                        yield from flush()
                    held = total.setdefault(name, np.zeros(BUCKETS + len(_NAMES), np.int64))
                    held[:BUCKETS] += np.bincount(g.buckets[by_gram == k], minlength=BUCKETS)
                    held[BUCKETS:] += np.bincount(g.scripts[by_word == k], letters[by_word == k], minlength=len(_NAMES)).astype(np.int64)
        yield from flush()

    rows = labelled.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    table: pd.DataFrame = rows.mapInArrow(work, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    counts[table["key"], np.searchsorted(languages, table["lang"])] = table["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
    letters = scripts.sum(axis=0)
    prior = np.log(np.maximum(letters, 1) / max(letters.sum(), 1))
    return Model(languages, logs.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(letters, 1), prior, penalty)


def in_training(doc_id: str = "doc_id"):
    """Documents to learn from; the third of them with remainder 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row, from its text alone.

    ``spans`` are (start, end, lang) in code points, end excluded. A text that is null,
    empty or without a letter is ``und`` with score 0 and no span; so is every text if
    nothing could be learned. Words in a script that no learned language uses take the
    language of their surroundings. Repeated rows get the same result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", span)])

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for first, texts in text_chunks(batch):
                found, share, spans = shared.value.predict(texts)
                arrays = [names.slice(first, len(texts)), pa.array(found), pa.array(share, pa.float64()), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(work, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def identified(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """Learns from the documents that are not held out and predicts all; a null doc_id is not learned from."""
    model = fit(docs.where(in_training()).select("text", "lang"), penalty)
    out = predicted(docs, model)
    return out.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
