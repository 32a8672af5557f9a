"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The n-grams are of characters: each that the trusted text holds is a symbol of its own, but for
digits, which count as one. The most frequent ones are an alphabet of 64 symbols with a dense
table of all their grams (``64 ** ORDER``, whatever the corpus). Grams with any other character
are rows of Spark tables, as many as the trusted text has. So words that the trusted text lacks
are still scored by their spelling, in every script that it has.

*Counts*: each task counts the grams of its texts; Spark adds the counts by gram. *Model*:
grams, contexts and lower orders are tables joined order by order on the context, with
discounts from the counts of counts. *Score*: grams of frequent characters meet the dense table
where the text lies, by an array lookup; each text's other grams are joined with the tables and
summed by text. *Threshold*: how far
log-perplexity may lie above its language's median is a high quantile of the trusted
documents' own distances, shrunk by what a text's length lets them scatter. *Toxic words*:
perplexity hardly differs for toxic text, so words that labelled toxic documents have more
often than others, by more than chance, are counted over all labelled documents; a document
whose words make it toxic with high probability goes too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalith.llm.bloom import Bloom
from curalith.llm.common import CHUNK_CHARS, releasing, set_aside, stored, text_chunks

SYMBOL_BITS, ORDER = 6, 4
SYMBOLS = 1 << SYMBOL_BITS
#: Symbols that no single character has: text border, other letter, digit, anything else.
BORDER, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: This share of a language's trusted documents lies within its limit.
QUANTILE = 0.995
#: Of each seen character's count, what goes to an unseen one of its symbol.
UNSEEN = 0.5
#: A text of so many characters scatters twice as much (in variance) as an endless one.
NOISE_CHARS = 256
#: A language's median and quantile weigh as many documents as it has, those of all languages as many as these.
MEDIAN_PRIOR, QUANTILE_PRIOR = 10, 100
#: A word must be in so many toxic documents to tell anything.
LEAST_TOXIC = 3
#: A document is toxic if its words make it so with this probability.
CERTAIN = 0.95
#: Different words that a task counts before it hands them on.
WORDS_HELD = 100_000
#: Logarithms are added as whole numbers of this part, so that no sum depends on its order.
LOG_PART = 2.0**-32
#: What a text has of the model's parts: the sum over the alphabet's grams, and its other grams.
SUMS = "_total double, _chars bigint, _contexts array<bigint>, _symbols array<int>, _times array<bigint>, _toxic boolean"
#: Bytes of text scored at one time, beside the model that each worker holds.
SCORED_BYTES = CHUNK_CHARS // 4
_WORD = re.compile(r"\w+")


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after a border (-1), and the texts' first places."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(lengths + 1) - lengths - 1
    codes = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le"), "<u4").astype(np.int32)
    codes[first] = -1
    return codes, first


def alphabet(chars: dict[int, int]) -> np.ndarray:
    """Table from code point to symbol: the most frequent characters have one of their own, see :func:`characters` for the others."""
    import unicodedata

    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table = np.full(0x110001, OTHER, np.uint8)
    table[:-1][kinds == "L"] = LETTER
    table[:-1][kinds == "N"] = DIGIT
    own = sorted((c for c in chars if table[c] != DIGIT), key=lambda c: (-chars[c], c))[: SYMBOLS - 4]
    table[own] = np.arange(4, 4 + len(own))
    table[-1] = BORDER
    return table


def characters(chars: dict[int, int], letters: np.ndarray) -> np.ndarray:
    """Table from code point to its symbol in the grams: that of the alphabet, or for any other
    character of the trusted text one from ``SYMBOLS`` on. Unmet characters share theirs."""
    table = letters.astype(np.int32)
    others = sorted(c for c in chars if letters[c] in (LETTER, OTHER))
    table[others] = np.arange(SYMBOLS, SYMBOLS + len(others))
    return table


def spellings(chars: dict[int, int], letters: np.ndarray) -> np.ndarray:
    """Table from code point to the logarithm of its share of its symbol.

    A character that has its own symbol is all of it, as is one that the trusted text lacks
    if no other has its symbol. Where characters share a symbol, those that the trusted text
    lacks are taken to be as many as those it has. Digits stay one symbol, as it does not
    matter which number a text holds.
    """
    counts = np.zeros(len(letters))
    counts[list(chars)] = list(chars.values())
    table = np.zeros(len(letters), np.float32)
    for symbol in (LETTER, OTHER):
        of = np.flatnonzero(letters == symbol)
        met = counts[of]
        if met.any():
            table[of] = np.log(np.where(met > 0, met - UNSEEN, UNSEEN) / met.sum())
    return table


def _places(first: np.ndarray, n: int) -> np.ndarray:
    """Each place's distance from its text's border."""
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def _contexts(symbols: np.ndarray, place: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """The symbols before each place, or those ``at`` some (borders before the text), as a number of base ``size``, which 64 bits hold."""
    out = np.zeros(len(symbols) if at is None else len(at), np.int32 if size == SYMBOLS else np.int64)
    near = place if at is None else place[at]
    for k in range(ORDER - 1, 0, -1):
        if at is None:
            back = np.zeros(len(symbols), np.int32)
            back[k:] = symbols[:-k]
        else:
            back = symbols[np.maximum(at - k, 0)]
        back[near < k] = BORDER
        out *= size
        out += back
    return out


def _summed(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Different keys, in order, with the sums of ``n``."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return tuple(k[new] for k in keys), np.add.reduceat(n[order], np.flatnonzero(new)) if len(order) else n


@dataclass
class Dense:
    """What every worker holds: the tables of characters, and the natural logarithm of the
    probability of each gram of the alphabet. ``size`` is the number of all symbols, and
    ``spelling`` an unmet character's share of its symbol."""

    letters: np.ndarray
    symbols: np.ndarray
    size: int
    table: np.ndarray
    spelling: np.ndarray

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
        """Each text's sum over grams of the alphabet and its length; its other grams as (text,
        context, symbol), and how often it has each."""
        codes, first = _code_points(texts)
        symbols = self.symbols[codes]
        place = _places(first, len(codes))
        rare = symbols >= SYMBOLS
        near = rare.copy()
        for k in range(1, ORDER):
            near[k:] |= rare[:-k] & (place[k:] >= k)
        folded = np.where(rare, BORDER, symbols)
        grams = _contexts(folded, place, SYMBOLS) * SYMBOLS + folded
        logs = np.where(near | (place == 0), np.float16(0), self.table[grams]).astype(np.float32) + self.spelling[codes]
        total = np.add.reduceat(logs, first) if len(first) else np.empty(0, np.float32)
        lengths = np.diff(np.append(first, len(codes))) - 1
        at = np.flatnonzero(near)
        text = np.searchsorted(first, at, side="right") - 1
        found = _summed((text, _contexts(symbols, place, self.size, at).astype(np.int64), symbols[at]), np.ones(len(at), np.int64))
        return total, lengths, *found


def dense_table(grams: np.ndarray, seen: np.ndarray, backoff: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Logarithms of the grams that were seen, and for others of their context's share of the
    lower order; shard ``s`` is the slice of first symbol ``s``."""
    order = np.argsort(grams, kind="stable")
    grams, seen = grams[order], seen[order]
    size = SYMBOLS ** (ORDER - 1)
    cuts = np.searchsorted(grams, np.arange(SYMBOLS + 1, dtype=np.int64) * size)
    table = np.empty(SYMBOLS * size, np.float16)
    for s in range(SYMBOLS):
        context = backoff[s * size // SYMBOLS : (s + 1) * size // SYMBOLS]
        shard = (context[:, None] * lower.reshape(-1, SYMBOLS)).reshape(-1)
        shard[grams[cuts[s] : cuts[s + 1]] - s * size] = seen[cuts[s] : cuts[s + 1]]
        table[s * size : (s + 1) * size] = np.log(np.maximum(shard, 1e-9))
    return table


@dataclass
class Model:
    """The dense table for the workers, and the tables of all grams and contexts of each order."""

    dense: Dense
    levels: dict[int, tuple[DataFrame, DataFrame]]

    @property
    def letters(self) -> np.ndarray:
        return self.dense.letters

    def logs(self, grams: DataFrame) -> DataFrame:
        """``context, symbol, log`` of the different grams, in whole :data:`LOG_PART`: the highest
        order that has the gram, times the shares that unseen grams of longer contexts have."""
        found, share, p = grams.select("context", "symbol").distinct(), F.lit(1.0), F.lit(None)
        for k in range(ORDER, 0, -1):
            tail = F.col("context") % F.lit(self.dense.size ** (k - 1)).cast("long")
            seen, contexts = self.levels[k]
            seen = seen.select(F.col("context").alias(f"g{k}"), F.col("symbol").alias(f"s{k}"), F.col("p").alias(f"p{k}"))
            contexts = contexts.select(F.col("context").alias(f"c{k}"), F.col("backoff").alias(f"b{k}"))
            found = found.join(seen, (tail == F.col(f"g{k}")) & (F.col("symbol") == F.col(f"s{k}")), "left").join(contexts, tail == F.col(f"c{k}"), "left")
            p = F.coalesce(p, share * F.col(f"p{k}"))
            share = share * F.coalesce(F.col(f"b{k}"), F.lit(1.0))
        p = F.greatest(F.coalesce(p, share / self.dense.size), F.lit(1e-9))
        return found.select("context", "symbol", F.round(F.log(p) / LOG_PART).cast("long").alias("log"))

    def log_perplexity(self, texts: list[str]) -> np.ndarray:
        """Mean negative log-probability of a character; an empty text has NaN. For a few texts; see :func:`scored` for tables."""
        total, lengths, (text, context, symbol), times = self.dense.sums(texts)
        total = total.astype(np.float64)
        if len(text):
            spark = self.levels[1][0].sparkSession
            logs = self.logs(spark.createDataFrame(pa.table({"context": context, "symbol": symbol}))).collect()
            log = {(r["context"], r["symbol"]): r["log"] * LOG_PART for r in logs}
            np.add.at(total, text, [t * log[c, s] for c, s, t in zip(context.tolist(), symbol.tolist(), times.tolist())])
        return np.where(lengths > 0, -total / np.maximum(lengths, 1), np.nan)


def _char_counts(texts: DataFrame) -> dict[int, int]:
    """How often each character occurs; Unicode bounds what reaches the driver."""
    schema = pa.schema([("c", pa.int64()), ("n", pa.int64())])

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for _, held in text_chunks(batch):
                codes, _ = _code_points(held)
                met = np.bincount(codes[codes >= 0])
                total[: len(met)] += met
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], schema=schema)

    met = texts.mapInArrow(work, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(met.column("c").to_pylist(), met.column("n").to_pylist()))


def gram_counts(texts: DataFrame, symbols: np.ndarray, size: int) -> DataFrame:
    """``context, symbol, n`` over all texts; a row per gram and task is shuffled."""
    schema = pa.schema([("context", pa.int64()), ("symbol", pa.int32()), ("n", pa.int64())])
    shared = texts.sparkSession.sparkContext.broadcast(symbols)

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, met, total = shared.value, (np.empty(0, np.int64), np.empty(0, np.int32)), np.empty(0, np.int64)
        for batch in batches:
            for _, held in text_chunks(batch):
                codes, first = _code_points(held)
                own, place = table[codes], _places(first, len(codes))
                inside = np.flatnonzero(place > 0)
                keys, n = _summed((_contexts(own, place, size)[inside].astype(np.int64), own[inside]), np.ones(len(inside), np.int64))
                met, total = _summed(tuple(map(np.concatenate, zip(met, keys))), np.concatenate([total, n]))
        yield pa.RecordBatch.from_arrays([pa.array(met[0]), pa.array(met[1]), pa.array(total)], schema=schema)

    return texts.mapInArrow(work, "context long, symbol int, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order, from the number of grams that occur one to four times."""
    met = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (met.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.1), k - 0.1) for k, d in enumerate(found, 1)]


def probabilities(counts: DataFrame, size: int, order: int = ORDER) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Per order, ``context, symbol, p`` of the seen grams and ``context, backoff``, as stored tables.

    Below the highest order a gram counts how many grams it ends (its continuations).
    Probabilities of an order are interpolated with those of the next lower one by joins on
    the context and on the gram without its first symbol.
    """

    def without_first(k: int) -> Column:
        """Context of the gram of order ``k`` that ends a longer one."""
        return F.col("context") % F.lit(size ** (k - 1)).cast("long")

    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        held = levels[k + 1].groupBy(without_first(k).alias("context"), "symbol").agg(F.count("*").alias("n"))
        levels[k] = stored(held, f"grams-{k}")
    out: dict[int, tuple[DataFrame, DataFrame]] = {}
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(levels[k])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        grams = levels[k].select("context", "symbol", "n", cut.alias("cut"))
        contexts = grams.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("backoff"))
        grams = grams.join(contexts, "context")
        if k == 1:
            lower = F.lit(1.0 / size)
        else:
            below = out[k - 1][0].select(F.col("context").alias("tail"), "symbol", F.col("p").alias("below"))
            grams, lower = grams.withColumn("tail", without_first(k - 1)).join(below, ["tail", "symbol"]), F.col("below")
        found = grams.select("context", "symbol", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("backoff") * lower).alias("p"))
        out[k] = stored(found, f"p-{k}"), stored(contexts.select("context", "backoff"), f"backoff-{k}")
    return out


def fit(texts: DataFrame) -> Model:
    """The model of a table of trusted texts. The driver gets tables whose size the alphabet bounds."""
    chars = _char_counts(texts)
    letters = alphabet(chars)
    symbols = characters(chars, letters)
    size = max(SYMBOLS, int(symbols.max()) + 1)
    levels = probabilities(stored(gram_counts(texts, symbols, size), "grams"), size)

    def of_alphabet(df: DataFrame, length: int) -> tuple[DataFrame, Column]:
        """Rows whose context has only symbols of the alphabet, and its number of that base."""
        digits = [F.expr(f"context div {size**i}L % {size}") for i in range(length)]
        for digit in digits:
            df = df.where(digit < SYMBOLS)
        return df, sum((digit * SYMBOLS**i for i, digit in enumerate(digits)), F.lit(0).cast("long"))

    def columns(df: DataFrame, key: Column, value: str) -> tuple[np.ndarray, np.ndarray]:
        table = df.select(key.cast("long"), value).toArrow()
        return table.column(0).to_numpy().astype(np.int64), table.column(1).to_numpy().astype(np.float32)

    def order_of(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grams of the alphabet, their probabilities, and each context's share for others."""
        seen, number = of_alphabet(levels[k][0].where(F.col("symbol") < SYMBOLS), k - 1)
        grams, p = columns(seen, number * SYMBOLS + F.col("symbol"), "p")
        contexts, rest = columns(*of_alphabet(levels[k][1], k - 1), "backoff")
        backoff = np.ones(SYMBOLS ** (k - 1), np.float32)
        backoff[contexts] = rest
        return grams, p, backoff

    lower = np.full(SYMBOLS, 1 / size, np.float32)
    for k in range(1, ORDER):
        grams, p, backoff = order_of(k)
        if k == 1:
            dense = np.full(SYMBOLS, backoff[0] / size, np.float32)
        else:
            dense = (backoff[:, None] * lower.reshape(-1, SYMBOLS)[np.arange(len(backoff)) % max(1, SYMBOLS ** (k - 2))]).reshape(-1)
        dense[grams] = p
        lower = dense
    grams, p, backoff = order_of(ORDER)
    unmet = np.where(symbols < SYMBOLS, spellings(chars, letters), np.float32(0))
    return Model(Dense(letters, symbols, size, dense_table(grams.astype(np.int32), p, backoff, lower), unmet), levels)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, trusted, toxic`` of all labelled documents, stored.

    A Bloom filter of the labelled ids, which is bounded, lets few other texts through to the
    join, which decides. The join is a merge at every size: Spark splits an id that many rows
    share, and what is shuffled stays the same share of the texts.
    """
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), toxic.alias("toxic"), (F.coalesce(F.col("quality") == 1, F.lit(False)) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("trusted"))
    marks = stored(own.where("doc_id is not null").groupBy("doc_id").agg(F.max("trusted").alias("trusted"), F.max("toxic").alias("toxic")), "marks")
    sieve = docs.sparkSession.sparkContext.broadcast(Bloom.of(marks, "doc_id"))

    @F.pandas_udf("boolean")
    def may_be_labelled(ids: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.may_hold(ids.to_numpy(np.int64)))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return stored(texts.where(may_be_labelled("doc_id")).join(marks.hint("merge"), "doc_id").select("text", "trusted", "toxic"), "labelled")


def fit_trusted(known: DataFrame) -> Model:
    """Model of all trusted documents of :func:`labelled`."""
    return fit(known.where("trusted").select("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, a, b`` from ``text, toxic``: in how many toxic documents a word occurs, and in how many others."""
    schema = pa.schema([("word", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def rows(met: tuple[Counter, Counter]) -> pa.RecordBatch:
        words = list(met[1] | met[0])
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([met[k][w] for w in words], pa.int64()) for k in (1, 0))], schema=schema)
        for m in met:
            m.clear()
        return out

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Counter(), Counter()
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for first, held in text_chunks(batch):
                for i, text in enumerate(held, first):
                    met[toxic[i]].update(set(_WORD.findall(text.lower())))
                    if len(met[0]) + len(met[1]) > WORDS_HELD:
                        yield rows(met)
        yield rows(met)

    return texts.select("text", "toxic").mapInArrow(work, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


@dataclass
class Toxicity:
    """Log-ratios of the words that tell toxic text, and what those of a toxic text add up to at least."""

    words: dict[str, float]
    least: float

    def found(self, texts: list[str]) -> list[bool]:
        words = self.words
        if not words:
            return [False] * len(texts)
        return [sum(words[w] for w in words.keys() & set(_WORD.findall(t.lower()))) > self.least for t in texts]


def fit_toxic(known: DataFrame) -> Toxicity:
    """What all documents of :func:`labelled` tell of toxic words.

    A word is taken if its share of toxic documents is beyond chance (a Chernoff bound, with
    as many trials as there are words to try) and its log-ratio beats the odds. So the driver
    gets the vocabulary of toxic text and not that of the corpus.
    """
    met = stored(word_counts(known).where(F.col("a") >= LEAST_TOXIC), "toxic-words")
    n = known.agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.sum((~F.col("toxic")).cast("long")).alias("b")).first()
    toxic, other, tried = n["a"] or 0, n["b"] or 0, met.count()
    if not (toxic and other and tried):
        return Toxicity({}, 0.0)
    share, odds = toxic / (toxic + other), float(np.log(other / toxic))
    a, b = F.col("a"), F.col("b")
    apart = a * F.log(a / (a + b) / share) + F.when(b > 0, b * F.log(b / (a + b) / (1 - share))).otherwise(0.0)
    ratio = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (other + 1))
    chosen = met.select("word", ratio.alias("ratio")).where((a / (a + b) > share) & (apart > float(np.log(tried)) + 1) & (ratio > max(odds, 0.0)))
    return Toxicity({r["word"]: r["ratio"] for r in chosen.collect()}, odds + float(np.log(CERTAIN / (1 - CERTAIN))))


def scored(docs: DataFrame, model: Model, toxicity: Toxicity) -> DataFrame:
    """``docs`` without their text, with ``_score``, the log-perplexity of the whole text (null for null or empty text), and ``_toxic``.

    A text's grams beyond the alphabet are stored with its sum over the others, joined with
    the model's tables once per different gram and summed by text.
    """
    kept = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model.dense)
    toxic_words = docs.sparkSession.sparkContext.broadcast(toxicity)

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, texts in text_chunks(batch, limit=SCORED_BYTES):
                total, lengths, (text, *grams), times = shared.value.sums(texts)
                ends = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in (*grams, times)]
                parts.append([pa.array(total, pa.float64()), pa.array(lengths), *lists, pa.array(toxic_words.value.found(texts), pa.bool_())])
            if parts:
                found = [pa.concat_arrays(column) for column in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=schema.names)

    schema = T.StructType([*docs.select(*kept).schema.fields, *T._parse_datatype_string(SUMS).fields])
    own = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(work, schema)
    sums = stored(own.withColumn("_row", F.monotonically_increasing_id()), "sums")
    lists = F.explode(F.arrays_zip(F.col("_contexts").alias("context"), F.col("_symbols").alias("symbol"), F.col("_times").alias("times")))
    places = sums.select("_row", lists.alias("_gram")).select("_row", "_gram.*")
    logs = stored(model.logs(places), "logs")
    rest = places.join(logs, ["context", "symbol"]).groupBy("_row").agg(F.sum(F.col("log") * F.col("times")).alias("_rest"))
    total = F.col("_total") + F.coalesce(F.col("_rest"), F.lit(0)) * LOG_PART
    return sums.join(rest, "_row", "left").select(*kept, F.when(F.col("_chars") > 0, -total / F.col("_chars")).alias("_score"), "_toxic")


def _scatter(length) -> Column:
    """By what a text's distance from the median grows for its length."""
    return F.sqrt(1 + NOISE_CHARS / F.greatest(length, F.lit(1)))


def limits(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """``lang, median, reach`` from ``doc_id, lang, _score, _length`` of all documents: a row per language.

    A text is within its limit if its log-perplexity is at most ``median + reach * scatter``.
    Both are over all trusted documents of a language, drawn to those of all languages the
    more, the fewer there are. Null is a language of its own. Without any trusted document
    there is no limit (null), and nothing is rejected.
    """

    def drawn(rows: DataFrame, value: str, share: float, prior: int, name: str) -> DataFrame:
        quantile = F.percentile_approx(value, share, 100_000)
        overall = rows.agg(quantile.alias("_all"))
        each = rows.groupBy(F.col("lang").alias("_lang")).agg(quantile.alias("_own"), F.count("*").alias("_n"))
        known = langs.join(each, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall))
        weight = F.coalesce(F.col("_n") / (F.col("_n") + prior), F.lit(0.0))
        return stored(known.select("lang", (F.col("_all") + (F.coalesce("_own", "_all") - F.col("_all")) * weight).alias(name)), name)

    own = scores.where("_score is not null").join(trusted_ids(labels), "doc_id")
    langs = scores.select("lang").distinct()
    medians = drawn(own, "_score", 0.5, MEDIAN_PRIOR, "median").withColumnRenamed("lang", "_lang2")
    apart = own.join(medians, F.col("lang").eqNullSafe(F.col("_lang2"))).withColumn("_apart", (F.col("_score") - F.col("median")) / _scatter(F.col("_length")))
    reach = drawn(apart, "_apart", QUANTILE, QUANTILE_PRIOR, "reach")
    return stored(reach.join(medians, F.col("lang").eqNullSafe(F.col("_lang2"))).select("lang", "median", "reach"), "limits")


def _within(length: Column) -> Column:
    """Whether a text is within its limit, or has none, and is not toxic."""
    return F.coalesce((F.col("_score") - F.col("median")) / _scatter(length) <= F.col("reach"), F.lit(True)) & ~F.col("_toxic")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, perplexity, perplexity_limit, kept`` for every row of ``docs``.

    ``perplexity`` is null for null or empty text, which is kept: there is nothing to judge.
    A toxic text is not kept, whatever its perplexity. Repeated rows are judged alike. An empty table gives an empty table; without trusted
    text all rows are kept. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.length(F.col("text").cast("string")).alias("_length"), "text")
    known = labelled(docs, labels)
    scores = stored(scored(own, fit_trusted(known), fit_toxic(known)), "scores")
    out = scores.join(limits(scores, labels).withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.exp(F.col("median") + F.col("reach") * _scatter(F.col("_length")))
    return out.select("doc_id", "lang", F.exp("_score").alias("perplexity"), limit.alias("perplexity_limit"), _within(F.col("_length")).alias("kept"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that :func:`judged` keeps, unchanged.

    Texts are judged by their language and SHA-256. A Bloom filter of the rejected texts lets
    few others through to the join, which decides; the rest is not shuffled.
    """
    own, columns = set_aside(docs, ["_digest", "_language", "_rejected", "_rejected_lang"])
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    known = labelled(docs, labels)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.length(text).alias("_length"), F.sha2(text, 256).alias("_rejected"), "text")
    scores = stored(scored(named, fit_trusted(known), fit_toxic(known)), "scores")
    found = scores.join(limits(scores, labels).withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rejected = stored(found.where(~_within(F.col("_length"))).select("_rejected", F.col("lang").alias("_rejected_lang")).distinct(), "rejected")
    sieve = docs.sparkSession.sparkContext.broadcast(Bloom.of(rejected.select(F.xxhash64("_rejected").alias("key")).distinct(), "key"))

    @F.pandas_udf("boolean")
    def may_be_rejected(keys: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.may_hold(keys.to_numpy(np.int64)))

    own = own.withColumn("_digest", F.coalesce(F.sha2(text, 256), F.lit(""))).withColumn("_language", lang)
    met = may_be_rejected(F.xxhash64("_digest"))
    decided = own.where(met).join(rejected.hint("merge"), (F.col("_digest") == F.col("_rejected")) & F.col("_language").eqNullSafe(F.col("_rejected_lang")), "left_anti")
    return own.where(~met).unionByName(decided).select(*columns)
