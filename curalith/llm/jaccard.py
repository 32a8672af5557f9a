"""Exact near-duplicate groups by word-shingle Jaccard, searched as a T-occurrence problem.

1. Texts become sets of 64-bit tokens, one per distinct shingle. Equal sets are one class from here on, so
   large groups of copies take part once.
2. A pair at the threshold shares tokens among the first ``n - ceil(t * n) + k`` of either
   set in any fixed order. With long shingles first this finds the classes that may have a
   partner at all; only their sets are formed again, and their tokens are counted.
3. In order of rarity (rarest first) the same bound leaves a few tokens of few classes.
   Only classes that share one can be linked. Each goes to the cluster of the least class
   that it shares a token with.
4. Clusters, ordered by size of set, are cut into blocks of bounded content. A block is
   searched against itself and its neighbour by DivideSkip, see :mod:`divide_skip`; classes
   already joined are not searched again, so a group of copies costs its size, not its
   square. The links are joined into components.
5. Further pairs of blocks are searched only where two *different* components share a
   prefix token and sizes allow a link. With those links the components are final.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curalith.llm.bloom import Bloom
from curalith.llm.common import partitions_for, releasing, set_aside, stored, text_chunks
from curalith.llm.components import components
from curalith.llm.divide_skip import Threshold, linked
from curalith.llm.words import byte_class, mix, split_words

#: Words are runs of bytes other than the blank and 09-0D.
IN_WORD = byte_class((0x20, 0x20), (0x09, 0x0D))
#: One token in so many of a set must be found in other prefixes, for the set to be looked at further.
SHARE = 10
#: A block holds at most so many sets, and so many tokens (or one set).
BLOCK_SETS, BLOCK_TOKENS = 1000, 400_000


def _sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct tokens of each text: a shingle's length, longest first, then 56 bits of its hash.

    Any fixed order serves the bounds below; long shingles are the rare ones, so this one
    leaves few chance matches at the front.
    """
    words = split_words(texts, IN_WORD)
    lengths = np.cumsum(np.append(0, words.ends - words.starts))
    hashes, n = words.shingles(size), len(words.starts)
    spans = lengths[np.minimum(np.arange(n) + size, n)] - lengths[:-1]
    tokens = (np.uint64(255) - np.minimum(spans, 255).astype(np.uint64)) << np.uint64(56) | hashes >> np.uint64(8)
    first = words.first.tolist()
    for a, b in zip(first, first[1:]):
        if b - a >= size:
            yield np.unique(tokens[a : b - size + 1])
        elif b > a:  # the whole text is one shingle, told apart from longer ones by its length
            whole = np.uint64(b - a)
            for h in words.hashes[a:b]:
                whole = mix(np.array([whole], np.uint64) * np.uint64(31) + h)[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def _fingerprint(found: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(found ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (0, 0x5851F42D4C957F2D))


def _map_sets(docs: DataFrame, size: int, row, fields: list[tuple[str, pa.DataType]], kinds: str, sift=None) -> DataFrame:
    """``doc_id`` and what ``row`` gives for each text's set; texts for which it is None have no row."""
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch if sift is None else sift(batch)
            names = batch.column("doc_id").to_pylist()
            for first, texts in text_chunks(batch):
                rows = [(name, *got) for name, found in zip(names[first:], _sets(texts, size)) if (got := row(found)) is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(work, f"doc_id long, {kinds}")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, f1, f2``: size and 128-bit fingerprint of each text's set."""
    return _map_sets(docs, size, lambda found: (len(found), *_fingerprint(found)), [("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())], "n long, f1 long, f2 long")


def least_shared(n: int) -> int:
    """How many tokens of its prefix a set of ``n`` must share with its partner; see :func:`_candidates`."""
    return max(1, n // SHARE)


def _candidates(docs: DataFrame, classes: DataFrame, size: int, t: Threshold) -> DataFrame:
    """``rep`` of the classes that may have a partner.

    If two sets overlap in at least ``least(n)`` tokens, their first ``n - least(n) + k``
    tokens in a fixed order have ``k`` in common, for the smaller ``k`` of
    the two. So a class needs as many tokens in its prefix that another prefix holds too.
    Tokens are cut to 48 bits here, which can only add candidates.
    """
    low = np.uint64((1 << 48) - 1)

    def row(found: np.ndarray):
        n = len(found)
        return (n, (found[: t.prefix(n) + least_shared(n) - 1] & low).view(np.int64)) if n else None

    prefixes = _map_sets(docs, size, row, [("n", pa.int64()), ("prefix", pa.list_(pa.int64()))], "n long, prefix array<long>")
    reps = classes.select(F.col("rep").alias("doc_id"))
    held = stored(prefixes.join(reps, "doc_id", "left_semi"), "prefixes")
    each = held.select("doc_id", "n", F.explode("prefix").alias("token"))
    shared = stored(each.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "shared-tokens")
    met = each.join(shared, "token").groupBy("doc_id", "n").agg(F.count("*").alias("met"))
    partner = F.ceil(F.col("n") * t.num / t.den)
    return met.where(F.col("met") >= F.greatest(F.lit(1), F.floor(partner / SHARE))).select(F.col("doc_id").alias("rep")).distinct()


def _token_sets(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """``sid, rep, n, tokens``: the whole sets of the chosen documents, numbered.

    A Bloom filter spares most other texts the way to the join, which decides.
    """
    sieve = Bloom.of(chosen, "rep")
    shared = docs.sparkSession.sparkContext.broadcast(sieve)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def sift(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.may_hold(batch.column("doc_id").to_numpy())))

    sets = _map_sets(kept, size, lambda found: (found.view(np.int64),) if len(found) else None, [("tokens", pa.list_(pa.int64()))], "tokens array<long>", sift)
    found = sets.join(chosen.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return stored(found.select(F.monotonically_increasing_id().alias("sid"), F.col("doc_id").alias("rep"), F.size("tokens").cast("long").alias("n"), "tokens"), "sets")


def _rare_prefixes(sets: DataFrame, t: Threshold) -> DataFrame:
    """``sid, rep, n, token``: the tokens of each set's prefix, rarest first, that other sets hold too.

    Tokens of one set only come first in this order and are never shuffled by their set;
    a set whose whole prefix is of that kind has no partner and no row.
    """
    each = sets.select("sid", "rep", "n", F.explode("tokens").alias("token"))
    shared = stored(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token-counts")
    held = each.join(shared, "token").groupBy("sid", "rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"))
    need = F.col("n") - F.ceil(F.col("n") * t.num / t.den) + 1
    room = (need - (F.col("n") - F.size("held"))).cast("int")
    return held.withColumn("room", room).where("room > 0").select("sid", "rep", "n", F.explode(F.expr("slice(held, 1, room).token")).alias("token"))


def _blocked(clustered: DataFrame) -> DataFrame:
    """Adds ``block`` to ``cluster, n, rep, sid``: runs of one cluster, in order of size.

    Rows are dealt by ranges of (cluster, n, rep), so a cluster of any size spreads over
    tasks; each task cuts its runs by itself.
    """
    schema = pa.schema([("cluster", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("sid", pa.int64()), ("block", pa.int64())])

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, cluster, sets, tokens = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            out = []
            for c, n in zip(batch.column("cluster").to_pylist(), batch.column("n").to_pylist()):
                if c != cluster or sets == BLOCK_SETS or (sets and tokens + n > BLOCK_TOKENS):
                    block, cluster, sets, tokens = block + 1, c, 0, 0
                sets, tokens = sets + 1, tokens + n
                out.append(block)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("cluster", "n", "rep", "sid")), pa.array(out, pa.int64())], schema=schema)

    parts = partitions_for(clustered.sparkSession)
    ordered = clustered.select("cluster", "n", "rep", "sid").repartitionByRange(parts, "cluster", "n", "rep").sortWithinPartitions("cluster", "n", "rep")
    return ordered.mapInArrow(work, "cluster long, n long, rep long, sid long, block long")


def _search(rows: DataFrame, t: Threshold) -> DataFrame:
    """Links ``a, b`` found in groups ``task`` of ``label, asks, tokens``."""
    return rows.groupBy("task").applyInArrow(lambda table: linked(table, t), "a long, b long")


def links(docs: DataFrame, chosen: DataFrame, size: int, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """Components found block by block (``node, label``), and links ``a, b`` between their labels."""
    sets = _token_sets(docs, chosen, size)
    prefixes = stored(_rare_prefixes(sets, t), "prefixes")
    least = stored(prefixes.groupBy("token").agg(F.min("rep").alias("m"), F.max("rep").alias("x")).where("m <> x").select("token", "m"), "token-leaders")
    nodes = prefixes.join(least, "token").groupBy("sid", "rep", "n").agg(F.min("m").alias("cluster"))
    blocks = stored(_blocked(stored(nodes, "nodes")), "blocks")

    heads = blocks.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    follow = Window.partitionBy("cluster").orderBy("low", "block")
    heads = stored(heads.withColumn("next", F.lead("block").over(follow)), "block-heads")
    held = blocks.join(sets.select("sid", "tokens"), "sid")
    near = held.join(heads.select("block", "next"), "block")
    rows = near.select(
        F.explode(F.filter(F.array(F.struct(F.col("block").alias("task"), F.lit(True).alias("asks")), F.struct(F.col("next").alias("task"), F.lit(False).alias("asks"))), lambda x: x["task"].isNotNull())).alias("to"),
        F.col("rep").alias("label"), "tokens",
    ).select("to.*", "label", "tokens")
    found = stored(_search(rows, t), "links")
    label = stored(components(found), "block-components")

    labels = blocks.join(label, F.col("rep") == F.col("node"), "left").select("sid", "block", F.coalesce("label", "rep").alias("label"))
    labels = stored(labels, "labels")
    # A row per token and block, whatever the number of its sets: two blocks are open if they do not hold one and the same label.
    seen = prefixes.join(labels, "sid").groupBy("token", "block").agg(F.min("label").alias("l1"), F.max("label").alias("l2"))
    mixed = seen.groupBy("token").agg(F.min("l1").alias("m1"), F.max("l2").alias("m2"), F.min("block").alias("b1"), F.max("block").alias("b2")).where("m1 <> m2 and b1 <> b2").select("token")
    seen = stored(seen.join(stored(mixed, "mixed-tokens"), "token"), "mixed")
    x, y = seen.alias("x"), seen.alias("y")
    differ = F.least("x.l1", "y.l1") != F.greatest("x.l2", "y.l2")
    open_pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") < F.col("y.block")) & differ).select(F.col("x.block").alias("p"), F.col("y.block").alias("q")).distinct()
    p, q = heads.alias("p_head"), heads.alias("q_head")
    open_pairs = open_pairs.join(p, F.col("p") == F.col("p_head.block")).join(q, F.col("q") == F.col("q_head.block"))
    done = F.col("p_head.next").eqNullSafe(F.col("q")) | F.col("q_head.next").eqNullSafe(F.col("p"))
    fits = (F.col("p_head.low") * t.num <= F.col("q_head.high") * t.den) & (F.col("q_head.low") * t.num <= F.col("p_head.high") * t.den)
    open_pairs = stored(open_pairs.where(~done & fits).select("p", "q"), "block-pairs")
    sides = open_pairs.select(F.struct("p", "q").alias("task"), F.explode(F.array(F.struct(F.col("p").alias("block"), F.lit(False).alias("asks")), F.struct(F.col("q").alias("block"), F.lit(True).alias("asks")))).alias("to")).select("task", "to.*")
    rows = held.select("block", "sid", "tokens").join(labels.select("sid", "label"), "sid").join(sides, "block").select("task", "asks", "label", "tokens")
    more = _search(rows, t)
    return label, more


def grouped(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Texts link when ``den * intersection >= num * union`` of their shingle sets;
    ``component_id`` is the smallest doc_id reachable. Null, empty and blank texts have an
    empty set and link with nothing. Rows of one doc_id count as one document, so their
    texts are linked through it; a row whose doc_id is null links with nothing and has no
    component. An empty table gives an empty table. Other columns are ignored.
    """
    t = Threshold(num, den)
    sig = stored(signatures(docs, size), "signatures")
    named = sig.where("n > 0 and doc_id is not null")
    classes = stored(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = stored(_candidates(docs, classes, size, t), "chosen")
    within, between = links(docs, chosen, size, t)
    # Texts that share a doc_id are linked through it.
    several = stored(named.groupBy("doc_id").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y").select("doc_id"), "several")
    reps = named.select("doc_id", "f1", "f2", "n").join(several, "doc_id").join(classes, ["f1", "f2", "n"])
    through = reps.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    whole = within.select(F.col("node").alias("a"), "label")
    mapped = through.join(whole, "a", "left").select(F.coalesce("label", "a").alias("b_of_a"), "b")
    mapped = mapped.join(within, F.col("b") == F.col("node"), "left").select(F.col("b_of_a").alias("a"), F.coalesce("label", "b").alias("b"))
    across = stored(components(between.union(mapped)), "components")
    above = across.select(F.col("node").alias("label"), F.col("label").alias("top"))
    label = within.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")).union(across)
    final = stored(classes.select("f1", "f2", "n", "rep").join(label, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("label", "rep").alias("component_id")), "class-components")
    out = sig.select("doc_id", "n", "f1", "f2").join(final, ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The documents that are the first of their component, unchanged; a kept document keeps all its rows."""
    dropped = stored(grouped(docs, size, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "dropped")
    own, columns = set_aside(docs, ["_gone"])
    return own.join(dropped, F.col("doc_id") == F.col("_gone"), "left_anti").select(*columns)
