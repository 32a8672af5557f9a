"""Main text of web pages by the consensus of each host's pages.

Every page scores its containers and names those that may be the article. Their generalised
paths (tags with classes and ids, numbers in them blanked, from the root down) are votes; a
host adds them up in Spark, each path once per different text, so what a site repeats on all
pages has one vote however long it is. Pages are then extracted anew from the containers at
their host's winning path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.llm.common import batch_of, releasing, set_aside, stored, text_chunks
from curalith.llm.pages import candidates, parse, text_of

#: A path needs so small a share of its host's votes to be one of its paths; so a host has no more than these.
MOST_PATHS = 32
_VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("digest", pa.int64()), ("weight", pa.int64())])


def host_of(url: Column) -> Column:
    """Lower-case host name; empty for null and for what is no absolute URL."""
    return F.coalesce(F.regexp_extract(F.lower(url.cast("string")), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, votes`` from ``host, html``; a vote's weight is the share of the page's text, in thousandths."""

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, "html"):
                hosts, rows = batch.column("host").slice(first, len(texts)).to_pylist(), []
                for host, text in zip(hosts, texts):
                    page = parse(text)
                    for node, share in candidates(page):
                        digest = hashlib.blake2b(text_of(page, [node]).encode("utf-8", "replace"), digest_size=8).digest()
                        rows.append((host, page.path[node], int.from_bytes(digest, "little", signed=True), int(1000 * share)))
                yield batch_of(_VOTES, *(zip(*rows) if rows else ((),) * 4))

    each = pages.select("host", F.col("html").cast("string").alias("html")).mapInArrow(work, "host string, path string, digest long, weight long")
    return each.groupBy("host", "path", "digest").agg(F.max("weight").alias("weight")).groupBy("host", "path").agg(F.sum("weight").alias("votes"))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, paths``: each host's paths of at least ``1 / MOST_PATHS`` of its votes, most votes first."""
    each = stored(votes(pages), "votes")
    totals = each.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = each.join(totals, "host").where(F.col("votes") * MOST_PATHS >= F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), F.col("path"))))
    return stored(kept.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths")), "host-paths")


def extracted(text: str, paths: list[str]) -> str:
    """Main text of a page: its containers at the first of the paths that it has any text at, or its own best one."""
    page = parse(text)
    at: dict[str, list[int]] = {}
    for n, path in enumerate(page.path):
        at.setdefault(path, []).append(n)
    for path in paths:
        found = text_of(page, at.get(path, []))
        if found:
            return found
    own = candidates(page)
    return text_of(page, [own[0][0]]) if own else ""


def with_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (``url``, ``html``) with ``main_text``; a column of that name is replaced.

    Null, empty and textless pages have an empty text. Pages without a host (a null URL, or
    no absolute one) vote as one host. Repeated pages vote once and each get their text; a
    host of one page follows that page's own best container; an empty table gives an empty
    table. Of equal votes the lesser path wins. Whole pages are read, however long. Hosts'
    paths are joined to the pages as Spark sees fit by their stored size, and pages are not
    shuffled where it broadcasts them.
    """
    own, back = set_aside(pages, ["_host", "_paths", "_html", "main_text", "host", "paths"])
    own = own.withColumns({"_host": host_of(F.col("url")), "_html": F.col("html").cast("string")})
    paths = host_paths(own.select(F.col("_host").alias("host"), F.col("_html").alias("html")))
    joined = own.join(paths, F.col("_host") == F.col("host"), "left").drop("host", "_host")
    kept = [c for c in joined.columns if c not in ("_html", "paths")]
    schema = joined.select(*kept).schema.add("main_text", "string")

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, "_html"):
                paths = batch.column("paths").slice(first, len(texts)).to_pylist()
                found = [extracted(t, p or []).encode("utf-8", "replace").decode() for t, p in zip(texts, paths)]
                columns = [batch.column(c).slice(first, len(texts)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], names=[*kept, "main_text"])

    out = joined.mapInArrow(work, schema)
    return out.select(*(b for c, b in zip(pages.columns, back) if c.lower() != "main_text"), "main_text")
