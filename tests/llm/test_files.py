"""Shards and archives: laws, pruning, round trips and damage."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from curalith.llm import sharding, warc
from tests.llm.fixtures import ODD, none, odd  # noqa: F401


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, n):
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(n))
    counts = [sizes.get(k, 0) for k in range(n)]
    assert max(counts) - min(counts) <= 1
    for k in range(n):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))


def test_shards_of_odd_rows(odd, none, tmp_path):
    placed = sharding.shards(odd, ["lang", "source", "n_chars", "size"], n=5)
    rows = placed.collect()
    check_shards(rows, 5)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    sharding.write_shards(odd, placed, str(tmp_path / "shards"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert Counter(r["doc_id"] for r in back.collect()) == Counter(r[0] for r in ODD)
    assert sharding.shards(none, ["lang"]).collect() == []


def test_shards_are_narrow_in_every_dimension(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text", "id * 7919 % 64 AS a", "id * 104729 % 61 AS b")
    placed = sharding.shards(docs, ["a", "b"], n=16).join(docs, "doc_id").groupBy("shard").agg({"a": "max", "b": "max"}).collect()
    low = sharding.shards(docs, ["a", "b"], n=16).join(docs, "doc_id").groupBy("shard").agg({"a": "min", "b": "min"}).collect()
    least = {r["shard"]: r for r in low}
    widths = [(r["max(a)"] - least[r["shard"]]["min(a)"], r["max(b)"] - least[r["shard"]]["min(b)"]) for r in placed]
    assert np.mean([w[0] for w in widths]) < 32 and np.mean([w[1] for w in widths]) < 32
    check_shards(sharding.shards(docs, ["a", "b"], n=16).collect(), 16)


PAGE = "<html>" + "é😀\r\n\r\nWARC/1.1\r\n" * 20
PAGES = [(1, "http://a/1", PAGE), (2, "http://a/2", PAGE), (2, "http://a/2", PAGE), (5, None, "short"), (4, "http://b", "short"), (6, "u\r\nX: y", None), (7, "", ""), (None, "http://n", PAGE), (8, "http://c", PAGE + "."), (3, "http://a/3", PAGE)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    index = warc.index(spark, path)
    rows = warc.read_records(index, with_payload=True).collect()
    assert len(rows) == len(PAGES)
    html = {i: h or "" for i, _, h in PAGES}
    for r in rows:
        body = html[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        again = r["page_id"] in (2, 3)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if again else ("response", None))
        assert r["payload"] == (None if again else body)
    some = warc.read_records(index.where("page_id in (8, 4)")).collect()
    assert sorted(r["page_id"] for r in some) == [4, 8]
    for file in (tmp_path / "warc").glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            _, _, _, length = warc.parse_record(data, at)
            assert data[at + length - 4 : at + length] == b"\r\n\r\n"
            at += length


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).collect() == []


def test_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "abc" * 50)], "page_id long, url string, html string").coalesce(1), path)
    index = warc.index(spark, path).collect()
    file = next(f for f in (tmp_path / "warc").glob("part-*") if f.stat().st_size)
    data = file.read_bytes()
    file.write_bytes(data.replace(b"abcabc", b"abcabd", 1))
    with pytest.raises(Exception, match="does not hold"):
        warc.read_records(spark.createDataFrame(index, warc.INDEX)).collect()
    with pytest.raises(ValueError):
        warc.parse_record(data[:-9])


def test_reads_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 10), (25, 5), (200, 50), (240, 10)], gap=5, most=100) == [(0, 30, 3), (200, 50, 2)]
    assert warc.coalesced([(0, 60), (60, 60), (120, 300)], gap=5, most=100) == [(0, 60, 1), (60, 60, 1), (120, 300, 1)]
    assert warc.coalesced([]) == []


def test_repeated_ids_with_other_payloads_and_clashing_columns(spark, none):
    """An id's rows are told apart by their payloads: none is multiplied or lost."""
    rows = [(1, PAGE), (2, PAGE), (5, PAGE), (5, PAGE + "own"), (6, PAGE), (6, PAGE + "own"), (6, PAGE + "last")]
    pages = spark.createDataFrame([(i, "u", h, "kept", 0, "gone") for i, h in rows], "page_id long, url string, html string, digest string, n int, refers_to string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr)
    digest = {h: hashlib.sha256(h.encode()).hexdigest() for _, h in rows}
    size = {h: len(h.encode()) for _, h in rows}
    first = {PAGE: 1, PAGE + "own": 5, PAGE + "last": 6}
    assert got == sorted(((i, size[h], digest[h], *(("revisit", first[h]) if first[h] != i else ("response", None))) for i, h in rows), key=repr)
    assert warc.round_trip(pages.limit(0)).collect() == []


def plain_hilbert(side):
    """Cells of a square in the curve's order, drawn quarter by quarter."""
    if side == 1:
        return [(0, 0)]
    half, quarter = side // 2, plain_hilbert(side // 2)
    return (
        [(y, x) for x, y in quarter]
        + [(x, y + half) for x, y in quarter]
        + [(x + half, y + half) for x, y in quarter]
        + [(side - 1 - y, half - 1 - x) for x, y in quarter]
    )


def test_the_curve_is_hilberts():
    """Equal to a recursive drawing up to the exchange of the axes; in three dimensions neighbours touch."""
    import numpy as np

    cells = np.array([(x, y) for x in range(16) for y in range(16)])
    order = [tuple(c) for c in cells[np.argsort(sharding.hilbert_index(cells, 4))].tolist()]
    assert order in (plain_hilbert(16), [(y, x) for x, y in plain_hilbert(16)])
    cube = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    along = cube[np.argsort(sharding.hilbert_index(cube, 3))]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_whole_texts_cut_a_dimension(spark):
    """Values that share their first bytes lie in cells of their own, in order of their bytes; fractions count."""
    rows = [(f"https://example.org/{k % 40:02d}", k / 10_000) for k in range(800)] + [(None, None), ("é", -0.5), ("", 2.5)]
    df = spark.createDataFrame(rows, "url string, x double")
    url, x = sharding.cuts(df, ["url", "x"], 4)
    assert len(url) >= 14 and url == sorted(url) and all(u in {r[0] for r in rows} for u in url)
    assert len(x) == 15 and x[0] < 0.01
    got = df.select("url", "x", sharding.curve(df, ["url", "x"], 4).alias("at")).collect()
    assert len({r["at"] for r in got}) > 60
    assert sharding.cuts(df.limit(0), ["url", "x"], 4) == [[], []]
