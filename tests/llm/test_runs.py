"""Periodic runs against brute force: every start and period, word by word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from curalith.llm import queries, runs
from tests.llm.fixtures import ODD, none, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, periods=4):
    """All maximal runs, found for each period from the words that equal the one a period before."""
    out = []
    for q in range(1, len(words) // periods + 1):
        start = 0
        while start + q < len(words):
            end = start + q
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            n = end - start
            smaller = any(all(words[start + i] == words[start + i - p] for i in range(p, n)) for p in range(1, q))
            if n >= max(least, periods * q) and not smaller:
                out.append((start, n, q))
            start = end - q + 1
    return sorted(out)


def collapsed(words, found):
    gone = {i for start, n, q in found for i in range(start + q, start + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def edited(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = edited(doc_id, text)
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines), digest(collapsed(words, found)))


def test_runs_of_small_alphabets():
    r = random.Random(1)
    for _ in range(1500):
        words = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randint(0, 40))]
        assert runs.runs_of(words) == brute(words)
        assert runs.runs_of(words, 2, 2) == brute(words, 2, 2)


def test_nested_and_touching_runs_after_the_sieve():
    """Runs within runs, side by side and at both ends, with prose between them and several texts at once."""
    r, texts = random.Random(2), []
    for _ in range(600):
        words = []
        while len(words) < 70:
            block = [r.choice("abc") for _ in range(r.randint(1, 5))]
            words += r.choice([block * r.randint(1, 7), [f"w{r.randrange(999)}" for _ in range(3)], (block * 4 + ["x"]) * 4])
        texts.append(r.choice([" ", "\n", " \t "]).join(words))
    counts, found, short = runs.found_in([t.encode() for t in ["", *texts, "a b "]])
    for text, n, own, left in zip(texts, counts[1:], found[1:], short.to_pylist()[1:]):
        words = text.split()
        assert (n, own, left) == (len(words), brute(words), collapsed(words, own))
    assert found[0] == found[-1] == [] and short.to_pylist()[-1] == "a b"


def test_cases_of_words_matter_and_other_blanks_do_not_part():
    _, found, left = runs.found_in(["Na na Na na Na na Na na".encode(), "é é é é é é é é é é é é".encode()])
    assert found == [[(0, 8, 2)], [(0, 6, 1)]] and left.to_pylist() == ["Na na", "é é"]


def test_long_periods_and_many_repeats():
    words = [str(i) for i in range(3000)] * 5 + ["end"] + ["z"] * 20_000
    _, found, left = runs.found_in([" ".join(words).encode()])
    assert found == [[(0, 15_000, 3000), (15_001, 20_000, 1)]]
    assert left.to_pylist()[0].split() == [str(i) for i in range(3000)] + ["end", "z"]


def test_odd_rows(spark, odd, none):
    docs = odd.withColumnsRenamed({"_text": "runs", "_words": "n_words", "_pii": "_run_text"})
    got = runs.periodic_runs(docs)
    assert got.columns == [c for c in docs.columns if c not in ("runs", "n_words")] + list(runs.ADDED)
    rows = got.collect()
    assert len(rows) == len(ODD) and {r["_run_text"] for r in rows} == {"kept"}
    by_text = {(i, t): WORD.findall(t or "") for i, t, *_ in ODD}
    assert sorted(r["n_words"] for r in rows) == sorted(len(by_text[(i, t)]) for i, t, *_ in ODD)
    assert runs.periodic_runs(none).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(None, None), (None, "a a a a a a a"), (7, None), (7, ""), (19, " \n"), (402, " ".join(f"w{i}" for i in range(500)) + " b c" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*row) for row in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
