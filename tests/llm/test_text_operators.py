"""Decontamination, personal data and fingerprints against brute force on odd and random texts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from curalith.llm import decontaminate, merkle, pii
from tests.llm.fixtures import ODD, none, odd  # noqa: F401

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def windows(text, size):
    own = words(text)
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def contaminated(docs, items, size=10):
    out = []
    for name, text in docs:
        own, hit, met = words(text), set(), set()
        for item, body in items:
            for w in windows(body, size):
                for i in range(len(own) - len(w) + 1):
                    if tuple(own[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        met.add(str(item) if item is not None else "null")
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((name, len(own), len(hit), len(met), digest, bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "cat sat on the mat"), (2, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13 w14x14 w15x15 w16x16"), (11, None), (3, ""), (3, "ONE"), (4, "été istanbul"), (None, "12"), (1, "cat sat on the mat")]


def test_windows_in_odd_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.report(odd, items).collect()
    assert sorted((tuple(r) for r in got), key=repr) == contaminated([r[:2] for r in ODD], ITEMS)
    assert decontaminate.report(none, items).collect() == []
    assert {r["n_hit"] for r in decontaminate.report(odd, items.limit(0)).collect()} == {0}
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0, r["_words"], r["_text"]) for r in kept.collect()) == [(i, "kept", "kept") for i in (0, 3, 4, 5, 7)]


@pytest.mark.parametrize("block_bytes", [16_000_000, 200])
def test_windows_in_random_texts(spark, block_bytes):
    """A small vocabulary makes repeated words, overlapping windows and windows of several items."""
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(30)]
    items = [(i, text(r.randint(0, 9))) for i in range(20)]
    found = decontaminate.marked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, block_bytes)
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"])
    got = found.select("doc_id", "_words", n_hit, F.size("_items"), F.sha2(F.array_join("_items", ","), 256), n_hit > 0).collect()
    assert sorted((tuple(x) for x in got), key=repr) == contaminated(docs, items, 5)


def luhn(digits):
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m[0]))
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in found]


PERSONAL = [
    "mail 😀 a.b@c.de, x@y@z.org and %q@w.x.y._r@s.t 1.2.3.4.5 256.1.1.1 001.02.3.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004+49 (30) 123-4567 +1 +12 3",
    "pay to DE89 3704 0044 0532 0130 00 or DE88370400440532013000; ssn 078-05-1120, part 123-45-6789",
    "1111@x.com 4111 1111 1111 1111@x.com",
    "9" * 20_000 + "." + "1 " * 20_000 + "a" * 50_000 + "@" + "+1" * 10_000,
    "a@b.c-d.e@f.g..h@i.j 1.2.3.4.5.6.7.8 1..2.3.4",
]


def test_personal_data(spark, odd, none):
    r = random.Random(7)
    noise = ["".join(r.choice("1234 .-+@a()é😀") for _ in range(r.randint(0, 80))) for _ in range(200)]
    texts = PERSONAL + noise + [t for _, t, *_ in ODD]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = base_spans(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[row["doc_id"]][:200]
        assert [row[f"n_{k}"] for k, _, _ in BASE] == [sum(s.startswith(k) for s in want) for k, _, _ in BASE]
        assert set(want) <= set(row["spans"].split(","))
    added = {s for row in rows for s in row["spans"].split(",") if s.startswith(("iban", "ssn"))}
    assert "iban:7:34" in added and not any(s.startswith("iban:38") for s in added)
    assert "ssn:66:77" in added or any(s.startswith("ssn") for s in added)
    assert pii.report(odd).count() == len(ODD) and pii.report(none).collect() == []


def test_zeros_in_addresses(spark):
    r = random.Random(8)
    texts = ["at 10.0.0.1, 192.168.0.1 127.0.0.1", "0.0.0.0 00.000.0.00 0.256.0.0 1.0.0256.1 010.0100.00255.09", "10.0.0.1.0.0.0.0 0..0.0.0 0.0.0"]
    texts += ["".join(r.choice("0012 ..25") for _ in range(r.randint(0, 60))) for _ in range(200)]
    rows = {row["doc_id"]: row for row in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i]["n_ip"] for i in range(3)] == [3, 3, 2]
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert rows[i]["n_ip"] == sum(s.startswith("ip") for s in want), text
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
    docs = spark.createDataFrame([(1, "from 10.0.0.1!", 14)], "doc_id long, text string, n_chars long")
    assert pii.redacted(docs).first()["text"] == "from [IP]!"


def test_redaction(spark, odd):
    texts = ["to a@b.cd now", "4111 1111 1111 1111@x.com!", "nothing", None, "x 1.2.3.4 y +49 30 1234567 z"]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redacted(docs).collect()}
    want = ["to [EMAIL] now", "[CARD]!", "nothing", None, "x [IP] y [PHONE] z"]
    assert got == {i: (t, None if t is None else len(t)) for i, t in enumerate(want)}
    again = pii.redacted(odd)
    assert again.schema.names == odd.schema.names and again.count() == odd.count()


def test_no_python_in_the_plan(odd):
    plan = pii.report(odd)._jdf.queryExecution().toString() + pii.redacted(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints(spark, odd, none):
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t, *_ in rows]
    want = []
    for k, text in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        want.append((rows[k][0], len(text), hashlib.sha256(changed.encode()).hexdigest(), merkle.tree(text).root, merkle.tree(changed).root))
    got = merkle.compared(odd).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) >= (r["fingerprint"] == r["edited_fingerprint"])
    assert merkle.compared(none).collect() == []
    one = merkle.compared(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1


def test_documents_follow_each_other_over_many_parts(spark, monkeypatch):
    r = random.Random(1)
    ids = r.sample(range(10_000), 400)
    docs = [(i, " ".join(r.choice("abcdef") * 3 for _ in range(r.randint(0, 50)))) for i in ids]
    monkeypatch.setattr(merkle, "CHUNK_CHARS", 500)
    got = {x["doc_id"]: x for x in merkle.compared(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()}
    order = sorted(docs)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        assert got[i]["edited_sha256"] == hashlib.sha256(merkle.edited(text, following).encode()).hexdigest()


def test_differing_branches_locate_an_edit():
    lines = [" ".join(f"{k}word{i}" for i in range(40)) for k in range(30)]
    old, text = merkle.tree("\n".join(lines)), "\n".join(lines)
    place = text.index("17word20")
    new = merkle.tree(text.replace("17word20", "edited"))
    ranges = merkle.differing(old, new)
    assert len(ranges) == 1 and ranges[0][0] <= place < ranges[0][1]
    assert sum(a != b for a, b in zip(old.paragraphs, new.paragraphs)) == 1
    assert merkle.differing(old, merkle.tree(text)) == []


def test_an_added_or_deleted_word_changes_only_its_leaf():
    """Borders of leaves follow from the words at them, however long the paragraph."""
    own = [f"w{i}" for i in range(400)]
    old = " ".join(own)
    for new in (" ".join(["extra", *own]), " ".join(own[:200] + own[201:]), old + " more"):
        a, b = (merkle.leaves_of([t.encode()]) for t in (old, new))
        assert merkle.likeness(a, b, [(0, 0)])[0] > 0.9
        changed = merkle.differing(merkle.tree(old), merkle.tree(new))
        assert len(changed) <= 2 and (changed == [] or changed[0][1] - changed[0][0] < 400)
