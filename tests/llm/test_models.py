"""The perplexity model and the language model: against plain loops, and held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalith.llm import langid, quality
from tests.llm.fixtures import ODD, none, odd  # noqa: F401

SF_DIR = "/root/testdata/sf0.01"


def plain_probabilities(texts, letters):
    """Interpolated modified Kneser-Ney, straight from the formulas, as a function of a gram."""
    order, symbols = quality.ORDER, quality.SYMBOLS
    counts = Counter()
    for t in texts:
        s = [0] * (order - 1) + [int(letters[ord(c)]) for c in t]
        counts.update(tuple(s[i : i + order]) for i in range(len(t)))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discount = {}
    for k, level in levels.items():
        n = Counter(level.values())
        if not (n[1] and n[2] and n[3]):
            discount[k] = [0.5, 0.75, 0.9]
        else:
            y = n[1] / (n[1] + 2 * n[2])
            found = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            discount[k] = [min(max(d, 0.1), i - 0.1) for i, d in enumerate(found, 1)]

    def p(gram):
        if not gram:
            return 1 / symbols
        k = len(gram)
        own = {g: n for g, n in levels[k].items() if g[:-1] == gram[:-1]}
        below = p(gram[1:])
        if not own:
            return below
        total = sum(own.values())
        d = discount[k]
        back = sum(d[min(n, 3) - 1] for n in own.values()) / total
        n = own.get(gram, 0)
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / total + back * below

    return p


def test_probabilities_are_those_of_the_formulas(spark):
    texts = ["the cat sat. the cat ate the rat", "a rat sat at the mat: 12 Rats", "", "that hat, that cat", "eee"]
    model = quality.fit(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"))
    p = plain_probabilities(texts, model.letters)
    for text in ["the rat", "that cat!", "Zzz 9", "ß", "x" * 50]:
        s = [0] * (quality.ORDER - 1) + [int(model.letters[ord(c)]) for c in text]
        want = -sum(math.log(p(tuple(s[i : i + quality.ORDER]))) for i in range(len(text))) / len(text)
        assert model.log_perplexity([text])[0] == pytest.approx(want, rel=2e-3)
    assert np.isnan(model.log_perplexity([""])[0])
    context = [int(model.letters[ord(c)]) for c in "the"]
    assert sum(p((*context, c)) for c in range(quality.SYMBOLS)) == pytest.approx(1)


def test_scores_do_not_depend_on_neighbours(spark):
    model = quality.fit(spark.createDataFrame([("some plain text of words",)], "text string"))
    texts = ["some", "", "plain text", "", "words of text", "x"]
    together = model.log_perplexity(texts)
    assert np.allclose(together, [model.log_perplexity([t])[0] for t in texts], equal_nan=True)


def test_good_text_stays_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs, labels).join(labels, "doc_id").toPandas()
    assert rows[(rows.quality == 1) & (rows.toxic == 0)].kept.mean() > 0.99
    assert rows[rows.quality == 0].kept.mean() < 0.35
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in quality.judged(docs, labels).where("kept").collect()}


def test_repeated_words_go_and_few_short_texts_set_no_limit(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs, labels).join(labels, "doc_id").toPandas()
    assert rows[rows.quality == 0].kept.mean() < 0.08
    scores = [(i, "a", 1.5 + 0.001 * (i % 50), 1000) for i in range(300)] + [(300, "a", 2.8, 3), (301, "b", 1.6, 1000), (302, "c", 1.6, 1000)]
    own = spark.createDataFrame(scores, "doc_id long, lang string, _score double, _length int")
    known = spark.createDataFrame([(i, 1, 0) for i in range(302)], "doc_id long, quality int, toxic int")
    found = {r["lang"]: r for r in quality.limits(own, known).collect()}
    assert found["a"]["median"] + found["a"]["reach"] < 1.7
    assert all(found[k]["median"] + found[k]["reach"] < 1.7 for k in "bc")


def test_toxic_text_goes(spark):
    r = random.Random(5)
    plain = [" ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", "and", "ate"]) for _ in range(40)) for _ in range(120)]
    rows = [(i, f"{t} Vile, {t}" if i % 4 == 0 else t, "en") for i, t in enumerate(plain)]
    docs = spark.createDataFrame([*rows, (900, plain[1] + " VILE!", "en"), (901, plain[2] + " evil", "en"), (902, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"]: x["kept"] for x in quality.judged(docs, labels).collect()}
    assert not any(kept[i] for i in range(0, 120, 4)) and not kept[900] and kept[902]
    assert set(quality.fit_toxic(quality.labelled(docs, labels)).words) == {"vile"}
    assert {x["doc_id"] for x in quality.good(docs, labels).select("doc_id").collect()} == {i for i, k in kept.items() if k}
    assert sum(kept[i] for i in range(120) if i % 4) >= 88


def test_all_trusted_documents_train(spark, monkeypatch):
    rows = spark.range(20_400).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"))
    labels = rows.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 100 == 0).cast("int").alias("toxic"))
    monkeypatch.setattr(quality, "fit", lambda texts: texts.count())
    assert quality.fit_trusted(quality.labelled(rows, labels)) == 20_196


def test_judging_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (7, 0, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judged(odd, labels).collect()
    assert len(rows) == len(ODD)
    assert {r["doc_id"] for r in rows if r["perplexity"] is None} == {None, 3, 4}
    assert all(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4))
    assert quality.good(odd, labels).columns == odd.columns
    assert all(r["kept"] for r in quality.judged(odd, labels.limit(0)).collect())
    assert quality.judged(none, labels).collect() == [] and quality.good(none, labels.limit(0)).collect() == []


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 250 and (held.lang == held.lang_pred).mean() > 0.98
    assert rows.score.between(0, 1).all()


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("n_chars > 500")
    model = langid.fit(docs.select("text", "lang"))
    part = {r["lang"]: r["text"][:300].rsplit(" ", 1)[0] for r in docs.where("lang in ('de', 'es')").orderBy("doc_id").collect()}
    text = part["de"] + "\n" + part["es"]
    names, share, spans = model.predict([text])
    assert [s["lang"] for s in spans[0]] == ["de", "es"]
    assert abs(spans[0][1]["start"] - len(part["de"])) < 30 and 0.3 < share[0] < 0.7


def best_path(scores, prior, penalty):
    """Every path of a short text."""
    n, k = scores.shape
    value = lambda p: prior[p[0]] + sum(scores[i, p[i]] for i in range(n)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(map(value, itertools.product(range(k), repeat=n)))


def test_viterbi_against_all_paths():
    r = np.random.default_rng(2)
    for _ in range(30):
        sizes = r.integers(0, 7, 5)
        first = np.cumsum([0, *sizes])
        scores = r.normal(0, 3, (first[-1], 3))
        model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), np.log([0.5, 0.3, 0.2]), 2.0)
        path = model._viterbi(scores, first) if len(scores) else np.empty(0, int)
        for a, b in zip(first, first[1:]):
            if b > a:
                own = path[a:b]
                got = model.prior[own[0]] + scores[np.arange(a, b), own].sum() - 2.0 * (own[1:] != own[:-1]).sum()
                assert got == pytest.approx(best_path(scores[a:b], model.prior, 2.0))


def test_scripts_narrow_candidates(spark):
    rows = [("the cat sat on a mat", "en"), ("кошка сидит на окне", "ru"), ("der Hund und die Katze", "de")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    names, share, _ = model.predict(["кошка", "cat", "猫が好き cat", "12 !", ""])
    assert names == ["ru", "en", "en", "und", "und"] and share.tolist()[3:] == [0, 0]


def test_languages_of_odd_rows(odd, none):
    rows = langid.identified(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {None, 3, 4, 5, 8} and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert all(r["held_out"] is not None for r in rows)
    assert langid.identified(none).collect() == []
    assert {r["lang_pred"] for r in langid.predicted(odd, langid.fit(odd.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def path_value(scores, prior, penalty, path):
    return prior[path[0]] + scores[np.arange(len(path)), path].sum() - penalty * np.count_nonzero(path[1:] != path[:-1])


def best_value(scores, prior, penalty):
    """Value of the best path, word by word over all pairs of languages."""
    value = prior + scores[0]
    cost = penalty * (1 - np.eye(len(prior)))
    for row in scores[1:]:
        value = (value[:, None] - cost).max(axis=0) + row
    return value.max()


def test_viterbi_at_the_queries_penalty_and_over_pieces():
    """Texts of one word up to several pieces, side by side; and a change between two words that prefer a third language."""
    r = np.random.default_rng(5)
    for penalty, scale in ((20.0, 3.0), (20.0, 30.0), (0.5, 1.0)):
        sizes = [1, 3, 0, langid.PIECE_WORDS, langid.PIECE_WORDS + 1, 5 * langid.PIECE_WORDS - 7, 2, 2 * langid.PIECE_WORDS, 700]
        scores = r.normal(0, scale, (sum(sizes), 4)) + np.repeat(r.normal(0, scale, (sum(sizes) // 10 + 1, 4)), 10, axis=0)[: sum(sizes)]
        first = np.cumsum([0, *sizes])
        model = langid.Model(list("abcd"), None, None, r.normal(0, 2, 4), penalty)
        path = model._viterbi(scores, first)
        for a, b in zip(first, first[1:]):
            if b > a:
                assert path_value(scores[a:b], model.prior, penalty, path[a:b]) == pytest.approx(best_value(scores[a:b], model.prior, penalty))
    scores = np.array([[-9.0, 0, -9]] * 10 + [[0.0, -1, -3], [0, -3, -1]] + [[-9.0, -9, 0]] * 10)
    model = langid.Model(list("lab"), None, None, np.zeros(3), 20.0)
    path = model._viterbi(scores, np.array([0, len(scores)]))
    assert path_value(scores, model.prior, 20.0, path) == -22 and path[10] != path[11]


def test_characters_that_share_a_symbol_are_told_apart():
    """Beyond the most frequent characters, too: each symbol's characters share its probability."""
    chars = {ord(c): 1000 - i for i, c in enumerate(map(chr, range(0x4E00, 0x4E00 + 300)))} | {ord("%"): 3, ord("7"): 9}
    letters = quality.alphabet(chars)
    table = quality.spellings(chars, letters)
    rare, rarer, unmet = 0x4E00 + 100, 0x4E00 + 299, 0x4E00 + 500
    assert {letters[c] for c in (rare, rarer, unmet)} == {quality.LETTER}
    assert table[rare] > table[rarer] > table[unmet]
    assert table[0x4E00] == table[ord("7")] == table[-1] == 0
    for symbol in (quality.LETTER, quality.OTHER):
        met = [c for c in chars if letters[c] == symbol]
        assert np.exp(table[met].astype(float)).sum() + len(met) * quality.UNSEEN / sum(chars[c] for c in met) == pytest.approx(1, abs=1e-4)
    few = {c: 5 for c in map(ord, "abc")}
    assert not quality.spellings(few, quality.alphabet(few)).any()


def test_a_text_of_unmet_characters_scores_worse(spark):
    """Trusted texts of many letters: the same letters in the same order against letters that no trusted text has."""
    own = [chr(0x4E00 + i % 300) for i in range(3000)]
    model = quality.fit(spark.createDataFrame([("".join(own),)], "text string"))
    known, unmet = "".join(own[100:160]), "".join(chr(0x4E00 + 1000 + i) for i in range(100, 160))
    assert (model.letters[[ord(c) for c in known]] == quality.LETTER).all() and (model.letters[[ord(c) for c in unmet]] == quality.LETTER).all()
    assert model.log_perplexity([unmet])[0] > model.log_perplexity([known])[0] + 1


def test_every_character_of_the_trusted_text_is_a_symbol_of_its_own(spark, monkeypatch):
    """More characters than the alphabet has: against the formulas, in the model and over a table."""
    r = random.Random(3)
    own = [chr(0x4E00 + i) for i in range(120)] + [*"ab c", "😀"]
    texts = ["".join(own[min(len(own) - 1, k % 90 + r.randrange(4) * 11)] for k in range(n, n + 60)) for n in range(40)]
    texts[0] += "😀ab😀 cab"
    model = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    symbols, met = model.dense.symbols, {ord(c) for t in texts for c in t}
    assert len(met) > quality.SYMBOLS and len(set(symbols[list(met)])) == len(met) and model.dense.size == symbols.max() + 1
    with monkeypatch.context() as m:
        m.setattr(quality, "SYMBOLS", model.dense.size)
        p = plain_probabilities(texts, symbols)
    asked = [texts[3], texts[7][::-1], "cab😀 ", own[80] + own[3] + own[95] + own[2] * 4, "ab", ""]
    for text, got in zip(asked, model.log_perplexity(asked)):
        s = [0] * (quality.ORDER - 1) + [int(symbols[ord(c)]) for c in text]
        want = -sum(math.log(p(tuple(s[i : i + quality.ORDER]))) for i in range(len(text))) / len(text) if text else math.nan
        assert got == pytest.approx(want, rel=2e-3, nan_ok=True)
    docs = spark.createDataFrame([*enumerate([*asked, asked[0], None])], "doc_id long, text string").repartition(3)
    rows = {x["doc_id"]: x["_score"] for x in quality.scored(docs, model, quality.Toxicity({}, 0.0)).collect()}
    assert [rows[i] for i in range(5)] == pytest.approx(model.log_perplexity(asked)[:5].tolist(), rel=1e-6)
    assert rows[5] is None and rows[6] == rows[0] and rows[7] is None


def test_kinds_of_characters_are_known_in_all_planes():
    table = quality.alphabet({})
    assert [table[ord(c)] for c in "é😀𝟘𠀀𐍈٣!"] == [quality.LETTER, quality.OTHER, quality.DIGIT, quality.LETTER, quality.LETTER, quality.DIGIT, quality.OTHER]


def test_equal_texts_of_other_languages_are_judged_by_their_own(spark):
    """`good` finds rejected texts by language and content, and keeps rows without either."""
    r = random.Random(1)
    words = lambda ws: " ".join(r.choice(ws) for _ in range(60))
    rows = [(i, words(["the", "cat", "sat", "here"]), "en") for i in range(80)] + [(100 + i, words(["ÀÉ", "ñÕ", "ŵý", "ȘȚ"]), None) for i in range(80)]
    rows += [(200, "zq xj ÿ# kv " * 9, "en"), (201, rows[90][1], "en"), (202, None, None), (203, "", "en"), (204, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows[:160]], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"] for x in quality.judged(docs, labels).where("kept").collect()}
    assert {x["doc_id"] for x in quality.good(docs, labels).collect()} == kept
    assert 200 not in kept and {202, 203, 204} <= kept
