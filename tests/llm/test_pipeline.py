"""The registered queries against their SQL, and the pipeline against its stages done plainly."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from curalith.llm import langid, quality, queries
from curalith.llm.common import stored
from curalith.llm.tokens import WordTokenizer
from tests.llm.fixtures import ODD, none, odd, tokenizer_path  # noqa: F401
from tests.llm.test_jaccard import brute
from tests.llm.test_text_operators import base_spans, contaminated
from tests.llm.test_tokens import check_packing

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    answer = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    want = [tuple(row[names.index(c)] for c in columns) for row in answer.fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_give_a_row_per_document(spark, name):
    rows = queries.QUERIES[name](spark, SF_DIR).select("doc_id").distinct().count()
    assert rows == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]


def test_each_stage_does_its_part(spark, tokenizer_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    kept, seen = docs, [rows(docs)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, SF_DIR), "stage")
        assert kept.columns == docs.columns
        seen.append(rows(kept))
    want = {r["doc_id"] for r in quality.judged(docs, labels).where("kept").collect()}
    assert set(seen[1]) == want
    groups = brute(sorted(seen[1].items()), 5, 80, 100)
    assert set(seen[2]) == {name for name, _, label in groups if name == label}
    hit = {name for name, *_, bad in contaminated(sorted(seen[2].items()), [(r["item_id"], r["text"]) for r in items.collect()]) if bad}
    assert hit and set(seen[3]) == set(seen[2]) - hit
    assert set(seen[4]) == set(seen[3])
    for name, text in seen[3].items():
        assert not base_spans(seen[4][name])
        assert seen[4][name] == text or base_spans(text) or "[IBAN]" in seen[4][name] or "[SSN]" in seen[4][name]
    coder = WordTokenizer(tokenizer_path)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR).collect()
    total = sum(len(coder.library.encode(t or "", add_special_tokens=False).ids) + 1 for t in seen[4].values())
    assert sum(r["length"] for r in pieces) == total
    used = check_packing(pieces, 2048)
    assert np.ceil(total / 2048) <= used <= 1.05 * total / 2048 + 1
    final = {(r["doc_id"], r["piece"], r["length"]) for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert final == {(r["doc_id"], r["piece"], r["length"]) for r in pieces}


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for docs, n in ((odd, len(ODD)), (none, 0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, SF_DIR), "odd")
            assert out.count() <= n + 200 and (n > 0) == (out.count() > 0)


def test_a_model_is_learned_from_training_rows_only(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 'xx' ELSE lang END AS lang")
    assert {r["lang_pred"] for r in langid.identified(changed).collect()} <= {r["lang"] for r in docs.select("lang").collect()} | {"und"}
