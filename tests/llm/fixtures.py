"""Rows and fixtures that the tests of this folder share; a second conftest would hide the first."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
#: Null, empty and blank texts, a very long one, ties, a repeated row, null ids and languages.
ODD = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a"),
    (2, "The cat sat on the mat and looked at the dog.", "en", "a"),
    (2, "The cat sat on the mat and looked at the dog.", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \n\n \t ", "de", "b"),
    (6, LONG, None, None),
    (7, "Zürich 😀 naïve — ÉTÉ\r\nİstanbul Σίσυφος", "fr", "c"),
    (8, "12 34 !!! ???", "fr", "c"),
    (None, "The cat sat on the mat and looked at the dog.", None, "a"),
    (None, None, None, None),
    (9, "one", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with further columns whose names the operators use themselves."""
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in ODD]
    clash = ["_score", "_pii", "_words", "_text", "part", "lent", "label", "token", "rank", "curve", "tokens", "_gone", "page_id"]
    return spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit("kept") for c in clash})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
