"""The registered queries of this subpackage and their equivalent SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm import decontaminate, html_text, jaccard, langid, merkle, packing, pii, quality, runs, search, sharding, token_files, warc
from curalith.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(read_table(spark, sf_dir, "documents"), _tokenizer(), end_id=1)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), _tokenizer(), capacity=2048, end_id=0)


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words of documents and items; windows of items; every place of a document where one begins.
_OP7_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS body
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS body
  FROM dw, (SELECT DISTINCT size FROM windows) z, unnest(range(1, len(w) - size + 2)) t(i)),
found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, body)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM found, unnest(range(0, size)) t(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op7_decontaminate", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), size=10)


#: Sets of shingles, every pair that shares one, and the closure of the links.
_OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS node, doc_id AS at FROM w UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.at)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.at)::BIGINT AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""


@query("op6_jaccard_join", _OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.grouped(read_table(spark, sf_dir, "documents"), size=4, num=85, den=100)


@query("op3_merkle_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared(read_table(spark, sf_dir, "documents"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(read_table(spark, sf_dir, "documents"))


@query("op5_pii_spans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op8_warc", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


@query("op9_hilbert_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read_table(spark, sf_dir, "documents"), dims=["lang", "source", "size"], n=16)


#: Counts of every term in every document, joined with the items' own.
_OP11_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(w) AS t FROM iw) GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM dw WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM dw) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, totals),
scores AS (
  SELECT item_id, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN weights USING (t), totals GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


@query("op11_lexical_search", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


#: The tables' pages have their article in an ``article`` element, and no references but these.
_OP12_SQL = r"""
WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS b FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(b, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS b FROM body),
plain AS (SELECT page_id, url, replace(replace(replace(b, '&quot;', '"'), '&copy;', '©'), '&middot;', '·') AS b FROM bare),
done AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(b, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM done
"""


@query("op12_html_text", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.with_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op13_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; in one document of ten, by its id, the words from some place on repeat."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1).cast("long"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("_w").cast("long")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    held = held.withColumn("_g", F.expr("_h div 10")).withColumn("_a", F.when(n > 0, F.col("_g") % n))
    held = held.withColumn("_p", 1 + F.expr("(size(_w) - _a) div (3 + _g % 8)"))
    tail = F.expr("transform(sequence(_a, cast(size(_w) - 1 as bigint)), i -> _w[cast(_a + (i - _a) % _p as int)])")
    edited = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return held.select("doc_id", F.when(F.col("_a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(op13_texts(read_table(spark, sf_dir, "documents")))
    # Runs come by start and period, so of equal exponents the first stays.
    none = "cast(null as struct<start:bigint,length:bigint,period:bigint>)"
    best = F.expr(f"aggregate(runs, {none}, (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
