"""Projections and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.operators import enrich, project
from curalith.queries.registry import query, table


@query("SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand, lower(p_type) AS p_type, p_size, p_retailprice FROM part")
def case_lower(spark, sf_dir) -> DataFrame:
    return project.fold_case(table(spark, sf_dir, "part"), "lower")


@query("SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand, upper(p_type) AS p_type, p_size, p_retailprice FROM part")
def case_upper(spark, sf_dir) -> DataFrame:
    return project.fold_case(table(spark, sf_dir, "part"), "upper")


@query("SELECT * FROM part")
def case_keep(spark, sf_dir) -> DataFrame:
    return project.fold_case(table(spark, sf_dir, "part"), "keep")


@query("SELECT c_custkey AS customer_id, c_mktsegment AS label, c_nationkey, c_acctbal AS balance FROM customer")
def rename_fields(spark, sf_dir) -> DataFrame:
    """Two columns land on one name: the later one's values stay."""
    names = {"c_custkey": "customer_id", "c_name": "label", "c_mktsegment": "label", "c_acctbal": "balance", "c_fax": "fax"}
    return project.rename_fields(table(spark, sf_dir, "customer"), names)


ORDER_CONCEPTS = [
    {"source_key": "o_orderkey", "target_concept": "order_id"},
    {"source_key": "o_custkey", "target_concept": "customer_id"},
    {"source_key": "o_totalprice", "target_concept": "order_value"},
    {"source_key": "o_comment", "target_concept": "remark"},
    {"source_key": "o_orderstatus"},
]
CONTEXT = {"unit_system": "count", "frequency": "daily", "currency": None, "scale_factor": 1}


@query(
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS order_value, o_orderstatus AS _raw_o_orderstatus,
      CAST(o_orderdate AS VARCHAR) AS _raw_o_orderdate, o_orderpriority AS _raw_o_orderpriority,
      'count' AS unit_system, 'daily' AS frequency, CAST(NULL AS VARCHAR) AS currency, 1::INTEGER AS scale_factor FROM orders"""
)
def ontology_project(spark, sf_dir) -> DataFrame:
    projected = project.to_concepts(table(spark, sf_dir, "orders"), ORDER_CONCEPTS, CONTEXT)
    return projected.select(
        *[c for c in projected.columns if c != project.CONTEXT], f"{project.CONTEXT}.*"
    ).withColumn("_raw_o_orderdate", F.col("_raw_o_orderdate").cast("string"))


@query(
    """SELECT o_orderkey AS order_id, floor(o_totalprice / 1000)::BIGINT AS value_band, lower(o_orderpriority) AS priority,
      o_custkey AS _raw_o_custkey, o_orderstatus AS _raw_o_orderstatus FROM orders"""
)
def projection_expr(spark, sf_dir) -> DataFrame:
    mapping = [
        {"source_key": "o_orderkey", "target_concept": "order_id"},
        {"source_key": "o_totalprice", "target_concept": "value_band", "transformation": "floor(o_totalprice / 1000)"},
        {"source_key": "o_orderpriority", "target_concept": "priority", "transformation": "lower(o_orderpriority)"},
    ]
    return project.to_concepts(table(spark, sf_dir, "orders").drop("o_orderdate"), mapping)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def output_fields(spark, sf_dir) -> DataFrame:
    return project.output_fields(
        table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"], ["o_orderstatus", "__join__"]
    )


@query(
    """SELECT 'run-1' AS run_id, 'doc-1' AS doc_id, s_suppkey, s_name, s_nationkey, s_acctbal, 'python' AS engine, '1.0.0' AS spec_version
    FROM supplier"""
)
def envelope_rows(spark, sf_dir) -> DataFrame:
    rows = project.attach_envelope(
        table(spark, sf_dir, "supplier"), engine="python", spec_version="1.0.0", doc_id="doc-1", run_id="run-1"
    )
    return project.identity_first(rows)


@query(
    """SELECT o_orderkey, 'run-' || o_custkey AS curation_run_id,
      CASE WHEN c_custkey IS NOT NULL AND c_mktsegment <> 'BUILDING' THEN c_name ELSE 'doc-new' END AS doc_id
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
)
def inherit_parent(spark, sf_dir) -> DataFrame:
    parents = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("run_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("doc_id"),
    )
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("curation_run_id")
    )
    return project.inherit_parent(rows, parents, "doc-new")


@query(
    """SELECT n_nationkey, CASE WHEN r_name IS NULL OR r_name = n_name THEN n_name
      WHEN r_name = 'ASIA' THEN n_name ELSE n_name || ',' || r_name END AS doc_ids
    FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def distinct_documents(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    second = F.when(F.col("r_name") != "ASIA", F.col("r_name"))
    ids = project.distinct_documents(F.col("n_name"), second, F.col("n_name"))
    return nations.select("n_nationkey", F.array_join(ids, ",").alias("doc_ids"))


# -- enrichment -------------------------------------------------------------------------

# Nation names as customers spell them: right, in lower case, with a stray prefix, or not at all.
SPELLED = """CASE WHEN c_mktsegment = 'BUILDING' THEN lower('NATION_' || c_nationkey)
    WHEN c_mktsegment = 'MACHINERY' THEN 'THE NATION_' || c_nationkey
    WHEN c_mktsegment = 'FURNITURE' AND c_acctbal < 0 THEN NULL
    WHEN c_mktsegment = 'FURNITURE' AND c_acctbal < 500 THEN ''
    ELSE 'NATION_' || c_nationkey END"""
CODED = """SELECT c_custkey, nation, CASE WHEN r_name = 'AFRICA' THEN NULL ELSE code END AS nation_code FROM
    (SELECT c_custkey, """ + SPELLED + """ AS nation FROM customer) LEFT JOIN
    (SELECT n_name, r_name, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS code FROM nation JOIN region ON n_regionkey = r_regionkey)
    ON lower(nation) = lower(n_name)"""  # fmt: skip


def _coded(spark, sf_dir) -> DataFrame:
    """Customers with nation codes. Codes of one region are empty, which counts as none."""
    code = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    dim = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        F.col("n_name").alias("name"),
        F.when(F.col("r_name") == "AFRICA", "").otherwise(code).alias("code"),
        F.col("n_nationkey").alias("position"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.expr(SPELLED).alias("nation"))
    return enrich.enrich(customers, dim, "nation", "nation_code", order="position")


@query(CODED)
def enrich_exact_ci(spark, sf_dir) -> DataFrame:
    return _coded(spark, sf_dir)


@query(
    f"""SELECT count(nation_code)::BIGINT AS matched, count(*)::BIGINT AS total,
      count(*) FILTER (WHERE nation <> '' AND nation_code IS NULL)::BIGINT AS unmapped FROM ({CODED})"""
)
def enrich_stats(spark, sf_dir) -> DataFrame:
    return enrich.enrichment_stats(_coded(spark, sf_dir), "nation", "nation_code")


@query(
    f"""SELECT nation AS value, count(*)::BIGINT AS rows FROM ({CODED})
    WHERE nation <> '' AND nation_code IS NULL GROUP BY nation"""
)
def enrich_unmapped(spark, sf_dir) -> DataFrame:
    return enrich.unmapped_values(_coded(spark, sf_dir), "nation", "nation_code")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS brand FROM
      (SELECT l_orderkey, l_linenumber, l_partkey, 'part ' || l_partkey AS part_name FROM lineitem)
      LEFT JOIN (SELECT 'PART ' || p_partkey AS name, p_brand FROM part) ON lower(part_name) = lower(name)"""
)
def enrich_lines(spark, sf_dir) -> DataFrame:
    """Reference data that grows with the rows: part names in another case."""
    dim = table(spark, sf_dir, "part").select(
        F.concat(F.lit("PART "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("code")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("part_name")
    )
    return enrich.enrich(lines, dim, "part_name", "brand").drop("part_name")
