"""The run ledger over driver tables: folds, latest and first rows, sequences, versions, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.operators import ledger, lineage, versions
from curalith.operators.prefix import sequence_numbers
from curalith.queries.registry import query, table


@query(
    """SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS event_type,
      arg_max(CASE WHEN value > 20 THEN props END, (ts, event_id)) FILTER (WHERE value > 20) AS props,
      CAST(min(ts) AS VARCHAR) AS created_at, CAST(max(ts) AS VARCHAR) AS updated_at FROM events GROUP BY user_id"""
)
def status_fold(spark, sf_dir) -> DataFrame:
    """Events as updates of a run per user; small events leave ``props`` as it was."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"), "event_type",
        F.when(F.col("value") > 20, F.col("props")).alias("props"),
    )
    folded = ledger.fold_runs(events)
    return folded.withColumns({c: F.col(c).cast("string") for c in ("created_at", "updated_at")})


@query(
    """SELECT user_id AS run_id,
      CAST(max(ts) FILTER (WHERE event_type = 'signup') AS VARCHAR) AS signup_at,
      CAST(max(ts) FILTER (WHERE event_type = 'purchase') AS VARCHAR) AS purchase_at,
      CAST(max(ts) FILTER (WHERE event_type = 'error') AS VARCHAR) AS error_at FROM events GROUP BY user_id"""
)
def status_times(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id")
    times = ledger.status_times(events, status="event_type", statuses=("signup", "purchase", "error"))
    return times.withColumns({c: F.col(c).cast("string") for c in times.columns if c != "run_id"})


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""
)
def latest_per_key(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    latest = ledger.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return latest.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(
    """SELECT o_orderpriority AS spec_id, o_orderkey AS run_id, CAST(o_orderdate AS VARCHAR) AS created_at FROM
      (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders
       WHERE contains(o_orderpriority, 'E')) WHERE rn = 1"""
)
def latest_bind(spark, sf_dir) -> DataFrame:
    """Newest fact per spec whose id contains a text."""
    facts = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("spec_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at")
    )
    bound = ledger.latest_per_key(ledger.matching_runs(facts, contains="E"), ["spec_id"], ["created_at", "run_id"])
    return bound.withColumn("created_at", F.col("created_at").cast("string"))


RUNS_SQL = """SELECT event_id AS run_id, 'user ' || user_id AS spec_id, CASE WHEN value < 20 THEN '1.0.0' ELSE '1.1.0' END AS spec_version,
      CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' ELSE 'STARTED' END AS status,
      CASE WHEN event_type = 'view' THEN 'semantics' WHEN event_type = 'click' THEN 'semantic' ELSE 'curation' END AS layer,
      CASE WHEN value < 3 THEN true WHEN value < 10 THEN false END AS replay_mode, ts AS created_at FROM events"""


def _runs(spark, sf_dir) -> DataFrame:
    """Events read as one run each, in the shape of the folded ledger."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("spec_id"),
        F.when(value < 20, "1.0.0").otherwise("1.1.0").alias("spec_version"),
        F.when(kind == "purchase", "SUCCESS").when(kind == "error", "FAILURE").otherwise("STARTED").alias("status"),
        F.when(kind == "view", "semantics").when(kind == "click", "semantic").otherwise("curation").alias("layer"),
        F.when(value < 3, True).when(value < 10, False).alias("replay_mode"),
        F.col("ts").alias("created_at"),
    )


def _told(runs: DataFrame) -> DataFrame:
    return runs.withColumn("created_at", F.col("created_at").cast("string"))


@query(
    f"""SELECT spec_id, spec_version, arg_min(run_id, (created_at, run_id)) AS run_id, CAST(min(created_at) AS VARCHAR) AS created_at
    FROM ({RUNS_SQL}) WHERE status = 'SUCCESS' AND NOT coalesce(replay_mode, false) GROUP BY spec_id, spec_version"""
)
def first_success(spark, sf_dir) -> DataFrame:
    return _told(ledger.first_success(_runs(spark, sf_dir)))


@query(
    f"""SELECT run_id, spec_id, status, CAST(created_at AS VARCHAR) AS created_at FROM ({RUNS_SQL})
    WHERE layer IN ('semantic', 'semantics') AND spec_version = '1.1.0' AND NOT coalesce(replay_mode, false)"""
)
def evidence_filter(spark, sf_dir) -> DataFrame:
    found = ledger.matching_runs(_runs(spark, sf_dir), spec_version="1.1.0", layer="semantic", replays=False)
    return _told(found.select("run_id", "spec_id", "status", "created_at"))


@query(
    f"""SELECT run_id, spec_id, status, CAST(created_at AS VARCHAR) AS created_at FROM ({RUNS_SQL}) q
    ORDER BY q.created_at DESC, run_id LIMIT 20"""
)
def recent_runs(spark, sf_dir) -> DataFrame:
    return _told(ledger.recent_runs(_runs(spark, sf_dir).select("run_id", "spec_id", "status", "created_at"), 20))


@query(
    f"""SELECT run_id, spec_id, status, CAST(created_at AS VARCHAR) AS created_at FROM ({RUNS_SQL}) q
    WHERE layer IN ('semantic', 'semantics') ORDER BY q.created_at DESC, run_id DESC LIMIT 1"""
)
def latest_evidence(spark, sf_dir) -> DataFrame:
    found = ledger.latest_evidence(_runs(spark, sf_dir), "semantics")
    return _told(found.select("run_id", "spec_id", "status", "created_at"))


@query(
    """SELECT o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey))::BIGINT AS seq FROM orders"""
)
def sequence_numbers_per_store(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return ledger.store_sequence(orders, "o_orderstatus", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query(
    """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text))::BIGINT AS step_no, role AS step,
      length(text)::BIGINT AS size FROM conversations"""
)
def run_components(spark, sf_dir) -> DataFrame:
    """Steps of each conversation in order, one row per step."""
    steps = table(spark, sf_dir, "conversations")
    numbered = sequence_numbers(steps, order_by=["turn", "role", "text"], partition_by=["conv_id"], name="step_no")
    return numbered.select("conv_id", "step_no", F.col("role").alias("step"), F.length("text").cast("bigint").alias("size"))


@query(
    """SELECT c_custkey AS run_id, 'SUCCESS' AS status, c_mktsegment AS spec_id, s.n AS step_no, s.name AS step FROM customer,
      (VALUES (1, 'parse'), (2, 'enrich'), (3, 'write')) s(n, name)"""
)
def bill_of_materials(spark, sf_dir) -> DataFrame:
    """Component lists as the ledger holds them, unfolded."""
    parts = F.array(
        *[F.struct(F.lit(n).alias("step_no"), F.lit(s).alias("step")) for n, s in enumerate(("parse", "enrich", "write"), 1)]
    )
    runs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), F.lit("SUCCESS").alias("status"), F.col("c_mktsegment").alias("spec_id"),
        parts.alias("components"),
    )
    return ledger.bill_of_materials(runs)


# -- versions ---------------------------------------------------------------------------

DEPLOYED_SQL = """SELECT p_brand AS spec_id, p_size || '.' || length(p_name) || CASE WHEN p_type = 'ECONOMY' THEN '.0-beta' ELSE '.0' END AS version,
      sha256(p_type) AS content_hash, make_timestamp(1700000000000000 + p_partkey * 60000000) AS deployed_at, p_partkey FROM part"""
KEY_SQL = "list_transform(list_filter(string_split({v}, '.'), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: x::BIGINT)"


def _deployed(spark, sf_dir) -> DataFrame:
    """Parts read as deployments: each brand a spec, versions from size and name length."""
    version = F.concat(
        F.col("p_size").cast("string"), F.lit("."), F.length("p_name").cast("string"),
        F.when(F.col("p_type") == "ECONOMY", ".0-beta").otherwise(".0"),
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("spec_id"),
        version.alias("version"),
        F.sha2("p_type", 256).alias("content_hash"),
        F.timestamp_micros(F.lit(1700000000000000) + F.col("p_partkey") * 60000000).alias("deployed_at"),
        "p_partkey",
    )


@query(
    f"""SELECT spec_id, version, (row_number() OVER (PARTITION BY spec_id ORDER BY {KEY_SQL.format(v="version")}, version))::BIGINT AS position
    FROM (SELECT DISTINCT spec_id, version FROM ({DEPLOYED_SQL}))"""
)
def semver_order(spark, sf_dir) -> DataFrame:
    return versions.version_order(_deployed(spark, sf_dir))


@query(
    f"""SELECT spec_id, arg_max(version, ({KEY_SQL.format(v="version")}, -first_at)) AS latest_version, count(*)::BIGINT AS version_count
    FROM (SELECT spec_id, version, min(epoch_us(deployed_at)) AS first_at FROM ({DEPLOYED_SQL}) GROUP BY spec_id, version) GROUP BY spec_id"""
)
def version_summary(spark, sf_dir) -> DataFrame:
    return versions.version_summary(_deployed(spark, sf_dir))


@query(
    f"""SELECT p_partkey, spec_id, version, arg_max(version, ({KEY_SQL.format(v="version")}, -epoch_us(deployed_at)))
      OVER (PARTITION BY spec_id ORDER BY deployed_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_version
    FROM ({DEPLOYED_SQL})"""
)
def previous_version(spark, sf_dir) -> DataFrame:
    return versions.previous_versions(_deployed(spark, sf_dir)).select("p_partkey", "spec_id", "version", "previous_version")


@query(
    f"""SELECT p_partkey, version, CAST(deployed_at AS VARCHAR) AS deployed_at FROM ({DEPLOYED_SQL}) WHERE spec_id = 'Brand#2'"""
)
def deployment_history(spark, sf_dir) -> DataFrame:
    found = ledger.deployment_history(_deployed(spark, sf_dir), "Brand#2")
    return found.select("p_partkey", "version", F.col("deployed_at").cast("string").alias("deployed_at"))


@query(
    f"""WITH d AS ({DEPLOYED_SQL}), known AS (SELECT spec_id, version, arg_max(content_hash, deployed_at) AS h, min(epoch_us(deployed_at)) AS f FROM d GROUP BY spec_id, version),
      latest AS (SELECT spec_id, arg_max(version, ({KEY_SQL.format(v="version")}, -f)) AS l FROM known GROUP BY spec_id),
      c AS (SELECT p_partkey, CASE WHEN p_retailprice > 1050 THEN p_brand ELSE 'New ' || p_brand END AS spec_id,
        CASE WHEN p_type = 'PROMO' THEN p_size + 40 ELSE p_size END || '.' || length(p_name) || '.0' AS version, sha256(p_type) AS content_hash FROM part)
    SELECT c.p_partkey, c.spec_id, c.version,
      CASE WHEN h IS NULL THEN 'DEPLOYED' WHEN h = c.content_hash THEN 'SKIPPED' ELSE 'VIOLATION' END AS status,
      CASE WHEN h IS NULL THEN l END AS previous_version,
      h IS NULL AND (l IS NULL OR {KEY_SQL.format(v="c.version")} > {KEY_SQL.format(v="l")}) AS is_latest
    FROM c LEFT JOIN known ON c.spec_id = known.spec_id AND c.version = known.version LEFT JOIN latest ON c.spec_id = latest.spec_id"""
)
def publish_classify(spark, sf_dir) -> DataFrame:
    size = F.when(F.col("p_type") == "PROMO", F.col("p_size") + 40).otherwise(F.col("p_size"))
    candidates = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_retailprice") > 1050, F.col("p_brand")).otherwise(F.concat(F.lit("New "), "p_brand")).alias("spec_id"),
        F.concat(size.cast("string"), F.lit("."), F.length("p_name").cast("string"), F.lit(".0")).alias("version"),
        F.sha2("p_type", 256).alias("content_hash"),
    )
    return versions.classify_publish(candidates, _deployed(spark, sf_dir)).drop("content_hash")


# -- lineage ----------------------------------------------------------------------------


def _lineage_runs(spark, sf_dir) -> DataFrame:
    """Orders as retrievals of their customer's projection and of one named after their
    priority, which no run made; customers as projections of their nation's curation, which
    is lost for one segment."""

    def ids(prefix: str, *keys: str):
        return F.array(*[F.concat(F.lit(p), F.col(k).cast("string")) for p, k in zip(prefix.split(), keys)])

    def runs(df: DataFrame, layer: str, run, parents, docs) -> DataFrame:
        return df.select(run.alias("run_id"), F.lit(layer).alias("layer"), parents.alias("parents"), docs.alias("doc_ids"))

    none = F.lit(None).cast("array<string>")
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    origin = F.when(F.col("c_mktsegment") == "BUILDING", "lost").otherwise(F.col("c_nationkey").cast("string"))
    customers = customers.withColumn("origin", origin)
    return (
        runs(orders, "retrieval", F.concat(F.lit("ret-"), F.col("o_orderkey").cast("string")), ids("sem- sem-", "o_custkey", "o_orderpriority"), none)
        .unionByName(runs(customers, "semantics", F.concat(F.lit("sem-"), F.col("c_custkey").cast("string")), ids("cur-", "origin"), none))
        .unionByName(
            runs(nations, "curation", F.concat(F.lit("cur-"), F.col("n_nationkey").cast("string")), none, F.array(F.concat(F.lit("doc-"), "n_name")))
        )
    )


HOPS_SQL = """WITH o AS (SELECT 'ret-' || o_orderkey AS root_run, o_custkey, o_orderpriority FROM orders),
      c AS (SELECT o.*, c_custkey IS NOT NULL AS known, CASE WHEN c_mktsegment = 'BUILDING' THEN 'lost' ELSE c_nationkey::VARCHAR END AS origin,
        c_mktsegment <> 'BUILDING' AND n_name IS NOT NULL AS sourced
        FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT root_run, 0::INTEGER AS hop, 0::INTEGER AS parent_no, root_run AS run_id, true AS found FROM o
    UNION ALL SELECT root_run, 1, 0, 'sem-' || o_custkey, known FROM c
    UNION ALL SELECT root_run, 1, 1, 'sem-' || o_orderpriority, false FROM o
    UNION ALL SELECT root_run, 2, 0, 'cur-' || origin, sourced FROM c WHERE known"""


@query(HOPS_SQL)
def lineage_trace(spark, sf_dir) -> DataFrame:
    return lineage.hops(lineage.trace(_lineage_runs(spark, sf_dir)))


@query(
    """SELECT 'sem-' || c_custkey AS root_run, CASE WHEN c_mktsegment = 'BUILDING' THEN 'cur-lost' ELSE 'cur-' || c_nationkey END AS curation_run,
      c_mktsegment <> 'BUILDING' AND n_name IS NOT NULL AS curation_found
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def lineage_semantic(spark, sf_dir) -> DataFrame:
    return lineage.trace(_lineage_runs(spark, sf_dir), "semantic").select("root_run", "curation_run", "curation_found")


@query(
    """SELECT DISTINCT 'ret-' || o_orderkey AS root_run, 'doc-' || n_name AS doc_id
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'"""
)
def lineage_documents(spark, sf_dir) -> DataFrame:
    return lineage.source_documents(lineage.trace(_lineage_runs(spark, sf_dir)))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'"""
)
def traceability_filter(spark, sf_dir) -> DataFrame:
    """Lines whose order can be traced over at least half of its hops."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("ret-"), F.col("l_orderkey").cast("string")).alias("run_id")
    )
    paths = lineage.trace(_lineage_runs(spark, sf_dir))
    return lineage.with_min_traceability(lines, paths, 0.5).drop("run_id")


@query(
    """SELECT 'sem-' || c_custkey AS root_run, 'doc-' || n_name AS doc_id
    FROM customer, nation WHERE n_nationkey = c_nationkey OR n_nationkey = (c_nationkey + 1) % 25"""
)
def lineage_many_parents(spark, sf_dir) -> DataFrame:
    """Semantic runs with two curation parents go back to the documents of both."""
    runs = _lineage_runs(spark, sf_dir)
    customers = table(spark, sf_dir, "customer")
    parents = F.array(*[F.concat(F.lit("cur-"), key.cast("string")) for key in (F.col("c_nationkey"), (F.col("c_nationkey") + 1) % 25)])
    two = customers.select(
        F.concat(F.lit("sem-"), F.col("c_custkey").cast("string")).alias("run_id"),
        F.lit("semantic").alias("layer"),
        parents.alias("parents"),
        F.array().cast("array<string>").alias("doc_ids"),
    )
    curations = runs.where("layer = 'curation'").select(*two.columns)
    return lineage.source_documents(lineage.trace(curations.unionByName(two), "semantic"))


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS child, unnest([c_custkey // 2, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 3 END,
        CASE WHEN c_custkey = 1 THEN 5 END]) AS parent FROM customer),
    reach AS (SELECT c_custkey AS root, c_custkey AS run FROM customer WHERE c_mktsegment = 'BUILDING'
      UNION SELECT root, parent FROM reach JOIN e ON child = run WHERE parent IS NOT NULL)
    SELECT 'run-' || root AS root_run, 'run-' || run AS run_id, c.c_custkey IS NOT NULL AS found,
      CASE WHEN c.c_custkey IS NULL THEN NULL WHEN c.c_acctbal < 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
      'doc-' || p_partkey AS doc_id, p_brand || '.csv' AS source, 'raw/' || p_partkey AS path
    FROM reach LEFT JOIN customer c ON run = c.c_custkey LEFT JOIN part ON p_partkey = run"""
)
def lineage_deep(spark, sf_dir) -> DataFrame:
    """Customers as runs whose parents have half or a third of their number: chains of many
    lengths that meet, a cycle at the top (1, 5, 2, 1) and a run 0 that no ledger holds.
    The runs numbered as a part read that part's file."""
    key = F.col("c_custkey")
    name = lambda k: F.concat(F.lit("run-"), k.cast("string"))
    parents = F.array(name(F.expr("c_custkey div 2")), F.when(key % 3 == 0, name(F.expr("c_custkey div 3"))), F.when(key == 1, F.lit("run-5")))
    runs = table(spark, sf_dir, "customer").select(
        name(key).alias("run_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "retrieval").otherwise("semantic").alias("layer"),
        parents.alias("parents"),
        F.when(F.col("c_acctbal") < 0, "FAILED").otherwise("SUCCESS").alias("status"),
    )
    part = F.col("p_partkey").cast("string")
    raw = table(spark, sf_dir, "part").select(
        name(F.col("p_partkey")).alias("run_id"), F.concat(F.lit("doc-"), part).alias("doc_id"),
        F.concat("p_brand", F.lit(".csv")).alias("source"), F.concat(F.lit("raw/"), part).alias("path"),
    )
    return lineage.sources(lineage.ancestry(runs), runs, raw).drop("depth")
