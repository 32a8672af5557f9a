"""Keyed joins, temporal joins and output formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.operators import asof, joins
from curalith.operators.project import JOIN
from curalith.queries.registry import query, table
from curalith.sources.output import flatten, jsonld_rows

# Customers of one segment and orders in one state have no key.
P_SQL = "SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS customer_id, c_custkey AS own_id, c_mktsegment AS segment FROM customer"
S_SQL = "SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS customer_id, o_orderkey AS order_id FROM orders"
OUT_SQL = """SELECT p.customer_id AS primary_customer_id, p.own_id AS primary_own_id, p.segment AS primary_segment,
      s.customer_id AS secondary_customer_id, s.order_id AS secondary_order_id, '{how}' AS join_type,
      coalesce(p.customer_id, s.customer_id)::VARCHAR AS key_value,
      CASE WHEN p.customer_id IS NULL OR s.customer_id IS NULL THEN false END AS matched,
      CASE WHEN p.own_id IS NULL THEN 'orders' WHEN s.order_id IS NULL THEN 'customers' ELSE 'customers,orders' END AS sources
    FROM ({p}) p {join} ({s}) s ON p.customer_id = s.customer_id"""


def _out(how: str, join: str, p: str = P_SQL, s: str = S_SQL) -> str:
    return OUT_SQL.format(how=how, join=join, p=p, s=s)


def _primary(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("customer_id"),
        F.col("c_custkey").alias("own_id"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("x").alias("__context__"),
    )


def _secondary(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("customer_id"), F.col("o_orderkey").alias("order_id")
    )


def _plain(joined: DataFrame) -> DataFrame:
    """Provenance as plain columns."""
    origin = F.col(JOIN)
    return joined.withColumns(
        {
            "join_type": origin["type"],
            "key_value": origin["key_value"],
            "matched": origin["matched"],
            "sources": F.array_join(origin["sources"], ","),
        }
    ).drop(JOIN)


def _joined(spark, sf_dir, how: str) -> DataFrame:
    return joins.keyed_join(
        _primary(spark, sf_dir), _secondary(spark, sf_dir), "customer_id", how,
        primary_name="customers", secondary_name="orders",
    )


@query(_out("inner", "JOIN"))
def join_inner(spark, sf_dir) -> DataFrame:
    return _plain(_joined(spark, sf_dir, "inner"))


@query(_out("left_outer", "LEFT JOIN"))
def join_left(spark, sf_dir) -> DataFrame:
    return _plain(_joined(spark, sf_dir, "left_outer"))


@query(_out("full_outer", "FULL JOIN"))
def join_full(spark, sf_dir) -> DataFrame:
    return _plain(_joined(spark, sf_dir, "full_outer"))


@query(_out("full_outer_compat", "LEFT JOIN"))
def join_full_compat(spark, sf_dir) -> DataFrame:
    return _plain(_joined(spark, sf_dir, "full_outer_compat"))


@query(
    f"""SELECT count(*)::BIGINT AS output_rows, count(s.customer_id)::BIGINT AS match_count
    FROM ({P_SQL}) p LEFT JOIN ({S_SQL}) s ON p.customer_id = s.customer_id"""
)
def join_stats(spark, sf_dir) -> DataFrame:
    return joins.join_stats(_joined(spark, sf_dir, "left_outer"))


@query(
    """SELECT n_nationkey, n_name, n_regionkey, 'passthrough' AS join_type, CAST(NULL AS VARCHAR) AS key_value,
      CAST(NULL AS BOOLEAN) AS matched, 'nations' AS sources FROM nation"""
)
def join_passthrough(spark, sf_dir) -> DataFrame:
    return _plain(joins.keyed_join(table(spark, sf_dir, "nation"), None, "n_nationkey", primary_name="nations"))


@query(
    """SELECT o_orderkey AS primary_order_id, o_orderstatus AS primary_status, l_orderkey AS secondary_order_id,
      l_linestatus AS secondary_status, l_linenumber AS secondary_line, 'left_outer' AS join_type,
      o_orderkey || ',' || o_orderstatus AS key_value, CASE WHEN l_orderkey IS NULL THEN false END AS matched,
      CASE WHEN l_orderkey IS NULL THEN 'orders' ELSE 'orders,lines' END AS sources
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus"""
)
def join_multi_key(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line")
    )
    return _plain(
        joins.keyed_join(orders, lines, ["order_id", "status"], "left_outer", primary_name="orders", secondary_name="lines")
    )


@query(
    _out(
        "inner",
        "JOIN",
        P_SQL.replace("FROM customer", "FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')"),
        S_SQL.replace("FROM orders", "FROM orders WHERE o_orderkey > o_custkey * 2"),
    )
)
def filtered_source_join(spark, sf_dir) -> DataFrame:
    left = joins.filtered(_primary(spark, sf_dir), {"segment": ["MACHINERY", "FURNITURE"]})
    right = joins.filtered(_secondary(spark, sf_dir), "order_id > customer_id * 2")
    return _plain(
        joins.keyed_join(left, right, "customer_id", "inner", primary_name="customers", secondary_name="orders")
    )


# -- temporal ---------------------------------------------------------------------------


def _of_type(spark, sf_dir, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "user_id", "ts")


def _near(joined: DataFrame) -> DataFrame:
    return joined.select("primary_event_id", "primary_user_id", "secondary_event_id", F.col("secondary_ts").cast("string"))


@query(
    """SELECT e.event_id AS primary_event_id, e.user_id AS primary_user_id,
      CASE WHEN epoch_us(e.ts) - epoch_us(c.ts) <= 86400000000 THEN c.event_id END AS secondary_event_id,
      CASE WHEN epoch_us(e.ts) - epoch_us(c.ts) <= 86400000000 THEN CAST(c.ts AS VARCHAR) END AS secondary_ts
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts"""
)
def asof_join(spark, sf_dir) -> DataFrame:
    """Each error with the user's latest click of the day before it."""
    return _near(
        asof.temporal_join(
            _of_type(spark, sf_dir, "error"), _of_type(spark, sf_dir, "click"),
            keys=["user_id"], time="ts", tie_by="event_id", tolerance_seconds=86_400,
        )
    )


@query(
    """SELECT e.event_id AS primary_event_id, e.user_id AS primary_user_id, c.event_id AS secondary_event_id,
      CAST(c.ts AS VARCHAR) AS secondary_ts
    FROM (SELECT * FROM events WHERE event_type = 'view') e
    ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') c ON e.user_id = c.user_id AND e.ts <= c.ts"""
)
def asof_forward(spark, sf_dir) -> DataFrame:
    """Each view with the user's next purchase; views without one are left out."""
    return _near(
        asof.temporal_join(
            _of_type(spark, sf_dir, "view"), _of_type(spark, sf_dir, "purchase"),
            keys=["user_id"], time="ts", tie_by="event_id", direction="forward", join_type="inner",
        )
    )


@query(
    """WITH e AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'view'),
      b AS (SELECT e.event_id, e.user_id, e.ts, c.event_id AS bid, c.ts AS bts FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts),
      f AS (SELECT b.*, c.event_id AS fid, c.ts AS fts FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.ts <= c.ts),
      n AS (SELECT *, CASE WHEN fid IS NULL OR (bid IS NOT NULL AND epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts)) THEN bid ELSE fid END AS sid FROM f),
      r AS (SELECT *, CASE WHEN sid = bid THEN bts ELSE fts END AS sts FROM n)
    SELECT event_id AS primary_event_id, user_id AS primary_user_id,
      CASE WHEN abs(epoch_us(ts) - epoch_us(sts)) <= 21600000000 THEN sid END AS secondary_event_id,
      CASE WHEN abs(epoch_us(ts) - epoch_us(sts)) <= 21600000000 THEN CAST(sts AS VARCHAR) END AS secondary_ts FROM r"""
)
def asof_nearest(spark, sf_dir) -> DataFrame:
    """Each purchase with the user's view nearest to it, at most six hours away."""
    return _near(
        asof.temporal_join(
            _of_type(spark, sf_dir, "purchase"), _of_type(spark, sf_dir, "view"),
            keys=["user_id"], time="ts", tie_by="event_id", direction="nearest", tolerance_seconds=21_600,
        )
    )


# -- output formats ---------------------------------------------------------------------


@query(
    """SELECT '{"@context":{"@vocab":"urn:trade#","name":"urn:trade#name"},"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name
      || '","s_nationkey":' || s_nationkey || ',"rated":' || CASE WHEN s_acctbal > 0 THEN '"good"' ELSE 'null' END || '}' AS jsonld FROM supplier"""
)
def jsonld_output(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_acctbal") > 0, "good").alias("rated")
    )
    return jsonld_rows(rows, {"@vocab": "urn:trade#", "name": "urn:trade#name"})


@query(
    """SELECT s_suppkey, s_name AS "who.name", s_nationkey AS "who.nation", '["' || s_name || '"]' AS tags FROM supplier"""
)
def flat_output(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("who"),
        F.array("s_name").alias("tags"),
    )
    return flatten(rows)
