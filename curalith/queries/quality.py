"""Quality reports, schema violations, quarantine and primary keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.operators import keys, prefix, quality, schema_rules
from curalith.queries.registry import query, table

CUSTOMER_MODEL = {
    "columns": [
        {"column_name": "c_name", "data_type": "string", "constraints": {"is_nullable": False},
         "quality_checks": [{"check": "not_null"}]},
        {"column_name": "c_nationkey", "data_type": "integer", "constraints": {"is_nullable": False},
         "quality_checks": [{"check": "not_null"}, {"check": "range", "params": {"min": 0, "max": 20}}]},
        {"column_name": "c_acctbal", "data_type": "float", "constraints": {"is_nullable": True},
         "quality_checks": [{"check": "positive"}, {"check": "range", "params": {"min": -500, "max": 9000}}]},
        {"column_name": "c_mktsegment", "data_type": "string",
         "quality_checks": [{"check": "looks_right"}]},
    ]
}

CUSTOMER_ROWS = """
  SELECT 'c_name' AS column_name, 1 AS check_no, 'not_null' AS "check",
         count(*) FILTER (WHERE c_name IS NULL OR trim(c_name) = '') AS failed FROM customer
  UNION ALL SELECT 'c_nationkey', 1, 'not_null', count(*) FILTER (WHERE c_nationkey IS NULL) FROM customer
  UNION ALL SELECT 'c_nationkey', 2, 'range', count(*) FILTER (WHERE NOT coalesce(c_nationkey BETWEEN 0 AND 20, false)) FROM customer
  UNION ALL SELECT 'c_acctbal', 1, 'positive', count(*) FILTER (WHERE NOT coalesce(c_acctbal > 0, false)) FROM customer
  UNION ALL SELECT 'c_acctbal', 2, 'range', count(*) FILTER (WHERE NOT coalesce(c_acctbal BETWEEN -500 AND 9000, false)) FROM customer
  UNION ALL SELECT 'c_mktsegment', 1, 'looks_right', 0 FROM (SELECT count(*) FROM customer)
"""


@query(
    f"""SELECT column_name, check_no::INTEGER AS check_no, "check", failed = 0 AS passed, failed::BIGINT AS failed_count
    FROM ({CUSTOMER_ROWS})"""
)
def dq_report(spark, sf_dir) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "customer"), CUSTOMER_MODEL)


@query(
    f"""SELECT column_name, bool_and(failed = 0) AS passed, sum(failed)::BIGINT AS failed_count
    FROM ({CUSTOMER_ROWS}) GROUP BY column_name"""
)
def dq_columns(spark, sf_dir) -> DataFrame:
    return quality.quality_by_column(table(spark, sf_dir, "customer"), CUSTOMER_MODEL)


@query(
    f"""SELECT count(*)::BIGINT AS total_checks, count(*) FILTER (WHERE failed = 0)::BIGINT AS passed_checks,
      count(*) FILTER (WHERE failed > 0)::BIGINT AS failed_checks,
      CASE WHEN bool_and(failed = 0) THEN 'PASSED' ELSE 'FAILED' END AS status
    FROM ({CUSTOMER_ROWS})"""
)
def dq_overall(spark, sf_dir) -> DataFrame:
    return quality.quality_overall(table(spark, sf_dir, "customer"), CUSTOMER_MODEL)


LINEITEM_MODEL = {
    "columns": [
        {"column_name": "l_orderkey", "quality_checks": [{"check": "not_null"}]},
        {"column_name": "l_quantity", "quality_checks": [{"check": "positive"}, {"check": "range", "params": {"max": 45}}]},
        {"column_name": "l_extendedprice", "quality_checks": [{"check": "range", "params": {"min": 5000}}]},
        {"column_name": "l_discount", "quality_checks": [{"check": "positive"}, {"check": "range", "params": {"min": 0, "max": 0.08}}]},
        {"column_name": "l_tax", "quality_checks": [{"check": "positive"}]},
        {"column_name": "l_returnflag", "quality_checks": [{"check": "not_null"}, {"check": "positive"}]},
        {"column_name": "l_shipdate", "quality_checks": [{"check": "not_null"}]},
        {"column_name": "l_comment", "quality_checks": [{"check": "not_null"}, {"check": "unheard_of"}]},
    ]
}


@query(
    """SELECT column_name, check_no::INTEGER AS check_no, "check", failed = 0 AS passed, failed::BIGINT AS failed_count FROM (
      SELECT 'l_orderkey' AS column_name, 1 AS check_no, 'not_null' AS "check", count(*) FILTER (WHERE l_orderkey IS NULL) AS failed FROM lineitem
      UNION ALL SELECT 'l_quantity', 1, 'positive', count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) FROM lineitem
      UNION ALL SELECT 'l_quantity', 2, 'range', count(*) FILTER (WHERE NOT coalesce(l_quantity <= 45, false)) FROM lineitem
      UNION ALL SELECT 'l_extendedprice', 1, 'range', count(*) FILTER (WHERE NOT coalesce(l_extendedprice >= 5000, false)) FROM lineitem
      UNION ALL SELECT 'l_discount', 1, 'positive', count(*) FILTER (WHERE NOT coalesce(l_discount > 0, false)) FROM lineitem
      UNION ALL SELECT 'l_discount', 2, 'range', count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.08::DOUBLE, false)) FROM lineitem
      UNION ALL SELECT 'l_tax', 1, 'positive', count(*) FILTER (WHERE NOT coalesce(l_tax > 0, false)) FROM lineitem
      UNION ALL SELECT 'l_returnflag', 1, 'not_null', count(*) FILTER (WHERE l_returnflag IS NULL OR trim(l_returnflag) = '') FROM lineitem
      UNION ALL SELECT 'l_returnflag', 2, 'positive', count(*) FILTER (WHERE NOT coalesce(try_cast(l_returnflag AS DOUBLE) > 0, false)) FROM lineitem
      UNION ALL SELECT 'l_shipdate', 1, 'not_null', count(*) FILTER (WHERE l_shipdate IS NULL) FROM lineitem
      UNION ALL SELECT 'l_comment', 1, 'not_null', count(*) FROM lineitem
      UNION ALL SELECT 'l_comment', 2, 'unheard_of', 0)"""
)
def dq_missing_fail(spark, sf_dir) -> DataFrame:
    """Twelve checks in one scan; the column the table lacks fails on every row."""
    return quality.quality_report(table(spark, sf_dir, "lineitem"), LINEITEM_MODEL, missing="fail")


@query(
    """SELECT 10::BIGINT AS total_checks, count(*) FILTER (WHERE failed = 0)::BIGINT + 3 AS passed_checks,
      count(*) FILTER (WHERE failed > 0)::BIGINT AS failed_checks,
      CASE WHEN bool_and(failed = 0) THEN 'PASSED' ELSE 'FAILED' END AS status
    FROM (
      SELECT count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS failed FROM lineitem
      UNION ALL SELECT count(*) FILTER (WHERE NOT coalesce(l_quantity <= 45, false)) FROM lineitem
      UNION ALL SELECT count(*) FILTER (WHERE NOT coalesce(l_extendedprice >= 5000, false)) FROM lineitem
      UNION ALL SELECT count(*) FILTER (WHERE NOT coalesce(l_discount > 0, false)) FROM lineitem
      UNION ALL SELECT count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.08::DOUBLE, false)) FROM lineitem
      UNION ALL SELECT count(*) FILTER (WHERE NOT coalesce(l_tax > 0, false)) FROM lineitem
      UNION ALL SELECT count(*) FILTER (WHERE NOT coalesce(try_cast(l_returnflag AS DOUBLE) > 0, false)) FROM lineitem)"""
)
def dq_missing_skip(spark, sf_dir) -> DataFrame:
    return quality.quality_overall(table(spark, sf_dir, "lineitem"), LINEITEM_MODEL, missing="skip")


@query("SELECT count(*)::BIGINT AS row_count, 11::BIGINT AS column_count FROM lineitem")
def table_shape(spark, sf_dir) -> DataFrame:
    return quality.shape(table(spark, sf_dir, "lineitem"))


@query(
    """SELECT 'c_name' AS column_name, 'string' AS declared_type, 'string' AS actual_type, true AS type_ok,
        count(*) FILTER (WHERE c_name IS NULL)::BIGINT AS null_count, bool_and(c_name IS NOT NULL) AS nulls_ok FROM customer
      UNION ALL SELECT 'c_nationkey', 'integer', 'int', true, count(*) FILTER (WHERE c_nationkey IS NULL), bool_and(c_nationkey IS NOT NULL) FROM customer
      UNION ALL SELECT 'c_acctbal', 'integer', 'double', false, count(*) FILTER (WHERE c_acctbal IS NULL), true FROM customer
      UNION ALL SELECT 'c_phone', 'string', NULL, false, count(*), false FROM customer"""
)
def schema_conformance(spark, sf_dir) -> DataFrame:
    declared = {
        "columns": [
            *[dict(c) for c in CUSTOMER_MODEL["columns"][:2]],
            {"column_name": "c_acctbal", "data_type": "integer"},
            {"column_name": "c_phone", "data_type": "string", "constraints": {"is_nullable": False}},
        ]
    }
    return quality.conformance(table(spark, sf_dir, "customer"), declared)


# Rows of lineitem with no two alike in this order, and with some ship dates blanked out.
LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_SCHEMA = {
    "primary_key": ["l_orderkey", "l_linenumber"],
    "fields": [
        {"name": "l_orderkey", "type": "integer", "nullable": False},
        {"name": "l_quantity", "type": "float",
         "constraints": [{"type": "check", "expression": "l_quantity * l_extendedprice < 4000000"}]},
        {"name": "l_returnflag", "type": "string",
         "constraints": [{"type": "check", "expression": "l_returnflag > 10"}]},
        {"name": "l_discount", "type": "integer"},
        {"name": "received", "type": "string", "nullable": False},
    ],
}

JUDGED_SQL = """
  SELECT *, list_filter([
      CASE WHEN received IS NOT NULL AND NOT l_quantity * l_extendedprice < 4000000 THEN 'l_quantity:check' END,
      CASE WHEN l_discount IS NOT NULL THEN 'l_discount:type' END,
      CASE WHEN received IS NULL THEN 'received:nullable' END,
      CASE WHEN nth > 1 THEN 'l_orderkey,l_linenumber:primary_key' END
    ], lambda x: x IS NOT NULL) AS rules
  FROM (SELECT *, CASE WHEN l_returnflag = 'N' AND l_tax = 0 THEN NULL ELSE l_returnflag || l_linestatus END AS received,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS nth
    FROM lineitem)
"""


def _lines(spark, sf_dir) -> DataFrame:
    received = F.when(~((F.col("l_returnflag") == "N") & (F.col("l_tax") == 0)), F.concat("l_returnflag", "l_linestatus"))
    return table(spark, sf_dir, "lineitem").withColumn("received", received)


def _judged(spark, sf_dir, schema=LINE_SCHEMA) -> DataFrame:
    """Violations of the lines; the word compared with a number cannot be evaluated and passes."""
    return schema_rules.find_violations(_lines(spark, sf_dir), schema, order_by=LINE_ORDER)


def _told() -> list:
    """Fields and rules of the violations, in the order of the schema."""
    return [F.array_join("violations.field", ";").alias("fields"), F.array_join("violations.rule", ";").alias("rules")]


TOLD_SQL = """array_to_string(list_transform(rules, lambda x: string_split(x, ':')[1]), ';') AS fields,
      array_to_string(list_transform(rules, lambda x: string_split(x, ':')[2]), ';') AS rules"""


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, len(rules)::BIGINT AS n_violations,
      {TOLD_SQL} FROM ({JUDGED_SQL})"""
)
def schema_violations(spark, sf_dir) -> DataFrame:
    return _judged(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.size("violations").cast("bigint").alias("n_violations"),
        *_told(),
    )


# The discount rule of LINE_SCHEMA breaks on every line, so the split is made without it.
SPLIT_SCHEMA = {**LINE_SCHEMA, "fields": [f for f in LINE_SCHEMA["fields"] if f["name"] != "l_discount"]}
SPLIT_SQL = JUDGED_SQL.replace("CASE WHEN l_discount IS NOT NULL THEN 'l_discount:type' END,", "")


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, received FROM ({SPLIT_SQL}) WHERE len(rules) = 0"""
)
def valid_rows(spark, sf_dir) -> DataFrame:
    valid, _ = schema_rules.split_valid(_judged(spark, sf_dir, SPLIT_SCHEMA))
    return valid.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "received")


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {TOLD_SQL}
    FROM ({SPLIT_SQL}) WHERE len(rules) > 0"""
)
def quarantined_rows(spark, sf_dir) -> DataFrame:
    _, aside = schema_rules.split_valid(_judged(spark, sf_dir, SPLIT_SCHEMA))
    return aside.select(
        "record.l_orderkey",
        "record.l_linenumber",
        "record.l_partkey",
        "record.l_suppkey",
        *_told(),
    )


@query(
    f"""SELECT count(*)::BIGINT AS total_records, count(*) FILTER (WHERE len(rules) > 0)::BIGINT AS quarantined_count,
      count(*) FILTER (WHERE len(rules) = 0)::BIGINT AS valid_count FROM ({SPLIT_SQL})"""
)
def quarantine_stats(spark, sf_dir) -> DataFrame:
    return schema_rules.quarantine_stats(_judged(spark, sf_dir, SPLIT_SCHEMA))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, first_l_partkey, first_l_suppkey FROM (
      SELECT *, row_number() OVER w AS nth, first_value(l_partkey) OVER w AS first_l_partkey,
        first_value(l_suppkey) OVER w AS first_l_suppkey
      FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice))
    WHERE nth > 1"""
)
def pk_duplicates(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return keys.primary_key_duplicates(lines, ["l_orderkey", "l_linenumber"], LINE_ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "first_l_partkey", "first_l_suppkey"
    )


@query("SELECT event_id, user_id, (row_number() OVER (ORDER BY ts, event_id) - 1)::BIGINT AS record_index FROM events")
def record_index(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return prefix.record_index(events, order_by=["ts", "event_id"]).select("event_id", "user_id", "record_index")


@query(
    """WITH r AS (SELECT ['c_acctbal', 'c_nationkey', 'c_name', 'c_absent'][p_partkey % 4 + 1] AS column_name, (p_partkey // 4)::INTEGER AS check_no,
        ['not_null', 'positive', 'range', 'looks_right'][p_size % 4 + 1] AS "check", CASE WHEN p_size > 5 THEN p_size::DOUBLE END AS lo, p_retailprice::DOUBLE AS hi FROM part),
    d AS (SELECT 'c_acctbal' AS column_name, c_acctbal::DOUBLE AS v FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::DOUBLE FROM customer),
    f AS (SELECT column_name, check_no, "check", count(*) FILTER (WHERE CASE "check" WHEN 'not_null' THEN v IS NULL WHEN 'positive' THEN NOT coalesce(v > 0, false)
        WHEN 'range' THEN v IS NULL OR v < lo OR v > hi ELSE false END) AS n FROM r JOIN d USING (column_name) GROUP BY ALL
      UNION ALL SELECT column_name, check_no, "check", (SELECT count(*) FROM customer WHERE "check" IN ('positive', 'range') OR ("check" = 'not_null' AND trim(coalesce(c_name, '')) = ''))
        FROM r WHERE column_name = 'c_name'
      UNION ALL SELECT column_name, check_no, "check", CASE WHEN "check" = 'looks_right' THEN 0 ELSE (SELECT count(*) FROM customer) END FROM r WHERE column_name = 'c_absent')
    SELECT column_name, check_no, "check", n = 0 AS passed, n::BIGINT AS failed_count FROM f"""
)
def rules_from_table(spark, sf_dir) -> DataFrame:
    """As many rules as there are parts, over customers and a column these lack."""
    name = F.element_at(F.array(*map(F.lit, ("c_acctbal", "c_nationkey", "c_name", "c_absent"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    check = F.element_at(F.array(*map(F.lit, ("not_null", "positive", "range", "looks_right"))), (F.col("p_size") % 4 + 1).cast("int"))
    rules = table(spark, sf_dir, "part").select(
        name.alias("column_name"), F.expr("cast(p_partkey div 4 as int)").alias("check_no"), check.alias("check"),
        F.when(F.col("p_size") > 5, F.col("p_size").cast("double")).alias("min"), F.col("p_retailprice").cast("double").alias("max"),
    )
    return quality.report_from_rules(table(spark, sf_dir, "customer"), rules)
