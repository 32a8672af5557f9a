"""Personal fields and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.operators import governance
from curalith.queries.registry import query, table


@query("SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, c_acctbal, sha256(c_mktsegment) AS c_mktsegment FROM customer")
def pii_hash(spark, sf_dir) -> DataFrame:
    return governance.protect_fields(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def pii_drop(spark, sf_dir) -> DataFrame:
    return governance.protect_fields(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], how="drop")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 730 DAY")
def retention_expired(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    old = governance.expired(orders, 730, dt.datetime(2000, 1, 1), created="o_orderdate")
    return old.select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, sha256(c_name) AS name_hash, c_mktsegment AS segment FROM customer")
def pii_projected(spark, sf_dir) -> DataFrame:
    """A personal field inside a struct, protected before its parts become columns."""
    customer = table(spark, sf_dir, "customer")
    nested = customer.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("who"))
    safe = governance.protect_fields(nested, ["who.name"])
    return safe.select("c_custkey", F.col("who.name").alias("name_hash"), F.col("who.segment").alias("segment"))
