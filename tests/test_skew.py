"""A third of the rows under one key: large joins must split it, and results stay whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curalith.operators import enrich, joins, keys, ledger, lineage

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "12",
}
N, KEYS = 60_000, 4_000


@pytest.fixture
def large(spark):
    """Thresholds so low that the tables count as too large to broadcast."""
    before = {k: spark.conf.get(k, None) for k in LOW}
    for key, value in LOW.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def tables(large, tmp_path):
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % KEYS)
    facts = large.range(0, N, 1, 12).select(
        F.col("id").alias("row"), hot.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload")
    )
    facts.write.parquet(str(tmp_path / "facts"))
    dim = large.range(0, KEYS + 100, 1, 4).select(
        F.col("id").alias("k"), F.concat(F.lit("Name "), F.col("id").cast("string")).alias("name")
    )
    dim.write.parquet(str(tmp_path / "dim"))
    return large.read.parquet(str(tmp_path / "facts")), large.read.parquet(str(tmp_path / "dim"))


def run(df):
    """Row count, and how many joins of the final plan were split."""
    used = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*df.columns)))
    n = used.collect()[0][0]
    final = used._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return n, final.count("skew=true")


@pytest.mark.parametrize("how", ["inner", "left_outer", "full_outer"])
def test_joins_split_a_hot_key_on_either_side(tables, how):
    facts, dim = tables
    unmatched = 100 if how != "inner" else 0
    n, split = run(joins.keyed_join(dim, facts, "k", how))
    assert (n, split >= 1) == (N + unmatched, True)
    n, split = run(joins.keyed_join(facts, dim, "k", how))
    assert (n, split >= (1 if how == "inner" else 2)) == (N + (100 if how == "full_outer" else 0), True)


def test_enrichment_splits_a_hot_value(tables):
    facts, dim = tables
    named = facts.withColumn("name", F.concat(F.lit("NAME "), F.col("k").cast("string")))
    n, split = run(enrich.enrich(named, dim, "name", "code", code="k"))
    assert n == N and split >= 1


def test_keys_split_a_hot_key(tables):
    facts, _ = tables
    n, split = run(keys.mark_duplicates(facts, ["k"], ["row"]))
    assert n == N and split >= 1
    distinct = facts.select("k").distinct().count()
    assert keys.primary_key_duplicates(facts, ["k"], ["row"]).count() == N - distinct


def test_lineage_splits_a_hot_parent(tables):
    facts, dim = tables

    def events(df, layer, key, parent):
        return df.select(
            key.alias("run_id"), F.lit(layer).alias("layer"), F.array(parent).alias("parents"),
            F.array(key).alias("doc_ids"), F.lit(0).alias("seq"), F.lit("2024-01-01").cast("timestamp").alias("ts"),
        )

    semantic = F.concat(F.lit("s"), F.col("k").cast("string"))
    ledgered = events(facts, "retrieval", F.col("payload"), semantic).unionByName(
        events(dim, "semantic", semantic, F.lit("curation"))
    )
    n, split = run(lineage.trace(ledger.fold_runs(ledgered)))
    assert n == N and split >= 1
