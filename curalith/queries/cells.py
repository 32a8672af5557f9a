"""Typing of text cells, CSV scans, text functions and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.functions import text
from curalith.functions.cells import as_number, cell_class, read_cell
from curalith.functions.digest import LANES
from curalith.operators import fingerprint
from curalith.queries.registry import query, table
from curalith.session import ensure_checkpoint_dir
from curalith.sources.csv import column_classes, read_detected_csv, read_inferred_csv, read_typed_csv
from curalith.sources.files import file_hashes
from curalith.sources.store import new_id
from pyspark.sql import types as T

# One cell text per event, of every grammar; the same expression in Spark and in the SQL.
CELL_SQL = """CASE
    WHEN event_type = 'click' THEN '  ' || CAST(event_id AS VARCHAR) || ' '
    WHEN event_type = 'view' THEN '-' || CAST(user_id AS VARCHAR) || '.' || CAST(event_id AS VARCHAR)
    WHEN event_type = 'signup' AND value < 5 THEN ''
    WHEN event_type = 'signup' AND value < 10 THEN '1e5'
    WHEN event_type = 'signup' THEN '1.0e' || CAST(user_id AS VARCHAR)
    WHEN event_type = 'purchase' AND value < 5 THEN '9999999999999999' || CAST(event_id + 1000 AS VARCHAR)
    WHEN event_type = 'purchase' AND value < 10 THEN CAST(user_id AS VARCHAR) || '.5d'
    WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) || '_000'
    ELSE props END"""
CLASS_SQL = """CASE WHEN t = '' THEN 0
    WHEN contains(t, '.') THEN CASE WHEN regexp_full_match(t, '[+-]?([0-9]+(_[0-9]+)*(\\.([0-9]+(_[0-9]+)*)?)?|\\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?') THEN 3 ELSE 4 END
    WHEN regexp_full_match(t, '[+-]?[0-9]+(_[0-9]+)*') AND try_cast(replace(t, '_', '') AS BIGINT) IS NOT NULL THEN 1
    WHEN regexp_full_match(t, '[+-]?[0-9]+(_[0-9]+)*') AND try_cast(replace(t, '_', '') AS DECIMAL(38,0)) IS NOT NULL THEN 2
    ELSE 4 END"""


def _cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("cell", F.expr(CELL_SQL.replace("VARCHAR", "STRING")))


@query(
    f"""SELECT event_id, ({CLASS_SQL})::INTEGER AS cell_class, CASE WHEN ({CLASS_SQL}) = 1 THEN try_cast(replace(t, '_', '') AS BIGINT) END AS whole
    FROM (SELECT *, trim({CELL_SQL}) AS t FROM events)"""
)
def typed_cells(spark, sf_dir) -> DataFrame:
    cell = F.col("cell")
    return _cells(spark, sf_dir).select(
        "event_id", cell_class(cell).alias("cell_class"), read_cell(cell, T.LongType()).alias("whole")
    )


@query(
    f"""SELECT column_name, max({CLASS_SQL})::INTEGER AS cell_class FROM (
      SELECT named.n AS column_name, trim(CASE named.n WHEN 'event_id' THEN event_id::VARCHAR WHEN 'value' THEN value::DECIMAL(18,2)::VARCHAR
        WHEN 'event_type' THEN event_type WHEN 'cell' THEN {CELL_SQL} ELSE '9999999999999999' || (event_id + 1000)::VARCHAR END) AS t
      FROM events, (VALUES ('event_id'), ('value'), ('event_type'), ('cell'), ('big')) named(n)) GROUP BY column_name"""
)
def column_types(spark, sf_dir) -> DataFrame:
    """The column types a CSV of the events would get."""
    cells = _cells(spark, sf_dir).select(
        F.col("event_id").cast("string"),
        F.concat(F.col("value").cast("decimal(18,2)").cast("string")).alias("value"),
        "event_type",
        "cell",
        F.concat(F.lit("9999999999999999"), (F.col("event_id") + 1000).cast("string")).alias("big"),
    )
    return column_classes(cells)


@query(
    """SELECT event_type, count(*)::BIGINT AS rows,
      count(*) FILTER (WHERE coalesce(try_cast(replace(t, '_', '') AS DOUBLE) > 0 AND NOT t LIKE '%d', false))::BIGINT AS positives
    FROM (SELECT *, trim(""" + CELL_SQL + """) AS t FROM events) GROUP BY event_type"""
)
def text_numbers(spark, sf_dir) -> DataFrame:
    """Numeric checks on text columns: what does not read as a number fails."""
    number = as_number(F.col("cell"), T.StringType())
    return (
        _cells(spark, sf_dir)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(number > 0, F.lit(False))).alias("positives"))
    )


def _as_csv(spark, df: DataFrame) -> str:
    """The rows as CSV files in the shared scratch folder."""
    path = f"{ensure_checkpoint_dir(spark)}/curalith/{new_id('csv')}"
    df.write.csv(path, header=True, escape='"')
    return path


@query(
    """SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size, p_partkey + 0.5::DOUBLE AS half,
      CASE WHEN p_size > 25 THEN p_type END AS kind FROM part"""
)
def csv_typed_scan(spark, sf_dir) -> DataFrame:
    """The parts written as CSV and read back by the typed scan."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_size",
        F.concat(F.col("p_partkey").cast("string"), F.lit(".5")).alias("half"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("  "), "p_type")).otherwise("").alias("kind"),
    )
    return read_typed_csv(spark, _as_csv(spark, parts))


@query("SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_inferred_scan(spark, sf_dir) -> DataFrame:
    read = read_inferred_csv(spark, _as_csv(spark, table(spark, sf_dir, "supplier")))
    return read.withColumn("s_suppkey", F.col("s_suppkey").cast("int"))


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown' ELSE lower(c_mktsegment) END AS agency,
      c_name || '.v1.csv' AS base_name, c_name || '.v1' AS stem,
      'raw-' || lpad(c_custkey::VARCHAR, greatest(4, length(c_custkey::VARCHAR))::INTEGER, '0') AS label,
      c_name || '.v1.csv' AS copied_from, 'raw-' || c_custkey AS copied_to FROM customer"""
)
def path_functions(spark, sf_dir) -> DataFrame:
    folder = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.lower("c_mktsegment"))
    path = F.concat(F.lit("wild/"), folder, F.lit("/"), F.col("c_name"), F.lit(".v1.csv"))
    log = F.concat(F.lit("INGEST_SUCCESS: "), "c_name", F.lit(".v1.csv -> raw-"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.agency_of(path).alias("agency"),
        text.base_name(path).alias("base_name"),
        text.stem(path).alias("stem"),
        text.sequence_label("raw", F.col("c_custkey")).alias("label"),
        text.copied_from(log).alias("copied_from"),
        text.copied_to(log).alias("copied_to"),
    )


# -- fingerprints -----------------------------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
ORDER_TEXT = "concat_ws('|', " + ", ".join(
    f"coalesce(length({v}) || ':' || {v}, '~')"
    for v in ("o_custkey::VARCHAR", "o_orderkey::VARCHAR", "o_orderpriority", "nullif(o_orderstatus, 'P')")
) + ")"
LANE_SUMS = ", ".join(f"sum(('0x' || substr(h, {4 * i + 1}, 4))::BIGINT) AS lane_{i:02d}" for i in range(LANES))
SEAL = "'sha256:' || sha256(concat_ws(':', n, " + ", ".join(f"lane_{i:02d}" for i in range(LANES)) + "))"


def _orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    return orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))


@query(f"SELECT o_orderkey, sha256({ORDER_TEXT}) AS row_sha256 FROM orders")
def row_fingerprint(spark, sf_dir) -> DataFrame:
    return fingerprint.row_fingerprints(_orders(spark, sf_dir)).select("o_orderkey", "row_sha256")


@query(
    f"""SELECT n AS record_count, {SEAL} AS content_hash FROM (
      SELECT count(*)::BIGINT AS n, {LANE_SUMS} FROM (SELECT sha256({ORDER_TEXT}) AS h FROM orders))"""
)
def dataset_fingerprint(spark, sf_dir) -> DataFrame:
    return fingerprint.dataset_fingerprint(_orders(spark, sf_dir))


@query(
    f"""SELECT o_orderpriority, n AS record_count, {SEAL} AS content_hash FROM (
      SELECT o_orderpriority, count(*)::BIGINT AS n, {LANE_SUMS}
      FROM (SELECT o_orderpriority, sha256({ORDER_TEXT}) AS h FROM orders) GROUP BY o_orderpriority)"""
)
def group_fingerprints(spark, sf_dir) -> DataFrame:
    return fingerprint.dataset_fingerprint(_orders(spark, sf_dir), by=["o_orderpriority"])


@query("SELECT n_nationkey, length(n_name) + 1 AS length, 'sha256:' || sha256(n_name || chr(10)) AS content_hash FROM nation")
def source_file_hashes(spark, sf_dir) -> DataFrame:
    """SHA-256 of files that hold a nation's name and a line feed each."""
    path = f"{ensure_checkpoint_dir(spark)}/curalith/{new_id('names')}"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    hashed = file_hashes(spark, f"{path}/n_nationkey=*/part-*")
    key = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey")
    return hashed.select(key, "length", "content_hash")


@query(
    f"""SELECT n AS record_count, {SEAL} AS content_hash FROM (
      SELECT count(*)::BIGINT AS n, {LANE_SUMS} FROM (
        SELECT sha256(length(k) || ':' || k || '|' || length(t) || ':' || t) AS h FROM (
          SELECT o_orderkey::VARCHAR AS k,
            '2|' || coalesce(length(o_orderstatus) || ':' || o_orderstatus, '~') || '|' || length(o_orderpriority) || ':' || o_orderpriority AS t
          FROM orders)))"""
)
def nested_fingerprint(spark, sf_dir) -> DataFrame:
    """A fingerprint of rows with a list in them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a_key"), F.array("o_orderstatus", "o_orderpriority").alias("b_list"))
    return fingerprint.dataset_fingerprint(orders)


@query(
    """SELECT CASE WHEN l_returnflag <> 'A' THEN l_orderkey END::BIGINT AS l_orderkey,
      CASE WHEN l_returnflag <> 'A' THEN l_linenumber END::BIGINT AS l_linenumber,
      CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS l_returnflag,
      CASE WHEN l_returnflag <> 'A' THEN l_linestatus END AS l_linestatus FROM lineitem"""
)
def csv_tab_scan(spark, sf_dir) -> DataFrame:
    """Lines as tab-separated text; a row of empty cells is a row all the same."""
    names = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    shown = [F.when(F.col("l_returnflag") != "A", F.col(c).cast("string")).alias(c) for c in names]
    path = f"{ensure_checkpoint_dir(spark)}/curalith/{new_id('tab')}"
    table(spark, sf_dir, "lineitem").select(*shown).write.csv(path, header=True, sep="\t", nullValue="", emptyValue="")
    return read_typed_csv(spark, path, delimiter="\t")


@query(
    """SELECT separator, s_suppkey, s_name || ', "' || separator || '";|' AS label, s_nationkey::BIGINT AS s_nationkey, s_acctbal
    FROM supplier, (VALUES ('comma'), ('semicolon'), ('tab'), ('bar')) named(separator)"""
)
def csv_detected(spark, sf_dir) -> DataFrame:
    """The suppliers through files of four separators, which the scan finds by itself."""
    read = []
    for name, separator in {"comma": ",", "semicolon": ";", "tab": "\t", "bar": "|"}.items():
        label = F.concat("s_name", F.lit(f', "{name}";|')).alias("label")
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", label, "s_nationkey", "s_acctbal")
        path = f"{ensure_checkpoint_dir(spark)}/curalith/{new_id('csv')}"
        suppliers.write.csv(path, header=True, sep=separator, escape='"')
        read.append(read_detected_csv(spark, path).select(F.lit(name).alias("separator"), "*"))
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])
