"""The given tables seen as landed files, lines and runs, in Spark and in SQL.

Each twin is a projection of whole tables, stated twice so that results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- runs: one order is one stored run -------------------------------------------------------

OUTCOME = """CASE o_orderstatus || substr(o_orderpriority, 1, 1)
 WHEN 'F3' THEN 'PASS_OVERRIDDEN' WHEN 'F4' THEN 'RELEASED_TO_ETL' WHEN 'O1' THEN 'FLAG' WHEN 'O2' THEN 'FLAG'
 WHEN 'O3' THEN 'HOLD_SET' WHEN 'O4' THEN 'HOLD_SET' WHEN 'O5' THEN 'MISSING_DELIVERY' WHEN 'P1' THEN 'QUARANTINE_FILE'
 WHEN 'P2' THEN 'REJECT_FILE' WHEN 'P3' THEN 'QUARANTINE_FILE' WHEN 'P4' THEN 'REJECT_FILE' WHEN 'P5' THEN 'QUARANTINE_FILE'
 ELSE 'PASS' END"""
FEED = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pos' WHEN '2' THEN ' PMS' WHEN '3' THEN 'reservations'
 WHEN '4' THEN 'data_lake' ELSE 'other' END"""
CENTS = "CAST(CAST(o_totalprice AS STRING) AS DECIMAL(18,2))"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS order_no", "concat('run_', o_orderkey) AS run_id", "concat('P', o_custkey) AS property_id",
        "o_orderpriority AS report_type", "to_date(o_orderdate) AS business_date", "o_orderdate AS created_at",
        f"{OUTCOME} AS overall_outcome", f"{FEED} AS feed_category", "CAST(floor(o_totalprice) AS BIGINT) AS total_read_rows",
        f"sha2(concat(o_custkey, '|', {CENTS}), 256) AS checksum_sha256", f"{CENTS} AS net_amount")


RUNS = f"""runs AS (SELECT o_orderkey AS order_no, concat('run_', o_orderkey) AS run_id, concat('P', o_custkey) AS property_id,
 o_orderpriority AS report_type, CAST(o_orderdate AS DATE) AS business_date, o_orderdate AS created_at,
 {OUTCOME} AS overall_outcome, {FEED} AS feed_category, CAST(floor(o_totalprice) AS BIGINT) AS total_read_rows,
 sha256(concat(o_custkey, '|', {CENTS})) AS checksum_sha256, {CENTS} AS net_amount FROM orders)"""


# -- order files: an order's header, its items and a trailer as physical lines ---------------

ITEM = """CASE WHEN l_returnflag = 'R' THEN concat('ERR|', l_partkey)
 WHEN l_returnflag = 'A' THEN concat('DAT|', {day}, '|', l_linestatus, '|', CAST(l_quantity AS INT), '|UDF0', l_linenumber, '=x|')
 WHEN l_linestatus = 'O' THEN concat('#|', l_suppkey) ELSE concat('TAX|', {day}) END"""
HEAD = "concat('HDR|FILE|shop|', o_orderpriority, '|P', o_custkey, '|', {day}, '|')"
TAIL = "concat('TRL|COUNT|', CAST(floor(o_totalprice / 60000) AS INT), '|')"


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, line_no, line). The parts are unioned; no order is gathered anywhere."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    head = HEAD.format(day="date_format(o_orderdate, 'yyyy-MM-dd')")
    item = ITEM.format(day="date_format(l_shipdate, 'yyyy-MM-dd')")
    ends = orders.selectExpr("o_orderkey AS file_id", f"inline(array(struct(0L AS line_no, {head} AS line), struct(1000000L AS line_no, {TAIL} AS line)))")
    return ends.unionByName(items.selectExpr("l_orderkey AS file_id", "CAST(l_linenumber AS BIGINT) AS line_no", f"{item} AS line"))


ORDER_LINES = f"""olines AS (SELECT o_orderkey AS file_id, 0 AS line_no, {HEAD.format(day="strftime(o_orderdate, '%Y-%m-%d')")} AS line FROM orders
 UNION ALL SELECT o_orderkey, 1000000, {TAIL} FROM orders
 UNION ALL SELECT l_orderkey, l_linenumber, {ITEM.format(day="strftime(l_shipdate, '%Y-%m-%d')")} FROM lineitem)"""
HDR, TRL, IGN, REJ = r"^HDR\|FILE\|", r"^TRL\|COUNT\|(\d+)", r"^#\|", r"^ERR\|"


# -- document lines --------------------------------------------------------------------------

def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    from quaycheck.operators import lines

    return lines.explode_lines(table(spark, sf, "documents"), lines.split_any(F.col("text")), "doc_id", "lang", "source")


DOC_LINES = r"""dl0 AS (SELECT doc_id, lang, source, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS line,
 generate_subscripts(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)), 1) - 1 AS line_no FROM documents WHERE text <> ''),
 dlines AS (SELECT * FROM dl0)"""


# -- days of activity ------------------------------------------------------------------------

def event_days(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and day: a feed's daily volume."""
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("volume"))


EVENT_DAYS = "edays AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS volume FROM events GROUP BY 1, 2)"
