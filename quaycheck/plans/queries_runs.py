"""Queries about runs: history, anomalies, quality, revenue, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions.common import strings
from quaycheck.operators import adjudication, anomaly, outcome, quality, revenue
from quaycheck.plans.registry import query
from quaycheck.plans.twins import DOC_LINES, EVENT_DAYS, RUNS, document_lines, event_days, runs, table

c, lit = F.col, F.lit


def names(values):
    return ", ".join(f"'{v}'" for v in values)


# -- history ---------------------------------------------------------------------------------

@query("history_scope", f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY business_date DESC, run_id DESC) AS age_rank FROM runs WHERE business_date >= DATE '1996-01-01')
 SELECT run_id, property_id, age_rank FROM r WHERE age_rank <= 3""")
def history_scope(spark, sf):
    out = anomaly.history_scope(runs(spark, sf), ["property_id"], "business_date", lit("1996-01-01").cast("date"), 3, "run_id")
    return out.select("run_id", "property_id", c("age_rank").cast("bigint").alias("age_rank"))


_DOC = """CASE event_type WHEN 'click' THEN concat('{"accepted_rows":', user_id, '}') WHEN 'view' THEN concat('{"accepted_rows":"?","row_accounting":{"data_rows":', user_id, '}}')
 WHEN 'error' THEN concat('{"raw_report":{"net_amount":', user_id, ',"payload_hash":"h', user_id, '"}}') ELSE props END"""


@query("metric_coalesce", """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN user_id END AS row_count, CASE WHEN event_type = 'error' THEN concat('h', user_id) END AS checksum,
 CASE WHEN event_type = 'error' THEN user_id::DOUBLE END AS net_amount FROM events""")
def metric_coalesce(spark, sf):
    docs = table(spark, sf, "events").selectExpr("event_id", f"{_DOC} AS doc")
    return docs.select("event_id", anomaly.row_count(c("doc")).alias("row_count"), anomaly.checksum(c("doc")).alias("checksum"), anomaly.net_amount(c("doc")).alias("net_amount"))


# -- anomalies -------------------------------------------------------------------------------

@query("duplicate_payload", """WITH h AS (SELECT lang, sha256(text) AS hash, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1, 2)
 SELECT doc_id, coalesce(n, 0) AS released_runs, n IS NOT NULL AS duplicate FROM documents d LEFT JOIN h ON h.lang = d.lang AND h.hash = sha256(d.text)""")
def duplicate_payload(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    past = docs.join(table(spark, sf, "labels"), "doc_id").withColumn("outcome", F.when(c("quality") == 1, "RELEASED_TO_ETL").otherwise("REJECT_FILE"))
    hashes = anomaly.released_hashes(past, ["lang"], "doc_id", "hash", "outcome")
    return docs.join(hashes, ["lang", "hash"], "left").select("doc_id", F.coalesce("released_runs", lit(0)).alias("released_runs"), c("released_runs").isNotNull().alias("duplicate"))


@query("overlap_drift", f"""WITH {RUNS}, m AS (SELECT *, date_trunc('month', business_date)::DATE AS month FROM runs),
 d AS (SELECT property_id, month, min(checksum_sha256) AS lo, max(checksum_sha256) AS hi, count(*) AS n FROM m WHERE overall_outcome IN ({names(fx.CERTIFIED)}) GROUP BY 1, 2)
 SELECT run_id, coalesce(lo <> checksum_sha256 OR hi <> checksum_sha256, false) AS drifted, coalesce(n, 0) AS certified_runs FROM m LEFT JOIN d USING (property_id, month)""")
def overlap_drift(spark, sf):
    mine = runs(spark, sf).withColumn("month", F.to_date(F.date_trunc("month", "business_date")))
    days = anomaly.certified_days(mine, ["property_id"], "month", "checksum_sha256", "overall_outcome")
    return mine.join(days, ["property_id", "month"], "left").select(
        "run_id", anomaly.drifted(c("checksum_sha256"), c("low_hash"), c("high_hash")).alias("drifted"), F.coalesce("certified_runs", lit(0)).alias("certified_runs"))


@query("frozen_window", f"WITH {RUNS} SELECT run_id, CASE WHEN business_date < DATE '2001-08-01' - 365 THEN 'FROZEN' ELSE 'OPEN' END AS verdict FROM runs")
def frozen_window(spark, sf):
    return runs(spark, sf).select("run_id", anomaly.frozen_verdict(c("business_date"), lit("2001-08-01").cast("date"), lit(365)).alias("verdict"))


def _z_sql(days, by, window, limit, least, extra=""):
    """Textbook form: pair every day with the days of its window."""
    return f"""SELECT {by}, day, n AS baseline_n, CASE WHEN n >= {least} AND sd > 0 THEN round((v - m) / sd, 4) WHEN n >= {least} AND v = m THEN 0 END AS z,
 CASE WHEN n < {least} THEN 'COLD_START' WHEN sd = 0 THEN CASE WHEN v = m THEN 'NORMAL' ELSE 'ANOMALY' END WHEN abs((v - m) / sd) > {limit} THEN 'ANOMALY' ELSE 'NORMAL' END AS verdict
 FROM (SELECT a.{by}, a.day, any_value(a.v) AS v, count(b.v) AS n, avg(b.v) AS m, stddev_pop(b.v) AS sd FROM {days} a LEFT JOIN {days} b ON a.{by} = b.{by} AND b.day >= a.day - {window} AND b.day < a.day {extra} GROUP BY 1, 2)"""


def _scored(days, by, value, limit, least, sums=("n", "s", "ss")):
    n, s, ss = (c(f"base_{x}") for x in sums)
    z = anomaly.z_score(value, n, s, ss)
    warm = (F.coalesce(n, lit(0)) >= least) & (F.abs(z) < float("inf"))
    return days.select(by, "day", F.coalesce(n, lit(0)).alias("baseline_n"), F.when(warm, F.round(z, 4)).alias("z"), anomaly.z_verdict(n, lit(least), z, lit(limit)).alias("verdict"))


@query("zscore_volume", f"WITH {EVENT_DAYS}, d AS (SELECT event_type, day, volume AS v FROM edays) {_z_sql('d', 'event_type', 14, 2.5, 7)}")
def zscore_volume(spark, sf):
    """Back-test form: a range window over day totals."""
    daily = event_days(spark, sf).withColumn("outcome", lit("PASS"))
    days = anomaly.baseline_days(daily, ["event_type"], "day", "volume", None, "outcome")
    return _scored(anomaly.rolling(days, ["event_type"], "day", 14), "event_type", c("s").cast("double"), 2.5, 7)


_ORDER_DAYS = "od AS (SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,2))) AS amount FROM orders GROUP BY 1, 2)"


def _order_days(spark, sf):
    o = table(spark, sf, "orders").select(c("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day"), revenue.cents(c("o_totalprice")).alias("price"))
    return o.groupBy("priority", "day").agg(F.count(lit(1)).alias("n_runs"), F.sum("price").alias("amount")).withColumn("outcome", lit("FLAG"))


@query("zscore_dow", f"WITH {_ORDER_DAYS}, d AS (SELECT priority, day, n AS v, isodow(day) AS wd FROM od) {_z_sql('d', 'priority', 84, 2.01, 5, 'AND a.wd = b.wd')}")
def zscore_dow(spark, sf):
    days = anomaly.baseline_days(_order_days(spark, sf), ["priority"], "day", "n_runs", None, "outcome")
    return _scored(anomaly.rolling(days, ["priority"], "day", 84, same_weekday=True), "priority", c("s").cast("double"), 2.01, 5)


@query("zscore_amount", f"WITH {_ORDER_DAYS}, d AS (SELECT priority, day, (amount * 100)::DOUBLE AS v FROM od) {_z_sql('d', 'priority', 30, 3.0, 7)}")
def zscore_amount(spark, sf):
    """Current-batch form: every (priority, day) asks for its own baseline."""
    daily = _order_days(spark, sf)
    days = anomaly.baseline_days(daily, ["priority"], "day", "n_runs", "amount", "outcome")
    asked = daily.select("priority", "day")
    base = anomaly.baseline_for(asked, days, ["priority"], "day", lit(30), lit(False), ("an", "asum", "ass"))
    joined = daily.join(base, ["priority", "day"], "left")
    return _scored(joined, "priority", F.round(c("amount") * 100).cast("double"), 3.0, 7, ("an", "asum", "ass"))


# -- quality ---------------------------------------------------------------------------------

@query("required_columns", "SELECT event_id, CASE event_type WHEN 'click' THEN 'session' ELSE '' END AS missing FROM events")
def required_columns(spark, sf):
    need = F.when(c("event_type") == "click", strings(["k", "session"])).otherwise(strings(["k"]))
    return table(spark, sf, "events").select("event_id", F.array_join(quality.missing_columns(need, F.json_object_keys("props")), ",").alias("missing"))


@query("non_null", """WITH j AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
 SELECT lang, 'quality' AS "column", count(*) FILTER (quality IS NULL) AS null_rows FROM j GROUP BY 1 UNION ALL SELECT lang, 'text', count(*) FILTER (text IS NULL) FROM j GROUP BY 1
 UNION ALL SELECT lang, 'toxic', count(*) FILTER (toxic IS NULL) FROM j GROUP BY 1""")
def non_null(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return quality.null_counts(rows, ["quality", "text", "toxic"], "lang")


_AMOUNT = "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN concat('ERR', o_custkey) WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE CAST(o_totalprice AS STRING) END"


@query("numeric_poison", """SELECT o_orderkey, 'numeric_column_integrity' AS rule, 'amount' AS "column", concat('ERR', o_custkey) AS value FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P'
 UNION ALL SELECT o_orderkey, 'non_null_constraints', 'amount', NULL FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""")
def numeric_poison(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_AMOUNT} AS amount")
    return quality.violations(rows, ["o_orderkey"], [("numeric_column_integrity", "amount", quality.is_poison(c("amount")), c("amount")), ("non_null_constraints", "amount", c("amount").isNull(), c("amount"))])


@query("range_bounds", """SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity < 2) AS below_min, count(*) FILTER (l_quantity > 45) AS above_max FROM lineitem
 UNION ALL SELECT 'l_discount', 0, count(*) FILTER (l_discount > 0.08) FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax < 0.01), 0 FROM lineitem""")
def range_bounds(spark, sf):
    return quality.range_counts(table(spark, sf, "lineitem"), [("l_quantity", 2, 45), ("l_discount", None, 0.08), ("l_tax", 0.01, None)])


@query("empty_frame", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def empty_frame(spark, sf):
    files = table(spark, sf, "orders").select("o_orderkey")
    return quality.files_without_rows(files, table(spark, sf, "lineitem").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("ragged_rows", f"""WITH {DOC_LINES} SELECT doc_id, 'G3_RAGGED_ROW' AS rule, 'line' AS "column", count(*) AS failing_rows FROM dlines WHERE contains(line, '|') GROUP BY 1""")
def ragged_rows(spark, sf):
    from quaycheck.operators import lines

    ragged = lines.field_count(c("line"), lit("|")) > 1
    found = quality.violations(document_lines(spark, sf), ["doc_id", "line_no"], [("G3_RAGGED_ROW", "line", ragged, c("line"))])
    return quality.violation_counts(found, "doc_id")


@query("unmapped_entity", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmapped_entity(spark, sf):
    return quality.without_entity(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])


# -- revenue ---------------------------------------------------------------------------------

_PRICE, _DISC, _TAX = ("CAST(CAST(l_{} AS STRING) AS DECIMAL(18,2))".format(x) for x in ("extendedprice", "discount", "tax"))
_LINE = f"CAST(({_PRICE} * (1 - {_DISC})) AS DECIMAL(18,2))"
_TAXED = f"CAST(({_PRICE} * {_TAX}) AS DECIMAL(18,2))"


@query("cents", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, sum(CAST(CAST({_PRICE} * (1 - {_DISC}) AS DECIMAL(18,2)) * 100 AS BIGINT))::BIGINT AS net_cents, count(*) AS items FROM lineitem GROUP BY ALL""")
def cents(spark, sf):
    net = revenue.cents((c("l_extendedprice").cast("decimal(18,2)") * (lit(1) - c("l_discount").cast("decimal(18,2)"))).cast("string"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(
        F.sum((net * 100).cast("bigint")).alias("net_cents"), F.count(lit(1)).alias("items"))


@query("alias_resolve", """SELECT l_returnflag, l_linestatus, CASE l_returnflag WHEN 'A' THEN 'amount' WHEN 'N' THEN 'line_total' END AS line_column, CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END AS present, count(*) AS n
 FROM lineitem GROUP BY ALL""")
def alias_resolve(spark, sf):
    header = F.when(c("l_returnflag") == "A", strings(["id", "amount", "net_sales"])).when(c("l_returnflag") == "N", strings(["line_total", "net_sales"])).otherwise(strings(["sales_amount"]))
    line = revenue.first_alias(header, strings(fx.LINE_AMOUNT_COLUMNS))
    sales = F.size(revenue.aliases_present(header, strings(fx.NET_SALES_COLUMNS)))
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", line.alias("line_column"), sales.alias("present")).groupBy(
        "l_returnflag", "l_linestatus", "line_column", "present").agg(F.count(lit(1)).alias("n"))


def _items(spark, sf):
    """Order items with their amounts in cents, as decimals."""
    d = lambda n: c(n).cast("decimal(18,2)")
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("order_no"), "l_linenumber", (d("l_extendedprice") * (lit(1) - d("l_discount"))).cast("decimal(18,2)").alias("amount"),
        (d("l_extendedprice") * d("l_tax")).cast("decimal(18,2)").alias("tax"))


@query("revenue_sums", f"SELECT l_orderkey AS order_no, sum({_LINE})::DOUBLE AS line_part, sum({_LINE} + {_TAXED})::DOUBLE AS line_sum FROM lineitem GROUP BY 1")
def revenue_sums(spark, sf):
    cells = F.create_map(lit("amount"), c("amount").cast("string"), lit("tax"), c("tax").cast("string"))
    rows = _items(spark, sf).select("order_no", cells.alias("cells"))
    part = lambda aliases: F.sum(revenue.row_sum(c("cells"), aliases)).cast("double")
    return rows.groupBy("order_no").agg(part(strings(["line_item_amount", "amount"])).alias("line_part"), part(strings(["amount", "tax"])).alias("line_sum"))


@query("header_total", f"""SELECT l_orderkey AS order_no, (min(l_linenumber * 1000000000000 + CAST({_PRICE} * 100 AS BIGINT)) % 1000000000000 / 100.0)::DOUBLE AS header_total FROM lineitem GROUP BY 1""")
def header_total(spark, sf):
    """First amount in row order; equal row numbers fall back on the smaller amount."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.create_map(lit("check_total"), c("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("cells"))
    row_no = c("l_linenumber").cast("bigint") * 1_000_000_000_000 + (revenue.cents(c("cells")["check_total"]) * 100).cast("bigint")
    value, order = revenue.first_number(c("cells"), strings(["grand_total", "check_total"]), row_no)
    order = order - lit(1 << 48)
    return rows.groupBy(c("l_orderkey").alias("order_no")).agg(F.min_by(value, order).cast("double").alias("header_total"))


@query("header_vs_line", f"""WITH s AS (SELECT l_orderkey, sum({_LINE} + {_TAXED}) AS line_sum FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS order_no, CAST(CAST(o_totalprice AS STRING) AS DECIMAL(18,2)) AS total, line_sum FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
 SELECT order_no, total::DOUBLE AS header_total, line_sum::DOUBLE AS line_sum, abs(total - line_sum)::DOUBLE AS variance, CASE WHEN line_sum IS NULL THEN 'SKIPPED' WHEN abs(total - line_sum) <= 50000 THEN 'BALANCED' ELSE 'IMBALANCED' END AS verdict FROM t""")
def header_vs_line(spark, sf):
    """Order total against the sum of its items, within a wide tolerance so that both verdicts occur."""
    sums = _items(spark, sf).groupBy("order_no").agg(F.sum(c("amount") + c("tax")).alias("line_sum"))
    orders = table(spark, sf, "orders").select(c("o_orderkey").alias("order_no"), revenue.cents(c("o_totalprice")).alias("header_total"))
    joined = orders.join(sums, "order_no", "left")
    return joined.select("order_no", c("header_total").cast("double").alias("header_total"), c("line_sum").cast("double").alias("line_sum"),
                         revenue.variance(c("header_total"), c("line_sum")).cast("double").alias("variance"), revenue.balance_verdict(c("header_total"), c("line_sum"), lit(50000.0)).alias("verdict"))


_T = "CAST(CAST(o_totalprice AS STRING) AS DECIMAL(18,2))"
_SHIFT = "CASE WHEN o_orderpriority = '1-URGENT' THEN 0.03 WHEN o_orderpriority = '2-HIGH' THEN 0.02 ELSE 0 END"


@query("sales_vs_tender", f"""SELECT o_orderkey AS order_no, CASE WHEN o_orderpriority = '1-URGENT' THEN 'IMBALANCED' WHEN o_orderpriority = '5-LOW' THEN 'SKIPPED' ELSE 'BALANCED' END AS verdict,
 CASE WHEN o_orderpriority = '1-URGENT' THEN concat('Financial imbalance detected: Net sales $', {_T}, ' vs Tender payments $', {_T} - 0.03, '. Variance: 0.03.') END AS message FROM orders""")
def sales_vs_tender(spark, sf):
    """Every total is paid in three parts by three tenders; some parts lose cents on the way."""
    third = "CAST(floor(total * 100 / 3) / 100 AS DECIMAL(18,2))"
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS order_no", "o_orderpriority", f"{_T} AS total", f"CAST({_SHIFT} AS DECIMAL(18,2)) AS lost")
    parts = o.selectExpr("order_no", f"inline(array(struct('CASH' AS tender, {third} AS paid), struct('CARD' AS tender, {third} AS paid), struct('ROOM' AS tender, total - 2 * {third} - lost AS paid)))")
    paid = parts.groupBy("order_no").agg(F.sum("paid").alias("paid"))
    net, tender = c("total"), F.when(c("o_orderpriority") != "5-LOW", c("paid"))
    verdict = revenue.balance_verdict(net, tender, lit(0.02))
    return o.join(paid, "order_no").select("order_no", verdict.alias("verdict"), F.when(verdict == "IMBALANCED", revenue.imbalance_message("Net sales", net, "Tender payments", tender)).alias("message"))


@query("business_edges", """SELECT l_orderkey, count(*) FILTER (l_extendedprice > 0 AND l_quantity - 1 = 0) AS zero_cover, count(*) FILTER (l_discount >= 0.1) AS full_comp FROM lineitem GROUP BY 1""")
def business_edges(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(revenue.zero_cover(c("l_extendedprice"), c("l_quantity") - 1)).alias("zero_cover"), F.count_if(revenue.full_comp(lit(0.1), c("l_discount"))).alias("full_comp"))


# -- outcomes --------------------------------------------------------------------------------

_RANKED = {"gate": fx.GATE_RANK, "shell": fx.SHELL_RANK}


def _worst_sql(ranks):
    by = " ".join(f"WHEN '{o}' THEN {r}" for o, r in ranks.items())
    back = " ".join(f"WHEN {r} THEN '{o}'" for o, r in ranks.items())
    return f"CASE coalesce(max(CASE overall_outcome {by} END), 0) {back} END"


@query("overall_outcome", f"WITH {RUNS} SELECT property_id, {_worst_sql(fx.GATE_RANK)} AS gate, {_worst_sql(fx.SHELL_RANK)} AS shell FROM runs GROUP BY 1")
def overall_outcome(spark, sf):
    return runs(spark, sf).groupBy("property_id").agg(*[outcome.worst_of_group(c("overall_outcome"), r).alias(n) for n, r in _RANKED.items()])


def _checks(spark, sf):
    """An order as a file: facts for the ladders."""
    counts = table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count(lit(1)).alias("items"))
    return table(spark, sf, "orders").join(counts, "o_orderkey", "left").withColumn("items", F.coalesce("items", lit(0)))


_FACTS = "f AS (SELECT o.*, coalesce(items, 0) AS items FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1) i ON l_orderkey = o_orderkey)"


def _ladder(spark, sf, rungs):
    rows = outcome.with_ladder(_checks(spark, sf), "e", rungs)
    first = outcome.first_failure(c("e"))
    return rows.select("o_orderkey", outcome.ladder_outcome(c("e")).alias("outcome"), first["rule_name"].alias("failed_rule"), F.size("e").alias("listed"),
                       F.size(F.filter("e", lambda x: x["skipped"])).alias("skipped"))


def _msg(text):
    return lit(text)


@query("gate1_ladder", f"""WITH {_FACTS} SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'QUARANTINE_FILE' WHEN o_orderstatus = 'P' THEN 'REJECT_FILE' WHEN items > 5 THEN 'QUARANTINE_FILE' WHEN items = 0 THEN 'QUARANTINE_FILE'
 WHEN o_orderpriority = '1-URGENT' THEN 'HOLD_SET' ELSE 'PASS' END AS outcome, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'noise_filter' WHEN o_orderstatus = 'P' THEN 'physical_integrity' WHEN items > 5 THEN 'line_conservation'
 WHEN items = 0 THEN 'non_empty_payload' WHEN o_orderpriority = '1-URGENT' THEN 'atomic_set' END AS failed_rule, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 1 ELSE 5 END AS listed,
 CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN 3 ELSE 0 END AS skipped FROM f""")
def gate1_ladder(spark, sf):
    noisy = (c("o_orderstatus") == "P") & (c("o_orderpriority") == "5-LOW")
    return _ladder(spark, sf, [
        outcome.Rung("noise_filter", ~noisy, "QUARANTINE_FILE", _msg("noise"), quiet=True, final=True),
        outcome.Rung("filename_regex", c("o_totalprice") > 0, "QUARANTINE_FILE", _msg("name")),
        outcome.Rung("physical_integrity", c("o_orderstatus") != "P", "REJECT_FILE", _msg("bytes")),
        outcome.Rung("line_conservation", c("items") <= 5, "QUARANTINE_FILE", _msg("lines"), stop=False),
        outcome.Rung("non_empty_payload", c("items") > 0, "QUARANTINE_FILE", _msg("empty"), stop=False),
        outcome.Rung("atomic_set", c("o_orderpriority") != "1-URGENT", "HOLD_SET", _msg("set"), stop=False),
    ])


@query("object_ladder", f"""WITH {_FACTS}, g AS (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN 1 WHEN o_orderstatus = 'P' THEN 2 WHEN items > 5 THEN 3 WHEN items = 0 THEN 4 ELSE 5 END AS k FROM f)
 SELECT o_orderkey, CASE k WHEN 1 THEN CASE WHEN o_orderstatus = 'F' THEN 'QUARANTINE_FILE' ELSE 'REJECT_FILE' END WHEN 2 THEN 'HOLD_SET' WHEN 3 THEN 'QUARANTINE_FILE' WHEN 4 THEN 'REJECT_FILE' ELSE 'PASS' END AS outcome,
 CASE k WHEN 1 THEN 'partition_path' WHEN 2 THEN 'commit_marker' WHEN 3 THEN 'watermark' WHEN 4 THEN 'object_payload' END AS failed_rule, 4 AS listed, CASE WHEN k <= 4 THEN 4 - k ELSE 0 END AS skipped FROM g""")
def object_ladder(spark, sf):
    route = F.when(c("o_orderstatus") == "F", "QUARANTINE_FILE").otherwise("REJECT_FILE")
    return _ladder(spark, sf, [
        outcome.Rung("partition_path", c("o_orderpriority") != "5-LOW", route, _msg("path")), outcome.Rung("commit_marker", c("o_orderstatus") != "P", "HOLD_SET", _msg("marker")),
        outcome.Rung("watermark", c("items") <= 5, "QUARANTINE_FILE", _msg("watermark")), outcome.Rung("object_payload", c("items") > 0, "REJECT_FILE", _msg("payload"))])


@query("shell_ladder", f"""WITH {_FACTS}, x AS (SELECT o_orderkey, unnest([{{'ord': 1, 'bad': o_orderpriority = '5-LOW'}}, {{'ord': 2, 'bad': o_orderstatus = 'P'}}, {{'ord': 3, 'bad': items > 5}}, {{'ord': 4, 'bad': items = 0}}]) AS r FROM f)
 SELECT o_orderkey, min(r.ord) FILTER (r.bad) AS failed_at, count(*) AS checks, count(*) FILTER (r.bad) AS failures FROM x GROUP BY 1""")
def shell_ladder(spark, sf):
    """The long form: one row per check, the first failure by an aggregate."""
    bad = [c("o_orderpriority") == "5-LOW", c("o_orderstatus") == "P", c("items") > 5, c("items") == 0]
    rows = _checks(spark, sf).select("o_orderkey", F.inline(F.array(*[F.struct(lit(i + 1).alias("ord"), (~b).alias("passed")) for i, b in enumerate(bad)])))
    return outcome.ladder_from_rows(rows, "o_orderkey", "ord", "passed")


@query("gate2_skip", f"WITH {RUNS} SELECT overall_outcome, overall_outcome IN ('REJECT_FILE', 'QUARANTINE_FILE') AS skipped, count(*) AS n FROM runs GROUP BY ALL")
def gate2_skip(spark, sf):
    return runs(spark, sf).select("overall_outcome", outcome.skip_gate_two(c("overall_outcome")).alias("skipped")).groupBy("overall_outcome", "skipped").agg(F.count(lit(1)).alias("n"))


@query("outcome_reason", f"""WITH {RUNS} SELECT run_id, CASE WHEN overall_outcome = 'PASS' AND total_read_rows <= 200000 THEN 'All gates passed.' ELSE concat_ws('; ', CASE WHEN overall_outcome <> 'PASS' THEN concat('G1: ', overall_outcome) END,
 CASE WHEN total_read_rows > 200000 THEN 'G4: large' END) END AS reason FROM runs""")
def outcome_reason(spark, sf):
    four = F.when(c("total_read_rows") > 200000, "FLAG").otherwise("PASS")
    return runs(spark, sf).select("run_id", outcome.gate_reason([("G1", c("overall_outcome"), c("overall_outcome")), ("G4", four, lit("large"))], "All gates passed.").alias("reason"))


def _stored_runs(spark, sf):
    """Runs with the evaluations of two gates as arrays."""
    out = ["QUARANTINE_FILE", "REJECT_FILE"]
    one = [
        outcome.Rung("endpoint_registered", ~c("overall_outcome").isin(out), c("overall_outcome"), F.concat(lit("UNREGISTERED_ENDPOINT: "), c("report_type"))),
        outcome.Rung("atomic_set", c("overall_outcome") != "HOLD_SET", "HOLD_SET", lit("HOLD_SET: waiting"), stop=False, info={"missing_endpoints": c("report_type")})]
    said = F.concat(lit("Net sales $"), c("net_amount").cast("string"), lit(" vs Tender payments $0.00."))
    four = [outcome.Rung("sales_vs_tender_balance", c("overall_outcome") != "FLAG", "FLAG", said, stop=False, info={"variance": c("net_amount")})]
    return outcome.with_ladder(outcome.with_ladder(runs(spark, sf), "g1", one), "g4", four)


def run_findings(spark, sf):
    return outcome.flat_findings(_stored_runs(spark, sf), ["run_id"], [("gate_1", "g1"), ("gate_4", "g4")])


FINDINGS = f"""{RUNS}, findings AS (SELECT run_id, 'gate_1' AS gate, 0 AS ord, 'endpoint_registered' AS rule_name, overall_outcome NOT IN ('QUARANTINE_FILE', 'REJECT_FILE') AS passed, false AS skipped, concat('UNREGISTERED_ENDPOINT: ', report_type) AS message FROM runs
 UNION ALL SELECT run_id, 'gate_1', 1, 'atomic_set', overall_outcome <> 'HOLD_SET', overall_outcome IN ('QUARANTINE_FILE', 'REJECT_FILE'), CASE WHEN overall_outcome IN ('QUARANTINE_FILE', 'REJECT_FILE') THEN 'Skipped after prior failure.' ELSE 'HOLD_SET: waiting' END FROM runs
 UNION ALL SELECT run_id, 'gate_4', 0, 'sales_vs_tender_balance', overall_outcome <> 'FLAG', false, concat('Net sales $', net_amount, ' vs Tender payments $0.00.') FROM runs)"""


@query("findings_flat", f"WITH {FINDINGS} SELECT * FROM findings")
def findings_flat(spark, sf):
    return run_findings(spark, sf).drop("details")


@query("run_report_rows", f"""WITH {RUNS} SELECT run_id, property_id, report_type, business_date, CAST(isodow(business_date) - 1 AS VARCHAR) AS day_of_week, overall_outcome, checksum_sha256,
 concat('{{"total_rows":', total_read_rows, '}}') AS readiness_stats FROM runs""")
def run_report_rows(spark, sf):
    return runs(spark, sf).select("run_id", "property_id", "report_type", "business_date", F.weekday("business_date").cast("string").alias("day_of_week"), "overall_outcome", "checksum_sha256",
                                  F.to_json(F.struct(c("total_read_rows").alias("total_rows"))).alias("readiness_stats"))


@query("redrive", f"WITH {RUNS} SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT order_no FROM runs WHERE overall_outcome IN ({names(fx.BLOCKED)}))")
def redrive(spark, sf):
    asked = runs(spark, sf).where(c("overall_outcome").isin(fx.BLOCKED)).select(c("order_no").alias("l_orderkey"))
    return adjudication.redrive_inputs(asked, table(spark, sf, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")
