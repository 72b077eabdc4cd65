"""Queries about review: manifest, adjudication, deliveries, contracts, journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions.common import lookup, strings
from quaycheck.operators import adjudication, contracts, journal, manifest, sla
from quaycheck.plans.queries_runs import FINDINGS, names, run_findings
from quaycheck.plans.registry import query
from quaycheck.plans.twins import RUNS, runs, table

c, lit = F.col, F.lit


def values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows) + ")"


# -- rules and categories --------------------------------------------------------------------

_RAW = """CASE l_returnflag WHEN 'A' THEN 'Header-vs line balance' WHEN 'R' THEN 'g3_ragged_row' ELSE CASE l_linestatus WHEN 'O' THEN '' ELSE 'row check' END END"""
_SAID = "CASE WHEN l_discount >= 0.1 THEN '100% comp' WHEN l_quantity < 2 THEN 'decode error at 3' WHEN l_quantity < 4 THEN 'Net sales vs Tender' ELSE 'other' END"
_RULE = """CASE l_returnflag WHEN 'A' THEN 'G4_FINANCIAL_IMBALANCE' WHEN 'R' THEN 'G3_RAGGED_ROW' ELSE CASE WHEN l_linestatus = 'O' THEN 'UNKNOWN' WHEN l_discount >= 0.1 THEN 'G4_FULL_COMP'
 WHEN l_quantity < 2 THEN 'G1_PHYSICAL_INTEGRITY' WHEN l_quantity < 4 THEN 'G4_FINANCIAL_IMBALANCE' ELSE 'row check' END END"""
_RAW = _RAW.replace("Header-vs line balance", "header_vs line-balance")
_CATEGORY = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.RULE_CATEGORY.items()) + " ELSE 'DATA_QUALITY_BUG' END"


def _ruled(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("*", f"{_RAW} AS raw", f"{_SAID} AS said").withColumn("rule_id", manifest.rule_id(c("raw"), c("said")))


@query("rule_normalize", f"SELECT {_RULE} AS rule_id, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def rule_normalize(spark, sf):
    return _ruled(spark, sf).groupBy("rule_id", "l_returnflag", "l_linestatus").agg(F.count(lit(1)).alias("n"))


@query("rule_category", f"""SELECT rule_id, {_CATEGORY} AS category, rule_id IN ({names(fx.FILE_LEVEL_RULES)}) AS file_level, count(*) AS n FROM (SELECT {_RULE} AS rule_id FROM lineitem) GROUP BY ALL""")
def rule_category(spark, sf):
    rows = _ruled(spark, sf).select("rule_id", manifest.category(c("rule_id")).alias("category"), manifest.is_file_rule(c("rule_id")).alias("file_level"))
    return rows.groupBy("rule_id", "category", "file_level").agg(F.count(lit(1)).alias("n"))


_G = {k: v.replace("'", "''") for k, v in fx.GUIDANCE.items()}
_RUN_RULE = """CASE overall_outcome WHEN 'QUARANTINE_FILE' THEN 'G4_FINANCIAL_IMBALANCE' WHEN 'REJECT_FILE' THEN 'G1_PHYSICAL_INTEGRITY' WHEN 'FLAG' THEN 'G2_ZSCORE_ANOMALY' WHEN 'HOLD_SET' THEN 'G1_UNREGISTERED_ENDPOINT'
 WHEN 'MISSING_DELIVERY' THEN 'G4_FULL_COMP' WHEN 'PASS_OVERRIDDEN' THEN 'G2_OVERLAP_DRIFT' WHEN 'RELEASED_TO_ETL' THEN 'G3_TYPE_CAST_FAIL' ELSE 'G3_UNMAPPED_RVC' END"""


@query("decision_guidance", f"""WITH {RUNS} SELECT run_id, CASE overall_outcome WHEN 'QUARANTINE_FILE' THEN '{_G["revenue"]}' WHEN 'REJECT_FILE' THEN '{_G["physical"]}' WHEN 'FLAG' THEN '{_G["volume"]}' WHEN 'HOLD_SET' THEN '{_G["vendor"]}'
 WHEN 'MISSING_DELIVERY' THEN '{_G["edge"]}' WHEN 'PASS_OVERRIDDEN' THEN '{_G["overlap"]}' WHEN 'RELEASED_TO_ETL' THEN '{_G["quality"]}' ELSE concat('see ', report_type) END AS guidance FROM runs""")
def decision_guidance(spark, sf):
    rows = runs(spark, sf).selectExpr("run_id", "report_type", f"{_RUN_RULE} AS rule_id")
    return rows.select("run_id", manifest.guidance(c("rule_id"), manifest.category(c("rule_id")), lit(False), F.concat(lit("see "), c("report_type"))).alias("guidance"))


# -- manifest --------------------------------------------------------------------------------

_ROWS = "bad AS (SELECT DISTINCT concat('run_', l_orderkey) AS run_id, 'gate_1' AS gate, 'atomic_set' AS rule_name, l_linenumber AS row_no FROM lineitem WHERE l_returnflag = 'R')"


def _bad_rows(spark, sf):
    """Offending rows: returned items of the order behind a run."""
    return table(spark, sf, "lineitem").where(c("l_returnflag") == "R").select(
        F.concat(lit("run_"), c("l_orderkey").cast("string")).alias("run_id"), lit("gate_1").alias("gate"), lit("atomic_set").alias("rule_name"), c("l_linenumber").cast("bigint").alias("row_no"))


_ITEMS = f"""{FINDINGS}, {_ROWS}, cnt AS (SELECT run_id, count(*) AS k FROM bad GROUP BY 1),
 items AS (SELECT f.run_id, f.gate, f.ord, CASE f.rule_name WHEN 'endpoint_registered' THEN 'G1_UNREGISTERED_ENDPOINT' WHEN 'sales_vs_tender_balance' THEN 'G4_FINANCIAL_IMBALANCE' ELSE 'atomic_set' END AS rule_id,
 CASE WHEN f.rule_name = 'atomic_set' THEN coalesce(k, 0) ELSE 0 END AS affected_rows, CASE f.rule_name WHEN 'endpoint_registered' THEN 'VENDOR_CONFIG_CHANGE' WHEN 'sales_vs_tender_balance' THEN 'UNBALANCED_REVENUE' ELSE 'DATA_QUALITY_BUG' END AS suggested_category,
 CASE WHEN f.gate = 'gate_4' THEN concat('Net sales $', net_amount, ' vs Tender payments $0.00 Variance: ', net_amount, '.') ELSE f.message END AS message, NOT (f.rule_name = 'atomic_set' AND coalesce(k, 0) > 0) AS is_file_level
 FROM findings f JOIN runs USING (run_id) LEFT JOIN cnt ON cnt.run_id = f.run_id AND f.rule_name = 'atomic_set' WHERE NOT f.passed AND NOT f.skipped)"""


def _items(spark, sf):
    return manifest.manifest_items(run_findings(spark, sf), _bad_rows(spark, sf), "run_id")


@query("manifest_items", f"WITH {_ITEMS} SELECT * FROM items")
def manifest_items(spark, sf):
    return _items(spark, sf).drop("decision_guidance")


@query("sample_records", f"""WITH {_ROWS}, s AS (SELECT run_id, row_no, row_number() OVER (PARTITION BY run_id ORDER BY row_no) AS sample_no FROM bad)
 SELECT s.run_id, s.row_no::BIGINT AS row_no, sample_no, count(*) AS records, sum(l_partkey)::BIGINT AS parts FROM s JOIN lineitem ON run_id = concat('run_', l_orderkey) AND row_no = l_linenumber WHERE sample_no <= 3 GROUP BY ALL""")
def sample_records(spark, sf):
    data = table(spark, sf, "lineitem").select(F.concat(lit("run_"), c("l_orderkey").cast("string")).alias("run_id"), c("l_linenumber").cast("bigint").alias("row_no"), c("l_partkey").alias("record"))
    samples = manifest.sample_rows(_bad_rows(spark, sf), "run_id")
    return manifest.sample_records(samples, data, "run_id", "record").groupBy("run_id", "row_no", c("sample_no").cast("bigint").alias("sample_no")).agg(
        F.count(lit(1)).alias("records"), F.sum("record").alias("parts"))


_REASON = "CASE WHEN total_read_rows > 300000 THEN 'Tender imbalance' WHEN total_read_rows > 200000 THEN 'high variance' WHEN total_read_rows > 100000 THEN '' ELSE 'see log' END"


@query("manifest_guarantee", f"""WITH {_ITEMS}, r AS (SELECT *, {_REASON} AS reason FROM runs WHERE overall_outcome IN ({names(fx.BLOCKED)}) AND run_id NOT IN (SELECT run_id FROM items WHERE gate = 'gate_4'))
 SELECT run_id, CASE WHEN reason IN ('Tender imbalance', 'high variance') THEN 'G4_FINANCIAL_IMBALANCE' ELSE 'RUN_BLOCKED' END AS rule_id, CASE WHEN reason IN ('Tender imbalance', 'high variance') THEN 'UNBALANCED_REVENUE' ELSE 'DATA_QUALITY_BUG' END AS suggested_category,
 CASE WHEN reason = '' THEN 'Run blocked without detailed sub-check findings.' ELSE reason END AS message FROM r""")
def manifest_guarantee(spark, sf):
    """Blocked runs whose only items would be of gate 1 get one from their reason."""
    blocked = runs(spark, sf).withColumn("outcome_reason", F.expr(_REASON))
    return manifest.guaranteed_items(blocked, _items(spark, sf).where(c("gate") == "gate_4"), "run_id").select("run_id", "rule_id", "suggested_category", "message")


@query("quarantined_rows", f"""WITH {_ITEMS}, i AS (SELECT run_id, sum(affected_rows) AS claimed FROM items GROUP BY 1), s AS (SELECT run_id, count(DISTINCT row_no) AS seen FROM bad GROUP BY 1)
 SELECT coalesce(i.run_id, s.run_id) AS run_id, coalesce(nullif(seen, 0), claimed, 0)::BIGINT AS quarantined_rows FROM i FULL JOIN s ON i.run_id = s.run_id""")
def quarantined_rows(spark, sf):
    return manifest.quarantined_rows(_items(spark, sf), _bad_rows(spark, sf), "run_id")


@query("readiness", f"""WITH {RUNS}, q AS (SELECT concat('run_', l_orderkey) AS run_id, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1), j AS (SELECT run_id, coalesce(total, 0) AS t, coalesce(bad, 0) AS b,
 coalesce(total, 0) = 0 OR overall_outcome IN ('REJECT_FILE', 'QUARANTINE_FILE') AS blocked FROM runs LEFT JOIN q USING (run_id))
 SELECT run_id, t AS total_rows, CASE WHEN blocked THEN 0 ELSE t - b END AS verified_rows, CASE WHEN blocked THEN greatest(t, 1) ELSE b END AS quarantined_rows, CASE WHEN blocked THEN 0.0::DOUBLE ELSE round((t - b) / t * 100.0::DOUBLE, 2) END AS readiness_pct,
 CASE WHEN blocked THEN 100.0::DOUBLE ELSE round(b / t * 100.0::DOUBLE, 2) END AS quarantine_pct FROM j""")
def readiness(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.concat(lit("run_"), c("l_orderkey").cast("string")).alias("run_id")).agg(F.count(lit(1)).alias("total"), F.count_if(c("l_returnflag") == "R").alias("bad"))
    rows = runs(spark, sf).join(counts, "run_id", "left").select("run_id", manifest.readiness(c("total"), c("bad"), c("overall_outcome")).alias("r"))
    return rows.select("run_id", "r.*")


@query("classify_merge", f"""WITH {_ITEMS}, p AS (SELECT concat('run_', l_orderkey) AS run_id, CASE WHEN l_linestatus = 'O' THEN 'G1_UNREGISTERED_ENDPOINT' ELSE 'atomic_set' END AS rule_id, max(l_partkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)
 SELECT items.run_id, items.rule_id, CASE WHEN pos IS NOT NULL THEN CASE WHEN pos % 10 <= 3 THEN 'FALSE_POSITIVE' ELSE 'DATA_QUALITY_BUG' END END AS user_category, CASE WHEN pos IS NOT NULL THEN concat('note ', pos) END AS user_notes FROM items LEFT JOIN p USING (run_id, rule_id)""")
def classify_merge(spark, sf):
    """Items as operator patches: the last one per rule counts."""
    at = c("l_partkey") * 10 + c("l_linenumber")
    patches = table(spark, sf, "lineitem").select(
        F.concat(lit("run_"), c("l_orderkey").cast("string")).alias("run_id"), F.when(c("l_linestatus") == "O", "G1_UNREGISTERED_ENDPOINT").otherwise("atomic_set").alias("rule_id"),
        F.when(c("l_linenumber") <= 3, "FALSE_POSITIVE").otherwise("DATA_QUALITY_BUG").alias("user_category"), F.concat(lit("note "), at.cast("string")).alias("user_notes"), at.alias("at"))
    items = _items(spark, sf).withColumns({"user_category": lit(None).cast("string"), "user_notes": lit(None).cast("string")})
    return manifest.merge_classifications(items, patches, "run_id", "at").select("run_id", "rule_id", "user_category", "user_notes")


@query("failure_highlights", f"""WITH {FINDINGS}, h AS (SELECT run_id, gate, ord, -1 AS pos, concat(gate, '.evaluations[', ord, '].passed/message') AS key, message AS value FROM findings WHERE NOT passed
 UNION ALL SELECT f.run_id, gate, ord, 3, concat(gate, '.evaluations[', ord, '].details.missing_endpoints'), report_type FROM findings f JOIN runs USING (run_id) WHERE rule_name = 'atomic_set' AND NOT skipped
 UNION ALL SELECT f.run_id, gate, ord, 6, concat(gate, '.evaluations[', ord, '].details.variance'), CAST(net_amount AS VARCHAR) FROM findings f JOIN runs USING (run_id) WHERE rule_name = 'sales_vs_tender_balance')
 SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY gate, ord, pos) AS rank, key, value FROM h""")
def failure_highlights(spark, sf):
    return manifest.failure_highlights(run_findings(spark, sf), "run_id").withColumn("rank", c("rank").cast("bigint"))


@query("manifest_rebuild", f"""WITH {RUNS} SELECT run_id, 'gate_1' AS gate, 1 AS ord, 'G1_EMPTY_PAYLOAD' AS rule_id, concat('EMPTY ', report_type) AS message FROM runs WHERE overall_outcome <> 'PASS'""")
def manifest_rebuild(spark, sf):
    """Items out of the stored gate JSON of a run."""
    doc = F.concat(lit('{"gate_1":{"evaluations":[{"rule_name":"filename_regex","passed":true,"message":""},{"rule_name":"non_empty_payload","passed":'), F.when(c("overall_outcome") == "PASS", "true").otherwise("false"),
                   lit(',"message":"EMPTY '), c("report_type"), lit('"},{"rule_name":"x","passed":false,"details":{"skipped":"true"}}]},"s3_path":"k"}'))
    evals = manifest.stored_evaluations(runs(spark, sf).select("run_id", doc.alias("doc")), "run_id", "doc")
    failed = evals.where(~c("passed") & ~c("skipped"))
    return failed.select("run_id", "gate", "ord", manifest.rule_id(c("rule_name"), c("message")).alias("rule_id"), "message")


@query("effective_category", f"""WITH {RUNS} SELECT run_id, CASE WHEN report_type = '5-LOW' THEN 'FALSE_POSITIVE' WHEN overall_outcome = 'FLAG' THEN 'UNBALANCED_REVENUE' WHEN report_type = '4-NOT SPECIFIED' THEN 'DATA_QUALITY_BUG' ELSE 'OVERLAP_DRIFT' END AS category,
 CASE WHEN overall_outcome = 'FLAG' THEN net_amount::DOUBLE END AS left_amount, CASE WHEN overall_outcome = 'FLAG' THEN 1.5::DOUBLE END AS right_amount, CASE WHEN overall_outcome = 'FLAG' THEN abs(net_amount::DOUBLE - 1.5::DOUBLE) END AS variance FROM runs""")
def effective_category(spark, sf):
    message = F.when(c("overall_outcome") == "FLAG", F.concat(lit("Net sales $"), c("net_amount").cast("string"), lit(" vs Tender payments $1.50"))).otherwise("quiet")
    user = F.when(c("report_type") == "5-LOW", "FALSE_POSITIVE")
    cat = manifest.effective_category(user, lit("G9"), message, c("report_type") == "4-NOT SPECIFIED", lit("OVERLAP_DRIFT"))
    rows = runs(spark, sf).select("run_id", cat.alias("category"), manifest.money_in(message).alias("m"))
    return rows.select("run_id", "category", c("m.left").alias("left_amount"), c("m.right").alias("right_amount"), c("m.variance").alias("variance"))


_ACTION = {"1-URGENT": "approve_release", "2-HIGH": "declare_short_release", "3-MEDIUM": "reject_escalate_audit", "4-NOT SPECIFIED": "keep_original", "5-LOW": "copy_bundle"}
_ACTION_ROWS = values([(p, a, *fx.ACTIONS.get(a, ("UNMAPPED_ENTITY", a)), "VENDOR_ESCALATION" if a == "reject_escalate_audit" else "DECISION_REASON",
                        {"approve_release": "RELEASE", "declare_short_release": "DECLARE_SHORT"}.get(a, "NONE")) for p, a in _ACTION.items()])


@query("decision_actions", f"WITH {RUNS} SELECT run_id, user_category, user_notes, note_type, follow_up FROM runs JOIN {_ACTION_ROWS} v(p, a, user_category, user_notes, note_type, follow_up) ON p = report_type")
def decision_actions(spark, sf):
    asked = runs(spark, sf).select("run_id", lookup(_ACTION, c("report_type")).alias("action"), lit("UNMAPPED_ENTITY").alias("suggested_category"))
    return manifest.decide(asked).select("run_id", "user_category", "user_notes", "note_type", "follow_up")


# -- adjudication ----------------------------------------------------------------------------

@query("adjudication_queue", f"WITH {RUNS} SELECT run_id, overall_outcome, business_date FROM runs WHERE overall_outcome IN ({names(fx.BLOCKED)}) ORDER BY created_at DESC, run_id DESC LIMIT 1000")
def adjudication_queue(spark, sf):
    return adjudication.queue(runs(spark, sf), "created_at", "run_id", 1000).select("run_id", "overall_outcome", "business_date")


@query("queue_enriched", f"""WITH {RUNS} SELECT run_id, coalesce(c_name, property_id) AS property_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'Europe/Madrid' WHEN 'MACHINERY' THEN 'Asia/Tokyo' WHEN 'FURNITURE' THEN 'UTC' END AS timezone
 FROM runs LEFT JOIN customer ON property_id = concat('P', c_custkey) AND c_acctbal > 0""")
def queue_enriched(spark, sf):
    zone = F.when(c("c_mktsegment") == "BUILDING", "Europe/Madrid").when(c("c_mktsegment") == "MACHINERY", "Asia/Tokyo").when(c("c_mktsegment") == "FURNITURE", "UTC")
    properties = table(spark, sf, "customer").where(c("c_acctbal") > 0).select(F.concat(lit("P"), c("c_custkey").cast("string")).alias("property_id"), c("c_name"), zone.alias("zone"))
    return adjudication.enrich(runs(spark, sf), properties, "property_id", "c_name", "zone").select("run_id", "property_name", "timezone")


@query("path_coalesce", """SELECT event_id, CASE event_type WHEN 'click' THEN 'own' WHEN 'view' THEN concat('key/', user_id) WHEN 'error' THEN concat('file/', user_id) END AS s3_path FROM events""")
def path_coalesce(spark, sf):
    doc = """CASE event_type WHEN 'view' THEN concat('{"path":"","object_key":"key/', user_id, '"}') WHEN 'error' THEN concat('{"file_identity":{"uri":"file/', user_id, '"}}') ELSE props END"""
    rows = table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_type = 'click' THEN 'own' ELSE '' END AS own", f"{doc} AS doc")
    return rows.select("event_id", adjudication.object_path(c("own"), c("doc")).alias("s3_path"))


@query("adjudication_metrics", f"""WITH {RUNS} SELECT count(*) FILTER (overall_outcome = 'QUARANTINE_FILE') AS active_quarantines, count(*) FILTER (overall_outcome = 'HOLD_SET') AS held_sets, count(*) FILTER (overall_outcome = 'REJECT_FILE') AS rejects,
 count(*) FILTER (overall_outcome = 'MISSING_DELIVERY') AS sla_breaches, count(*) FILTER (overall_outcome = 'PASS_OVERRIDDEN' AND created_at >= TIMESTAMP '2001-07-01') AS overrides_executed_today FROM runs""")
def adjudication_metrics(spark, sf):
    return adjudication.metrics(runs(spark, sf), "created_at", lit("2001-07-02").cast("timestamp"))


def _requests(spark, sf):
    """One override request per order; a wrong property where the order is not finished."""
    return table(spark, sf, "orders").select(
        F.concat(lit("run_"), c("o_orderkey").cast("string")).alias("run_id"), F.concat(lit("P"), (c("o_custkey") + F.when(c("o_orderstatus") == "P", 1).otherwise(0)).cast("string")).alias("property_id"),
        lit("ops").alias("operator_id"), F.col("o_orderpriority").alias("reason"), (c("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("requested_at"))


@query("declare_short", f"""WITH {RUNS} SELECT concat('override_', run_id, '_', strftime(created_at, '%Y%m%d'), 'T010000Z') AS run_id, run_id AS original_run_id, overall_outcome AS original_outcome, concat('DECLARE_SHORT by ops: ', report_type) AS outcome_reason
 FROM runs WHERE overall_outcome IN ('FLAG', 'HOLD_SET')""")
def declare_short(spark, sf):
    return adjudication.declare_short(_requests(spark, sf), runs(spark, sf), "run_id").select("run_id", "original_run_id", "original_outcome", "outcome_reason")


@query("release_runs", f"""WITH {RUNS} SELECT run_id, CASE WHEN overall_outcome = 'RELEASED_TO_ETL' THEN 'ALREADY_RELEASED' WHEN overall_outcome IN ({names(fx.BLOCKED)}) THEN 'RELEASED_TO_ETL' ELSE 'REFUSED' END AS status FROM runs
 UNION ALL SELECT concat('run_x', c_custkey), 'NOT_FOUND' FROM customer""")
def release_runs(spark, sf):
    asked = _requests(spark, sf).select("run_id").unionByName(table(spark, sf, "customer").select(F.concat(lit("run_x"), c("c_custkey").cast("string")).alias("run_id")))
    return adjudication.release(asked, runs(spark, sf), "run_id").select("run_id", "status")


@query("mutation_audit", f"""WITH {RUNS}, n AS (SELECT run_id, CASE report_type WHEN '1-URGENT' THEN 'RELEASED_TO_ETL' WHEN '2-HIGH' THEN 'PASS' ELSE overall_outcome END AS new_outcome FROM runs WHERE report_type <> '5-LOW')
 SELECT runs.run_id, overall_outcome AS old_outcome, new_outcome, CASE WHEN n.run_id IS NULL THEN 'ILLEGAL_DELETE' WHEN new_outcome = 'RELEASED_TO_ETL' AND overall_outcome IN ({names(fx.BLOCKED)}) THEN 'RELEASE'
 WHEN new_outcome = overall_outcome THEN 'UNCHANGED_IDENTITY' ELSE 'ILLEGAL_UPDATE' END AS verdict FROM runs LEFT JOIN n ON n.run_id = runs.run_id""")
def mutation_audit(spark, sf):
    before = runs(spark, sf)
    changed = F.when(c("report_type") == "1-URGENT", "RELEASED_TO_ETL").when(c("report_type") == "2-HIGH", "PASS").otherwise(c("overall_outcome"))
    after = before.where(c("report_type") != "5-LOW").withColumn("overall_outcome", changed)
    return adjudication.mutation_audit(before, after, "run_id")


@query("queue_filters", f"""WITH {RUNS} SELECT run_id, concat('ALL', CASE trim(feed_category) WHEN 'pos' THEN ',POS' WHEN 'PMS' THEN ',PMS' WHEN 'reservations' THEN ',RESERVATIONS' WHEN 'data_lake' THEN ',DATA_LAKE' ELSE '' END) AS feeds,
 concat('ALL', CASE overall_outcome WHEN 'FLAG' THEN ',FLAGGED' WHEN 'PASS' THEN ',RELEASED' WHEN 'PASS_OVERRIDDEN' THEN ',RELEASED' WHEN 'MISSING_DELIVERY' THEN '' ELSE concat(',', overall_outcome) END) AS outcomes FROM runs""")
def queue_filters(spark, sf):
    rows = runs(spark, sf).select("run_id", adjudication.queue_filters(c("overall_outcome"), c("feed_category")).alias("f"))
    return rows.select("run_id", F.array_join("f.feeds", ",").alias("feeds"), F.array_join("f.outcomes", ",").alias("outcomes"))


@query("current_runs", f"WITH {RUNS} SELECT property_id, arg_max(run_id, strftime(created_at, '%Y%m%d') || run_id) AS run_id, count(*) AS events FROM runs GROUP BY 1")
def current_runs(spark, sf):
    events = runs(spark, sf).select("property_id", "run_id", F.concat(F.date_format("created_at", "yyyyMMdd"), "run_id").alias("at"))
    counts = events.groupBy("property_id").agg(F.count(lit(1)).alias("events"))
    return adjudication.current_runs(events, "property_id", "at").join(counts, "property_id").select("property_id", "run_id", "events")


# -- deliveries ------------------------------------------------------------------------------

_ZONES = {"AUTOMOBILE": ("Europe/Madrid", 2), "BUILDING": ("America/New_York", -4), "FURNITURE": ("Asia/Tokyo", 9), "HOUSEHOLD": ("Mars/Olympus", 0), "MACHINERY": ("UTC", 0)}
_NOW = "1999-07-15 08:00:00"
_CUT = "CASE WHEN c_acctbal < 0 THEN 'noon' WHEN c_acctbal < 3000 THEN '07:30' WHEN c_acctbal < 6000 THEN '09:15:30' END"
_SECONDS = "CASE WHEN c_acctbal < 0 THEN 21600 WHEN c_acctbal < 3000 THEN 27000 WHEN c_acctbal < 6000 THEN 33330 ELSE 21600 END"
_GRACE = "CASE WHEN c_acctbal < 0 THEN '-5' WHEN c_acctbal < 5000 THEN '60' END"
_GRACE_MIN = "CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 60 ELSE 30 END"
_SLA = f"""props AS (SELECT c_custkey, c_mktsegment, zone, TIMESTAMP '{_NOW}' + off::INT * INTERVAL 1 HOUR AS local_now, {_SECONDS} AS sec, {_GRACE_MIN} AS mins FROM customer JOIN {values([(s, z if z != "Mars/Olympus" else "UTC", o) for s, (z, o) in _ZONES.items()])} v(seg, zone, off) ON seg = c_mktsegment),
 due AS (SELECT *, local_now::DATE AS business_date, date_trunc('day', local_now) + (sec + mins * 60) * INTERVAL 1 SECOND AS deadline FROM props), dl AS (SELECT *, local_now >= deadline AS past_deadline FROM due)"""


def _properties(spark, sf):
    p = table(spark, sf, "customer").withColumn("tz", lookup({k: z for k, (z, _o) in _ZONES.items()}, c("c_mktsegment"))).selectExpr("c_custkey", "c_mktsegment", "tz", f"{_CUT} AS cutoff", f"{_GRACE} AS grace")
    return sla.with_deadline(p, "tz", "cutoff", "grace", lit(_NOW).cast("timestamp"))


@query("sla_deadline", f"WITH {_SLA} SELECT c_custkey, zone, strftime(local_now, '%Y-%m-%d %H:%M:%S') AS local_now, strftime(deadline, '%Y-%m-%d %H:%M:%S') AS deadline, past_deadline FROM dl")
def sla_deadline(spark, sf):
    t = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
    return _properties(spark, sf).select("c_custkey", "zone", t("local_now"), t("deadline"), "past_deadline")


_NEED = {"AUTOMOBILE": '{"atomic_set":{"required_endpoints":["1-URGENT","2-HIGH"]}}', "BUILDING": '{"atomic_set":{"required_endpoints":[]},"atomic_sets":[{"members":["3-MEDIUM"]}]}',
         "FURNITURE": '{"gate_1":{"required_set_endpoints":["5-LOW"]}}', "HOUSEHOLD": "{}", "MACHINERY": "broken"}
_NEED_LIST = {"AUTOMOBILE": ["1-URGENT", "2-HIGH"], "BUILDING": ["3-MEDIUM"], "FURNITURE": ["5-LOW"]}
_REQ = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in _NEED_LIST.items()) + " ELSE '' END"


@query("sla_required", f"SELECT c_custkey, {_REQ} AS required FROM customer")
def sla_required(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.array_join(sla.required_types(lookup(_NEED, c("c_mktsegment"))), ",").alias("required"))


def _deliveries(spark, sf):
    """Orders as delivered reports, all moved to the day in question by year."""
    day = F.make_date(lit(1999), lit(7), lit(15))
    return table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey"), day.alias("day"), c("o_orderpriority").alias("report_type"),
                                             F.when(c("o_orderstatus") == "F", "PASS").when(c("o_orderstatus") == "O", "FLAG").otherwise("HOLD_SET").alias("overall_outcome"))


@query("sla_delivered", """SELECT o_custkey AS c_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS delivered FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1""")
def sla_delivered(spark, sf):
    return sla.delivered_types(_deliveries(spark, sf), "c_custkey", "day", "report_type").select("c_custkey", F.array_join("delivered", ",").alias("delivered"))


_CHECKED = f"""{_SLA}, got AS (SELECT o_custkey, DATE '1999-07-15' AS day, list(DISTINCT o_orderpriority) AS have FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1),
 chk AS (SELECT dl.*, coalesce(have, []::VARCHAR[]) AS have, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['1-URGENT', '2-HIGH'] WHEN 'BUILDING' THEN ['3-MEDIUM'] WHEN 'FURNITURE' THEN ['5-LOW'] ELSE []::VARCHAR[] END AS need
 FROM dl LEFT JOIN got ON o_custkey = c_custkey AND day = business_date),
 ev AS (SELECT *, CASE WHEN len(need) > 0 THEN array_to_string(list_sort(list_filter(need, lambda x: NOT list_contains(have, x))), ',') WHEN len(have) = 0 THEN '{sla.ANY_DELIVERY}' ELSE '' END AS missing FROM chk),
 events_ AS (SELECT *, CASE WHEN NOT past_deadline THEN 'IN_WINDOW' WHEN missing <> '' THEN 'MISSING_DELIVERY' ELSE 'SATISFIED' END AS event_type FROM ev)"""


def _checked(spark, sf):
    return sla.missing_deliveries(_properties(spark, sf), _deliveries(spark, sf), "c_custkey", "day", "report_type", sla.required_types(lookup(_NEED, c("c_mktsegment"))))


@query("missing_delivery", f"WITH {_CHECKED} SELECT c_custkey, event_type, missing FROM events_")
def missing_delivery(spark, sf):
    return _checked(spark, sf).select("c_custkey", "event_type", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query("sla_summary", f"""WITH {_CHECKED} SELECT count(*) AS checked, count(*) FILTER (past_deadline) AS past_deadline, count(*) FILTER (event_type = 'SATISFIED') AS satisfied, count(*) FILTER (event_type = 'MISSING_DELIVERY') AS missing_delivery_count FROM events_""")
def sla_summary(spark, sf):
    return sla.summary(_checked(spark, sf))


@query("alert_routing", f"""WITH {RUNS}, r AS (SELECT run_id, property_id, overall_outcome, CASE report_type WHEN '1-URGENT' THEN ' https://hook/1 ' ELSE '' END AS hook FROM runs)
 SELECT property_id, overall_outcome AS event_type, run_id AS title, concat('[', overall_outcome, '] ', property_id) AS subject, 'webhook' AS channel, CASE WHEN hook = '' THEN 'https://hook/all' ELSE trim(hook) END AS recipient FROM r
 UNION ALL SELECT property_id, overall_outcome, run_id, concat('[', overall_outcome, '] ', property_id), 'email', m FROM (SELECT *, unnest(['ops@x', property_id || '@x']) AS m FROM r WHERE overall_outcome IN ({names(fx.ALERTED)}))""")
def alert_routing(spark, sf):
    events = runs(spark, sf).withColumnRenamed("overall_outcome", "event_type")
    emails = F.array(lit("ops@x"), F.concat(c("property_id"), lit("@x")))
    return sla.alert_routes(events, "property_id", c("run_id"), emails, F.when(c("report_type") == "1-URGENT", " https://hook/1 ").otherwise(""), "https://hook/all")


# -- contracts -------------------------------------------------------------------------------

_MODE = "CASE WHEN category IN ('lake', 'dwh') THEN 'object' ELSE 'file' END"
_PRESET_OF = list(fx.PRESETS)
_PRESET_SQL = values([(i, k, fx.PRESETS[k]["category"], len(fx.PRESETS[k].get("members", []))) for i, k in enumerate(_PRESET_OF)])


@query("preset_dim", f"SELECT preset_id, category, {_MODE} AS mode, members::INT AS members, count(*) AS properties FROM customer JOIN {_PRESET_SQL} v(i, preset_id, category, members) ON i::INT = c_nationkey % {len(_PRESET_OF)} GROUP BY ALL")
def preset_dim(spark, sf):
    """Properties per preset; every property uses the preset its nation is assigned."""
    chosen = F.element_at(strings(_PRESET_OF), (c("c_nationkey") % len(_PRESET_OF) + 1).cast("int"))
    used = table(spark, sf, "customer").groupBy(chosen.alias("preset_id")).agg(F.count(lit(1)).alias("properties"))
    return used.join(contracts.preset_dim(spark), "preset_id").select("preset_id", "category", contracts.category_mode(c("category")).alias("mode"), F.size("members").alias("members"), "properties")


@query("contract_fallback", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'opera' ELSE 'onesait' END AS system_preset, CASE WHEN s_suppkey IS NULL THEN 'preset_fallback' ELSE 'database' END AS source,
 CASE WHEN s_suppkey IS NOT NULL THEN 9.5::DOUBLE WHEN c_mktsegment = 'BUILDING' THEN 2.5 ELSE 3.0 END AS max_z FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def contract_fallback(spark, sf):
    feeds = table(spark, sf, "customer").select("c_custkey", F.when(c("c_mktsegment") == "BUILDING", "opera").when(c("c_mktsegment") == "MACHINERY", "unheard").otherwise("onesait").alias("preset"))
    published = table(spark, sf, "supplier").select(c("s_suppkey").alias("c_custkey"), lit('{"gate_2":{"max_z_score":9.5}}').alias("doc"))
    out = contracts.with_fallback(feeds, published, ["c_custkey"], "preset", "doc")
    z = F.coalesce(F.get_json_object("contract_doc", "$.gate_2.max_z_score"), F.get_json_object("contract_doc", "$.gates.gate2_anomaly.zscore_threshold"))
    return out.select("c_custkey", "system_preset", "source", z.cast("double").alias("max_z"))


@query("contract_hydrate", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'inline' WHEN c_custkey IS NULL THEN 'unknown_property' WHEN n_nationkey IS NULL THEN 'no_active_contract' ELSE 'active' END AS source,
 CASE WHEN o_orderpriority = '1-URGENT' THEN '{"own":1}' ELSE n_name END AS contract FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3""")
def contract_hydrate(spark, sf):
    asked = table(spark, sf, "orders").select("o_orderkey", c("o_custkey").alias("property_id"), F.when(c("o_orderpriority") == "1-URGENT", '{"own":1}').otherwise("").alias("inline"))
    properties = table(spark, sf, "customer").where(c("c_acctbal") > 0).select(c("c_custkey").alias("property_id"), c("c_nationkey").alias("contract_id"))
    docs = table(spark, sf, "nation").where(c("n_regionkey") < 3).select(c("n_nationkey").alias("contract_id"), c("n_name").alias("doc"))
    return contracts.hydrate(asked, properties, docs, "property_id", "contract_id", "doc", "inline").select("o_orderkey", "source", "contract")


@query("contract_upsert", """SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, epoch_ms(o_orderdate)::HUGEINT * 100000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2""")
def contract_upsert(spark, sf):
    """Finished orders are the stored contracts, the others are changes; the latest per key stays."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"))
    stored, changes = rows.where(c("o_orderstatus") == "F"), rows.where(c("o_orderstatus") != "F")
    return contracts.upsert(stored, changes, ["o_custkey", "o_orderpriority"], "at").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("feed_dedupe", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders)
 SELECT o_custkey, o_orderpriority, o_orderkey FROM f WHERE rn = 1""")
def feed_dedupe(spark, sf):
    feeds = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate", F.when(c("o_orderstatus") == "F", c("o_orderkey")).alias("contract"))
    return contracts.dedupe_feeds(feeds, ["o_custkey", "o_orderpriority"], "contract", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


_VERSION = "CASE o_orderstatus WHEN 'F' THEN concat(' ', CAST(1786501628757 AS BIGINT) + o_orderkey, ' ') WHEN 'O' THEN concat('-', o_orderkey) ELSE '2.0' END"


@query("version_norm", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1786501628757 + o_orderkey WHEN 'O' THEN -o_orderkey ELSE 1000 END AS version,
 strftime(make_timestamp((CASE o_orderstatus WHEN 'F' THEN 1786501628757 + o_orderkey WHEN 'O' THEN -o_orderkey ELSE 1000 END) * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM orders""")
def version_norm(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_VERSION} AS raw")
    token = contracts.version_token(c("raw"), lit(1000).cast("bigint"))
    return rows.select("o_orderkey", token.alias("version"), F.date_format(contracts.version_time(token), "yyyy-MM-dd HH:mm:ss").alias("at"))


_PROFILE = """{"profile_id":"p_ID","profile_version":"1","filename":{"transport":"TRANSPORT","required_groups":[],"pattern":"^(?P<a>xREGEX"},"physical":{"encoding":"utf-8","delimiter":"|","line_ending":"ENDING","compression":"none"},
"row_classification":{"header_rules":[],"footer_rules":[],"ignore_rules":[],"reject_rules":[]},"date_bounds":{"content_date_pattern":"x","date_format":"%Y","floor_date":"2020-01-01"},"atomic_sets":[],
"structure":{"expected_sections":[],"udf":{"slot_pattern":"x","expected_slot_count":1}}EXTRA}"""


@query("profile_lint", """SELECT c_custkey, concat_ws('; ', CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '<root>: unknown owner' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'physical.line_ending: not allowed unix' END,
 CASE WHEN c_acctbal < 0 THEN concat('profile_id: malformed p_-', c_custkey) END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'filename.uri_path_pattern: required by transport' END, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'filename.pattern: invalid pattern' END) AS errors FROM customer""")
def profile_lint(spark, sf):
    """A profile document per customer, with the fault its segment stands for.

    The documents are dealt over all cores: customers are few bytes, so that few tasks read them, and a document is long work.
    """
    seg = lambda s, bad, good: F.when(c("c_mktsegment") == s, bad).otherwise(good)
    doc = lit(_PROFILE)
    for mark, value in (("ID", F.concat(F.when(c("c_acctbal") < 0, "-").otherwise(""), c("c_custkey").cast("string"))), ("TRANSPORT", seg("MACHINERY", "uri_path", "filename")), ("REGEX", seg("FURNITURE", "", ")")),
                        ("ENDING", seg("BUILDING", "unix", "lf")), ("EXTRA", seg("HOUSEHOLD", ',"owner":1', ""))):
        doc = F.replace(doc, lit(mark), value)
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").repartition(4 * spark.sparkContext.defaultParallelism)
    return customers.select("c_custkey", doc.alias("doc")).select("c_custkey", F.array_join(contracts.lint(c("doc")), "; ").alias("errors"))


@query("customer_tree", """SELECT coalesce(CAST(n_nationkey AS VARCHAR), '__unassigned__') AS customer, s_suppkey AS property, coalesce(n, 0) AS feeds FROM (SELECT * FROM nation WHERE n_regionkey <> 2) n
 FULL JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) f ON l_suppkey = s_suppkey WHERE n_nationkey IS NOT NULL OR s_suppkey IS NOT NULL""")
def customer_tree(spark, sf):
    """Nations own suppliers, suppliers have feeds; suppliers of a nation left out have no owner."""
    owners = table(spark, sf, "nation").where(c("n_regionkey") != 2).select(c("n_nationkey").alias("customer"))
    properties = table(spark, sf, "supplier").select(c("s_nationkey").alias("customer"), c("s_suppkey").alias("property"))
    feeds = table(spark, sf, "lineitem").select(c("l_suppkey").alias("property"))
    return contracts.customer_tree(owners, properties, feeds, "customer", "property").select("customer", "property", F.coalesce("feeds", lit(0)).alias("feeds"))


# -- journal ---------------------------------------------------------------------------------

_NOTE = "CASE role WHEN 'user' THEN 'DECISION_REASON' WHEN 'assistant' THEN 'VENDOR_ESCALATION' ELSE 'OPERATOR_NOTE' END"
_IMPACT = "CASE role WHEN 'user' THEN 'LOW' WHEN 'assistant' THEN 'CUSTOMER_NOTIFIED' ELSE 'NONE' END"
_ENTRIES = f"""{RUNS}, entries AS (SELECT conv_id, turn, {_NOTE} AS note_type, {_IMPACT} AS customer_impact, coalesce(property_id, 'UNKNOWN') AS property_id, report_type,
 TIMESTAMP '2001-01-01' + (conv_id * 7 + turn) * INTERVAL 5 HOUR AS created_at FROM conversations LEFT JOIN runs ON order_no = conv_id * 3 AND overall_outcome <> 'PASS')"""


def _entries(spark, sf):
    """Turns of talk are notes on a run."""
    notes = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_NOTE} AS note_type", "concat('run_', conv_id * 3) AS run_id",
                                                         "timestamp_seconds(unix_timestamp(TIMESTAMP '2001-01-01') + (conv_id * 7 + turn) * 18000) AS created_at")
    return journal.project_notes(notes, runs(spark, sf).where(c("overall_outcome") != "PASS"), "run_id")


@query("journal_projection", f"WITH {_ENTRIES} SELECT conv_id, turn, note_type, customer_impact, property_id, report_type FROM entries")
def journal_projection(spark, sf):
    return _entries(spark, sf).select("conv_id", "turn", "note_type", "customer_impact", "property_id", "report_type")


@query("journal_page", f"WITH {_ENTRIES} SELECT conv_id, turn FROM entries WHERE customer_impact IN ('HIGH', 'CUSTOMER_NOTIFIED') ORDER BY created_at DESC, conv_id DESC, turn DESC LIMIT 50 OFFSET 20")
def journal_page(spark, sf):
    where = journal.matches(c("note_type"), c("customer_impact"), "HIGH_IMPACT")
    return journal.page(_entries(spark, sf), where, [c("created_at").desc(), c("conv_id").desc(), c("turn").desc()], 50, 20).select("conv_id", "turn")


@query("journal_by_day", f"WITH {_ENTRIES} SELECT property_id, created_at::DATE AS day, count(*) AS entries FROM entries WHERE note_type = 'DECISION_REASON' GROUP BY 1, 2")
def journal_by_day(spark, sf):
    where = journal.matches(c("note_type"), c("customer_impact"), "DECISION_REASON")
    return journal.by_day(_entries(spark, sf), ["property_id"], "created_at", where).select("property_id", "day", "entries")


