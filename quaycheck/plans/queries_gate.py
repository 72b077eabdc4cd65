"""Queries of the whole gate: every document is a landed file, every good one a released run of an earlier day."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.operators import anomaly, contracts
from quaycheck.plans import gate
from quaycheck.plans.queries_runs import names
from quaycheck.plans.registry import query
from quaycheck.plans.twins import RUNS, runs, table

c, lit = F.col, F.lit

CONTRACT = {"feed_category": "texts", "filename": {"pattern": r"^(?P<report_type>[a-z]+)@(?P<property>[A-Za-z]+)@(?P<date>\d{8})@\d+\.txt$", "path_agree": False},
            "file_format": {"encoding": "utf-8", "delimiter": "\x1f"}}
_TEXT, _LANG = "coalesce(text, '')", "coalesce(nullif(lang, ''), 'xx')"
_NAME = f"concat('text@', {_LANG}, '@', {{day}}, '@', doc_id, '.txt')"


def landed(spark, sf):
    """A document's text as the payload of a file of its language and of one of five days."""
    day = "date_format(date_sub(DATE '2025-02-10', CAST(pmod(doc_id, 5) AS INT)), 'yyyyMMdd')"
    return table(spark, sf, "documents").where("doc_id IS NOT NULL").selectExpr(
        "CAST(doc_id AS STRING) AS file_id", "CAST(doc_id AS STRING) AS batch_id", f"{_LANG} AS property_id", "substr(concat('texts', doc_id), 1, 5) AS contract_id",
        f"{_NAME.format(day=day)} AS filename", "CAST(NULL AS STRING) AS path", f"encode({_TEXT}, 'UTF-8') AS content")


def released(spark, sf):
    """Documents labelled good, as runs released a week before; they have no row counts, so no baseline."""
    good = table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return good.selectExpr("concat('run_', doc_id) AS run_id", f"{_LANG} AS property_id", "substr(concat('text', doc_id), 1, 4) AS report_type", "date_add(DATE '2025-02-01', length(substr(concat('t', doc_id), 1, 1)) - 1) AS business_date", "'RELEASED_TO_ETL' AS overall_outcome",
                           f"sha2({_TEXT}, 256) AS checksum_sha256", "CAST(NULL AS BIGINT) AS row_count", "CAST(NULL AS DOUBLE) AS net_amount")


def evaluated(spark, sf):
    doc = spark.createDataFrame([("texts", json.dumps(CONTRACT))], "contract_id string, doc string")
    return gate.evaluate(landed(spark, sf), contracts.normalise(doc, "contract_id", "doc"), released(spark, sf), lit("2025-02-11").cast("date"))


_BODY = r"regexp_replace(t, '(\r\n|\n|\r)$', '')"
_LANDED = f"""f AS (SELECT doc_id, {_LANG} AS lang, {_TEXT} AS t FROM documents WHERE doc_id IS NOT NULL),
 l AS (SELECT *, octet_length(encode(t)) AS bytes, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array({_BODY}, '\\r\\n|\\r|\\n')) END AS n, CASE WHEN t = '' THEN repeat('0', 64) ELSE sha256(t) END AS hash,
  {_NAME.format(day="strftime(DATE '2025-02-10' - CAST(((doc_id % 5) + 5) % 5 AS INT), '%Y%m%d')")} AS name FROM f),
 h AS (SELECT DISTINCT {_LANG} AS lang, sha256({_TEXT}) AS hash FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)),
 g AS (SELECT l.*, CASE WHEN bytes = 0 OR n <= 1 THEN 'QUARANTINE_FILE' ELSE 'PASS' END AS g1, bytes > 0 AND n > 1 AND h.hash IS NOT NULL AS dup FROM l LEFT JOIN h ON h.lang = l.lang AND h.hash = l.hash)"""
_OVERALL = "CASE WHEN bytes = 0 THEN 'REJECT_FILE' WHEN g1 <> 'PASS' OR dup THEN 'QUARANTINE_FILE' ELSE 'PASS' END"


@query("gate_evaluate", f"""WITH {_LANDED} SELECT CAST(doc_id AS VARCHAR) AS file_id, g1 AS g1_outcome, CASE WHEN dup THEN 'QUARANTINE_FILE' ELSE 'PASS' END AS g2_outcome, {_OVERALL} AS overall_outcome,
 CAST(n AS BIGINT) AS total_read_rows, CASE WHEN n > 0 THEN CAST(n - 1 AS BIGINT) END AS accepted_rows, CAST(bytes AS BIGINT) AS file_size_bytes, hash AS checksum_sha256,
 CASE WHEN {_OVERALL} = 'PASS' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS readiness_pct FROM g""")
def gate_evaluate(spark, sf):
    """Verdicts of all four gates on every document."""
    return evaluated(spark, sf).reports.select("file_id", "g1_outcome", "g2_outcome", "overall_outcome", "total_read_rows", "accepted_rows", "file_size_bytes", "checksum_sha256", "readiness.readiness_pct")


@query("gate_manifest", f"""WITH {_LANDED}, i AS (
 SELECT doc_id, 'gate_1' AS gate, 'G1_EMPTY_PAYLOAD' AS rule_id, 0 AS affected, 'DATA_QUALITY_BUG' AS cat, true AS whole FROM g WHERE bytes > 0 AND n <= 1
 UNION ALL SELECT doc_id, 'gate_1', 'G1_PHYSICAL_INTEGRITY', 0, 'DATA_QUALITY_BUG', true FROM g WHERE bytes = 0
 UNION ALL SELECT doc_id, 'gate_2', 'G2_DUPLICATE_PAYLOAD', 0, 'DUPLICATE_PAYLOAD', true FROM g WHERE dup
 UNION ALL SELECT doc_id, 'gate_3', 'dataframe_present', 1, 'DATA_QUALITY_BUG', false FROM g WHERE bytes = 0
 UNION ALL SELECT doc_id, 'gate_4', 'dataframe_present', 0, 'DATA_QUALITY_BUG', true FROM g WHERE bytes = 0)
 SELECT CAST(doc_id AS VARCHAR) AS file_id, gate, rule_id, CAST(affected AS BIGINT) AS affected_rows, cat AS suggested_category, whole AS is_file_level, 0 AS n_samples FROM i""")
def gate_manifest(spark, sf):
    """Manifest items of every document that did not pass."""
    return evaluated(spark, sf).manifest().select("file_id", "gate", "rule_id", "affected_rows", "suggested_category", "is_file_level", F.size("samples").alias("n_samples"))


@query("gate_run_rows", f"""WITH {_LANDED} SELECT sha256(concat_ws('|', lang, name, CASE WHEN bytes > 0 THEN hash ELSE '' END)) AS run_id, lang AS property_id, 'text' AS report_type,
 DATE '2025-02-10' - CAST(((doc_id % 5) + 5) % 5 AS INT) AS business_date, {_OVERALL} AS overall_outcome, name AS s3_path FROM g""")
def gate_run_rows(spark, sf):
    """The run table's rows of the same evaluation, as they would be appended."""
    return gate.stored_form(evaluated(spark, sf).reports).select("run_id", "property_id", "report_type", "business_date", "overall_outcome", "s3_path")


_PAST = f"""p AS (SELECT {_LANG} AS lang, coalesce(nullif(source, ''), 'none') AS source, sha256({_TEXT}) AS hash, DATE '2024-06-01' + CAST(((doc_id % 90) + 90) % 90 AS INT) AS day, concat('run_', doc_id) AS run FROM documents WHERE doc_id IS NOT NULL)"""


def _past(spark, sf):
    return table(spark, sf, "documents").where("doc_id IS NOT NULL").selectExpr(
        f"{_LANG} AS lang", "coalesce(nullif(source, ''), 'none') AS source", f"sha2({_TEXT}, 256) AS hash", "date_add(DATE '2024-06-01', CAST(pmod(doc_id, 90) AS INT)) AS day", "concat('run_', doc_id) AS run", "'RELEASED' AS outcome")


@query("duplicate_matches", f"""WITH {_PAST}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, hash ORDER BY day DESC, run) AS k FROM p)
 SELECT lang, source, hash, string_agg(run, ',' ORDER BY k) AS matches FROM r WHERE k <= 10 GROUP BY lang, source, hash""")
def duplicate_matches(spark, sf):
    """The newest ten released runs with each payload."""
    past = _past(spark, sf)
    found = anomaly.matching_runs(past, past.select("lang", "source", "hash").distinct(), ["lang", "source"], "day", "hash", "outcome", "run")
    return found.select("lang", "source", "hash", F.array_join(F.transform("matches", lambda m: m["run"]), ",").alias("matches"))


@query("overlap_conflicts", f"""WITH {RUNS}, m AS (SELECT *, date_trunc('month', business_date)::DATE AS month FROM runs),
 k AS (SELECT a.run_id, b.run_id AS other, row_number() OVER (PARTITION BY a.run_id ORDER BY b.run_id) AS k FROM m a JOIN m b ON a.property_id = b.property_id AND a.month = b.month AND a.checksum_sha256 <> b.checksum_sha256
  WHERE b.overall_outcome IN ({names(fx.CERTIFIED)}))
 SELECT m.run_id, coalesce(string_agg(other, ',' ORDER BY k) FILTER (k <= 10), '') AS conflicts FROM m LEFT JOIN k USING (run_id) GROUP BY m.run_id""")
def overlap_conflicts(spark, sf):
    """The first ten certified runs of the same property and month with another payload."""
    mine = runs(spark, sf).withColumn("month", F.to_date(F.date_trunc("month", "business_date")))
    found = anomaly.conflicting_runs(mine, mine.select("property_id", "month").distinct(), ["property_id"], "month", "checksum_sha256", "overall_outcome", "run_id")
    rivals = anomaly.conflicts(c("certified"), "checksum_sha256", c("checksum_sha256"))
    return mine.join(found, ["property_id", "month"], "left").select("run_id", F.coalesce(F.array_join(F.transform(rivals, lambda r: r["run_id"]), ","), lit("")).alias("conflicts"))
