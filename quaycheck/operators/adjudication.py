"""Review of blocked runs: queue, metrics, overrides, releases, legality of changes.

Runs are append-only. A decision is a new row; the current state is the latest row of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions.common import blank_to_null
from quaycheck.operators.anomaly import first_json


def queue(runs: DataFrame, created: str, run: str, limit: int = 100) -> DataFrame:
    """Newest blocked runs. A top-k per task and one small merge, not a global sort."""
    return runs.where(F.col("overall_outcome").isin(fx.BLOCKED)).orderBy(F.col(created).desc(), F.col(run).desc()).limit(max(1, limit))


def enrich(rows: DataFrame, properties: DataFrame, prop: str, name: str, zone: str) -> DataFrame:
    dims = properties.select(F.col(prop), F.col(name).alias("property_name"), F.col(zone).alias("timezone"))
    return rows.join(dims, prop, "left").withColumn("property_name", F.coalesce("property_name", F.col(prop).cast("string")))


def object_path(own: Column, gates: Column) -> Column:
    return F.coalesce(blank_to_null(own), first_json(gates, fx.OBJECT_PATHS, "string"))


def metrics(runs: DataFrame, created: str, now: Column) -> DataFrame:
    """All counters in one aggregate."""
    o = F.col("overall_outcome")
    recent = F.col(created) >= now - F.expr("INTERVAL 24 HOURS")
    return runs.agg(
        F.count_if(o == "QUARANTINE_FILE").alias("active_quarantines"),
        F.count_if(o == "HOLD_SET").alias("held_sets"),
        F.count_if(o == "REJECT_FILE").alias("rejects"),
        F.count_if(o == "MISSING_DELIVERY").alias("sla_breaches"),
        F.count_if((o == "PASS_OVERRIDDEN") & recent).alias("overrides_executed_today"),
    )


def declare_short(requests: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """Override rows for the requested runs that are blocked and belong to the stated property."""
    original = runs.select(
        F.col(run), F.col("property_id").alias("_prop"), "report_type", "business_date",
        F.col("overall_outcome").alias("original_outcome"), "total_read_rows", "checksum_sha256")
    ok = (F.col("property_id") == F.col("_prop")) & F.col("original_outcome").isin(fx.BLOCKED)
    stamp = F.date_format("requested_at", "yyyyMMdd'T'HHmmss'Z'")
    return requests.join(original, run).where(ok).select(
        F.concat(F.lit("override_"), F.col(run), F.lit("_"), stamp).alias("run_id"),
        F.col(run).alias("original_run_id"), "property_id", F.coalesce("report_type", F.lit("unknown")).alias("report_type"),
        "business_date", "original_outcome", F.lit("PASS_OVERRIDDEN").alias("overall_outcome"), "total_read_rows", "checksum_sha256",
        F.concat(F.lit("DECLARE_SHORT by "), F.col("operator_id"), F.lit(": "), F.col("reason")).alias("outcome_reason"))


def request_status(requests: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """Verdict on every override request, also on those that cannot be met."""
    original = runs.select(F.col(run), F.col("property_id").alias("_prop"), F.col("overall_outcome").alias("_outcome"))
    return requests.join(original, run, "left").withColumn("status",
        F.when(F.col("_prop").isNull(), "RUN_NOT_FOUND")
        .when(F.col("_prop") != F.col("property_id"), "OTHER_PROPERTY")
        .when(~F.col("_outcome").isin(fx.BLOCKED), "NOT_BLOCKED")
        .otherwise("ACCEPTED")).drop("_prop", "_outcome")


def redrive_inputs(requests: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Stored objects of the runs to evaluate again; feed them to the same evaluation plan."""
    return objects.join(requests.select(key).distinct(), key, "left_semi")


def release(requests: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """Release transitions with their status; a released run stays as it was."""
    state = runs.select(F.col(run), "property_id", "overall_outcome")
    o = F.col("overall_outcome")
    return requests.join(state, run, "left").withColumn("status",
        F.when(o.isNull(), "NOT_FOUND").when(o == "RELEASED_TO_ETL", "ALREADY_RELEASED")
        .when(o.isin(fx.BLOCKED), "RELEASED_TO_ETL").otherwise("REFUSED"))


def released_rows(transitions: DataFrame) -> DataFrame:
    """Rows to append for accepted transitions; the reason defaults to who released."""
    return transitions.where(F.col("status") == "RELEASED_TO_ETL").withColumn("overall_outcome", F.lit("RELEASED_TO_ETL")).withColumn(
        "outcome_reason", F.coalesce(blank_to_null(F.col("reason")), F.concat(F.lit("Released to ETL by "), F.col("operator_id"))))


def current_runs(events: DataFrame, run: str, order: str) -> DataFrame:
    """Latest row per run, as one aggregate."""
    rest = [c for c in events.columns if c != run]
    return events.groupBy(run).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(run, "_last.*")


def mutation_audit(before: DataFrame, after: DataFrame, run: str) -> DataFrame:
    """Changes between two snapshots with their verdict: release, classification, deletion or illegal."""
    same = lambda c: F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    identity = same("property_id") & same("report_type") & same("business_date")
    releasing = (F.col("n.overall_outcome") == "RELEASED_TO_ETL") & F.col("o.overall_outcome").isin(fx.BLOCKED)
    kept = same("overall_outcome") & same("checksum_sha256")
    joined = before.alias("o").join(after.alias("n"), F.col(f"o.{run}") == F.col(f"n.{run}"), "left")
    return joined.select(
        F.col(f"o.{run}").alias(run), F.col("o.overall_outcome").alias("old_outcome"), F.col("n.overall_outcome").alias("new_outcome"),
        F.when(F.col(f"n.{run}").isNull(), "ILLEGAL_DELETE").when(identity & releasing, "RELEASE").when(identity & kept, "UNCHANGED_IDENTITY")
        .otherwise("ILLEGAL_UPDATE").alias("verdict"))


def feed_matches(feed: Column, wanted: str) -> Column:
    return F.lit(True) if wanted == "ALL" else F.lower(F.trim(F.coalesce(feed, F.lit("")))).isin(fx.FEED_FILTERS[wanted])


def outcome_matches(outcome: Column, wanted: str) -> Column:
    return F.lit(True) if wanted == "ALL" else outcome.isin(fx.OUTCOME_FILTERS.get(wanted, [wanted]))


def queue_filters(outcome: Column, feed: Column) -> Column:
    """All filter names a run answers to, as arrays: struct(feeds, outcomes)."""
    feeds = F.array_compact(F.array(*[F.when(feed_matches(feed, k), F.lit(k)) for k in ["ALL", *fx.FEED_FILTERS]]))
    names = ["ALL", "HOLD_SET", "QUARANTINE_FILE", "REJECT_FILE", "FLAGGED", "RELEASED", "RELEASED_TO_ETL"]
    outs = F.array_compact(F.array(*[F.when(outcome_matches(outcome, k), F.lit(k)) for k in names]))
    return F.struct(feeds.alias("feeds"), outs.alias("outcomes"))


