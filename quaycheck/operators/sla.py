"""Delivery deadlines per property in its own time zone, and what is missing when they pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions.common import call, non_empty
from quaycheck.functions.dates import parse_cutoff_seconds

ANY_DELIVERY = "<any PASS/HOLD_SET delivery>"


def zone_or_utc(zone: Column) -> Column:
    """The zone if the JVM knows it, else UTC; checked per distinct value by the JVM itself."""
    ok = call("try_reflect", "java.time.ZoneId", "of", zone).isNotNull() & zone.rlike("^[A-Za-z]")
    return F.when(ok, zone).otherwise("UTC")


def grace_minutes(value: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(value.cast("string").try_cast("int"), F.lit(30)))


def with_deadline(properties: DataFrame, zone: str, cutoff: str, grace: str, now: Column) -> DataFrame:
    """Adds zone, local_now, business_date, deadline and past_deadline."""
    return (
        properties.withColumn("zone", zone_or_utc(F.coalesce(F.col(zone), F.lit("UTC"))))
        .withColumn("local_now", F.from_utc_timestamp(now, F.col("zone")))
        .withColumn("business_date", F.to_date("local_now"))
        .withColumn("deadline", F.timestamp_seconds(
            F.unix_timestamp(F.col("business_date").cast("timestamp"))
            + parse_cutoff_seconds(F.col(cutoff)) + grace_minutes(F.col(grace)) * 60))
        .withColumn("past_deadline", F.col("local_now") >= F.col("deadline"))
    )


def required_types(doc: Column) -> Column:
    """Required report types of a contract document, whichever of the three spellings it uses."""
    parsed = call("try_parse_json", doc)
    at = lambda p: non_empty(call("try_variant_get", parsed, p, "array<string>"))
    return F.coalesce(
        at("$.atomic_set.required_endpoints"), at("$.atomic_set.members"), at("$.atomic_sets[0].members"),
        at("$.gate_1.required_set_endpoints"), F.array().cast("array<string>"))


def delivered_types(runs: DataFrame, prop: str, date: str, report_type: str) -> DataFrame:
    """Report types delivered per property and day. Types are made distinct first, so what is
    collected is bounded by the number of types."""
    return (
        runs.where(F.col("overall_outcome").isin(fx.DELIVERED) & (F.coalesce(F.col(report_type), F.lit("")) != ""))
        .select(prop, date, report_type).distinct()
        .groupBy(prop, date).agg(F.array_sort(F.collect_list(report_type)).alias("delivered"))
    )


def missing_deliveries(properties: DataFrame, runs: DataFrame, prop: str, date: str, report_type: str,
                       required: Column) -> DataFrame:
    """Every property with its missing types and verdict: still in its window, satisfied, or missing.

    The day in question comes from each property's local clock.
    """
    found = delivered_types(runs, prop, date, report_type).withColumnRenamed(date, "business_date")
    none = F.array().cast("array<string>")
    return (
        properties.join(found, [prop, "business_date"], "left")
        .withColumn("delivered", F.coalesce("delivered", none))
        .withColumn("required", required)
        .withColumn("missing", F.when(F.size("required") > 0, F.array_except("required", "delivered"))
                    .when(F.size("delivered") == 0, F.array(F.lit(ANY_DELIVERY))).otherwise(none))
        .withColumn("event_type", 
            F.when(~F.col("past_deadline"), "IN_WINDOW").when(F.size("missing") > 0, "MISSING_DELIVERY").otherwise("SATISFIED"))
    )


def summary(checked: DataFrame) -> DataFrame:
    """Counts of one pass over all properties."""
    is_ = lambda e: F.count_if(F.col("event_type") == e)
    return checked.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("past_deadline").alias("past_deadline"),
        is_("SATISFIED").alias("satisfied"), is_("MISSING_DELIVERY").alias("missing_delivery_count"))


def missing_delivery_runs(events: DataFrame, prop: str) -> DataFrame:
    """Run rows for missing deliveries, so that breaches count in the metrics."""
    return events.where(F.col("event_type") == "MISSING_DELIVERY").select(
        F.concat_ws("_", F.lit("missing"), F.col(prop).cast("string"), F.col("business_date").cast("string")).alias("run_id"),
        F.col(prop), "business_date", F.lit("MISSING_DELIVERY").alias("overall_outcome"),
        F.concat(F.lit("Missing: "), F.array_join("missing", ", ")).alias("outcome_reason"))


def alert_routes(events: DataFrame, prop: str, title: Column, emails: Column, webhook: Column,
                 default_webhook: str | None = None) -> DataFrame:
    """One row per message to send: a webhook post for every event, mail for the alerted types only."""
    hook = F.coalesce(F.nullif(F.trim(webhook), F.lit("")), F.lit(default_webhook).cast("string"))
    mails = F.when(F.col("event_type").isin(fx.ALERTED), F.coalesce(emails, F.array().cast("array<string>")))
    routes = F.concat(
        F.array_compact(F.array(F.when(hook.isNotNull(), F.struct(F.lit("webhook").alias("channel"), hook.alias("recipient"))))),
        F.transform(F.coalesce(mails, F.array().cast("array<string>")),
                    lambda m: F.struct(F.lit("email").alias("channel"), m.alias("recipient"))))
    subject = F.concat(F.lit("["), F.col("event_type"), F.lit("] "), F.col(prop).cast("string"))
    return events.select(prop, "event_type", title.alias("title"), subject.alias("subject"), F.inline(routes))
