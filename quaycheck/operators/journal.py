"""Property journal: notes on runs, seen per property."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def impact(note_type: Column) -> Column:
    return F.when(note_type == "VENDOR_ESCALATION", "CUSTOMER_NOTIFIED").when(note_type == "DECISION_REASON", "LOW").otherwise("NONE")


def project_notes(notes: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """Journal entries of run notes; a note on an unknown run goes to property UNKNOWN."""
    facts = runs.select(run, "property_id", "report_type")
    return notes.join(facts, run, "left").select(
        *notes.columns, F.coalesce("property_id", F.lit("UNKNOWN")).alias("property_id"), "report_type",
        impact(F.col("note_type")).alias("customer_impact"), F.lit("NOTE_ADDED").alias("lifecycle_event"))


def matches(entry_type: Column, customer_impact: Column, wanted: str) -> Column:
    if wanted == "ALL":
        return F.lit(True)
    if wanted == "HIGH_IMPACT":
        return customer_impact.isin("HIGH", "CUSTOMER_NOTIFIED")
    return entry_type == wanted


def page(entries: DataFrame, where: Column, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest entries first; a page is a top-k of limit + offset rows."""
    return entries.where(where).orderBy(*order).offset(offset).limit(max(1, limit))


def by_day(entries: DataFrame, keys: list[str], created: str, where: Column) -> DataFrame:
    """Entries per day as counts. The entries themselves stay rows; they are read by `page`."""
    return entries.where(where).groupBy(*keys, F.to_date(created).alias("day")).agg(
        F.count(F.lit(1)).alias("entries"), F.min(created).alias("first_at"), F.max(created).alias("last_at"))
