"""Tolerant dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaycheck.functions.common import call


def parse_business_date(text: Column) -> Column:
    """ISO, compact and slashed dates; anything else is null."""
    t = F.trim(text)
    first_ten = F.substring(t, 1, 10)
    compact = t.rlike(r"^\d{8}$")
    return F.coalesce(
        F.when(compact, call("try_to_date", t, "yyyyMMdd")),
        call("try_to_date", F.when(first_ten.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), first_ten), "yyyy-M-d"),
        call("try_to_date", F.when(t.rlike(r"^\d{8}"), F.substring(t, 1, 8)), "yyyyMMdd"),
        call("try_to_date", F.when(t.rlike(r"^\d{4}/\d/\d"), F.substring(t, 1, 8)), "yyyy/M/d"),
    )


def iso_business_date(text: Column, today: Column) -> Column:
    """Text form: compact tokens become ISO, blanks become the given day, others are cut to ten."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", F.date_format(today, "yyyy-MM-dd"))
        .when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
        .otherwise(F.substring(t, 1, 10))
    )


def parse_cutoff_seconds(text: Column) -> Column:
    """Seconds after midnight of HH:MM[:SS]; 06:00 when it is missing or malformed."""
    t = F.trim(F.coalesce(text, F.lit("06:00:00")))
    ok = t.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d(:[0-5]?\d)?$")
    parts = F.split(t, ":")
    seconds = (
        F.get(parts, 0).cast("int") * 3600
        + F.get(parts, 1).cast("int") * 60
        + F.coalesce(F.get(parts, 2).cast("int"), F.lit(0))
    )
    return F.when(ok, seconds).otherwise(F.lit(6 * 3600))
