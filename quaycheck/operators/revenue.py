"""Money: cents, totals under alias names, and the two balances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(value: Column) -> Column:
    """Two decimals, half up; null if it is not a number."""
    return value.try_cast("decimal(18,2)")


def first_alias(present: Column, aliases: Column) -> Column:
    """First alias that names a column of the file."""
    return F.get(F.filter(aliases, lambda a: F.array_contains(present, a)), 0)


def aliases_present(present: Column, aliases: Column) -> Column:
    return F.filter(aliases, lambda a: F.array_contains(present, a))


def row_sum(cells: Column, aliases: Column) -> Column:
    """Cents of all alias columns of one row; what is not a number counts as nothing."""
    return F.aggregate(
        aliases,
        F.lit(0).cast("decimal(28,2)"),
        lambda acc, a: (acc + F.coalesce(cents(F.element_at(cells, a)), F.lit(0).cast("decimal(18,2)"))).cast("decimal(28,2)"),
    )


def first_number(cells: Column, aliases: Column, row_no: Column) -> tuple[Column, Column]:
    """(value, order) for `min_by`: aliases in order, then rows in order; a number the reduce can hash."""
    found = F.filter(
        F.transform(aliases, lambda a, i: F.struct(i.alias("i"), cents(F.element_at(cells, a)).alias("v"))),
        lambda s: s["v"].isNotNull(),
    )
    first = F.get(found, 0)
    order = first["i"].cast("bigint") * F.lit(1 << 48) + row_no.cast("bigint")
    return first["v"], order


def variance(left: Column, right: Column) -> Column:
    return F.abs(left.cast("decimal(28,2)") - right.cast("decimal(28,2)"))


def balance_verdict(left: Column, right: Column, tolerance: Column) -> Column:
    """SKIPPED when a side is missing; the tolerance itself still balances."""
    return (
        F.when(left.isNull() | right.isNull(), "SKIPPED")
        .when(variance(left, right).cast("double") <= tolerance + 1e-12, "BALANCED")
        .otherwise("IMBALANCED")
    )


def imbalance_message(left_name: str, left: Column, right_name: str, right: Column) -> Column:
    money = lambda c: c.cast("decimal(28,2)").cast("string")
    return F.concat(
        F.lit(f"Financial imbalance detected: {left_name} $"), money(left), F.lit(f" vs {right_name} $"),
        money(right), F.lit(". Variance: "), money(variance(left, right)), F.lit("."),
    )


def zero_cover(revenue: Column, covers: Column) -> Column:
    return (revenue > 0) & (covers == 0)


def full_comp(gross: Column, discount: Column) -> Column:
    return (gross > 0) & (discount >= gross)
