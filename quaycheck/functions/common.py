"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def call(name: str, *args) -> Column:
    """SQL function by name, with every argument taken as a Column."""
    return F.call_function(name, *[a if isinstance(a, Column) else F.lit(a) for a in args])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once per row, however often the body refers to it.

    Spark evaluates what stands inside a higher-order function or behind a condition anew at each mention.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strings(values: Iterable[str]) -> Column:
    """Literal array<string>, typed even when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def lookup(mapping: Mapping[str, object], key: Column) -> Column:
    """Value of a fixed mapping, null when the key is unknown."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def non_empty(array: Column) -> Column:
    """Null for an empty array, so that coalesce moves on to the next alias."""
    return F.when(F.size(array) > 0, array)


def details(**values: Column) -> Column:
    """map<string,string> of the given values; null values are left out."""
    if not values:
        return F.create_map().cast("map<string,string>")
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _k, v: v.isNotNull())


def dim(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed-value table; its size is the number of literals in the source."""
    return F.broadcast(spark.createDataFrame(rows, schema))
