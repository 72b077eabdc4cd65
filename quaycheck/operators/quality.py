"""Column quality: presence, nulls, non-numeric values, ranges, ragged rows, unknown entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.functions.common import blank_to_null, call

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """Double value of a numeric text. Suffixed or named numbers ('10d', 'NaN') do not count."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def is_poison(text: Column) -> Column:
    """Present but not a number."""
    return text.isNotNull() & number(text).isNull()


def missing_columns(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def violations(rows: DataFrame, keep: list[str], checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """One row per failed check of a data row, found in a single pass: (rule, column, failed, value)."""
    found = [
        F.when(failed, F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"),
                                value.cast("string").alias("value")))
        for rule, column, failed, value in checks
    ]
    return rows.select(*keep, F.inline(F.array_compact(F.array(*found))))


def violation_counts(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key, "rule", "column").agg(F.count(F.lit(1)).alias("failing_rows"))


def null_counts(rows: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """Nulls per column, all columns in one aggregate, unpivoted to one row per column."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    wide = rows.groupBy(key).agg(*aggs) if key else rows.agg(*aggs)
    return wide.unpivot([key] if key else [], columns, "column", "null_rows")


def range_counts(rows: DataFrame, bounds: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Rows below and above the bounds of each column."""
    aggs = []
    for c, low, high in bounds:
        below = F.col(c) < low if low is not None else F.lit(False)
        above = F.col(c) > high if high is not None else F.lit(False)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(below).alias("below_min"),
                             F.count_if(above).alias("above_max")).alias(c))
    wide = rows.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.col(c) for c, _, _ in bounds])))


def csv_fields(line: Column, delimiter: Column) -> Column:
    """Fields of a delimited line; quoted fields may hold the delimiter, doubled quotes are one.

    The pattern is possessive, so that a cell of any length is matched in a loop and not by recursion.
    """
    plain = F.regexp_replace(delimiter, r"([\\\[\]^|.$*+?(){}-])", r"\\$1")
    pattern = F.concat(plain, F.lit('("[^"]*+(?:""[^"]*+)*+"|[^'), plain, F.lit("]*+)"))
    raw = call("regexp_extract_all", F.concat(delimiter, line), pattern, 1)
    unquoted = lambda f: F.when(
        F.startswith(f, F.lit('"')) & F.endswith(f, F.lit('"')) & (F.length(f) >= 2),
        F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')),
    ).otherwise(f)
    return F.transform(raw, unquoted)


def cells(fields: Column, header: Column) -> Column:
    """map<column,text> of a row; short rows lack the tail, extra fields are ignored, blanks are null.

    Of columns with one name the first counts; `repeated_columns` names them.
    """
    at = F.sequence(F.lit(1), F.size(header))
    first = F.when(F.size(F.array_distinct(header)) == F.size(header), at).otherwise(
        F.filter(at, lambda i: F.array_position(header, F.element_at(header, i)) == i))
    return F.map_from_entries(F.transform(first, lambda i: F.struct(
        F.element_at(header, i).alias("key"), blank_to_null(F.get(fields, i - 1)).alias("value"))))


def repeated_columns(header: Column) -> Column:
    """Names that a header gives to more than one column, blank names left out."""
    at = F.sequence(F.lit(1), F.size(header))
    later = F.filter(at, lambda i: (F.array_position(header, F.element_at(header, i)) < i) & (F.trim(F.element_at(header, i)) != ""))
    return F.when(F.size(header) > 0, F.array_distinct(F.transform(later, lambda i: F.element_at(header, i)))).otherwise(F.array().cast("array<string>"))


def without_entity(rows: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose entity is not in the dimension."""
    return rows.join(entities, keys, "left_anti")


def files_without_rows(files: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Files that no data row belongs to."""
    return files.join(rows.select(key), key, "left_anti")
