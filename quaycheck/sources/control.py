"""Control tables: run history and reports. Reads push their filters; writes only append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quaycheck.functions.common import call

LIST_COLUMNS = ["quarantine_manifest", "findings"]
OBJECT_COLUMNS = ["gate_evaluations", "readiness_stats"]


def scan(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None,
         newest: tuple[list[Column], int] | None = None, offset: int = 0) -> DataFrame:
    """Filtered, pruned, ordered scan of a control table."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    if newest:
        order, n = newest
        df = df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)
    return df


def append_runs(reports: DataFrame, path: str, by: str = "business_date") -> None:
    """Appends run reports, one folder per business date.

    Rebalanced by date: adaptive execution splits a busy date over many writers and packs quiet
    dates together, so files come out near the advisory size either way.
    """
    reports.hint("rebalance", F.col(by)).write.mode("append").partitionBy(by).parquet(path)


def new_runs_only(reports: DataFrame, stored: DataFrame, run: str | list[str] = "run_id", by: str = "business_date") -> DataFrame:
    """Reports whose run is not stored yet, each once: a replayed or repeated landing appends nothing twice.

    Where both have the partition column, only the stored dates that the reports name are read; runs without a date are
    looked for among the stored ones without. `run` may be several columns, such as a run and its outcome.
    """
    keys = [run] if isinstance(run, str) else run
    reports = reports.dropDuplicates(keys)
    if by in reports.columns and by in stored.columns:
        dates = reports.select(F.col(by).alias("_by")).distinct()
        stored = stored.join(dates, F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    return reports.join(stored.select(*keys), keys, "left_anti")


def align(rows: DataFrame, target: StructType | list[str]) -> DataFrame:
    """The target's columns in its order and types; unknown ones are dropped, missing ones become null of their type.

    A target of names alone leaves types as they are.
    """
    have = set(rows.columns)
    if not isinstance(target, StructType):
        return rows.select(*[F.col(n) if n in have else F.lit(None).alias(n) for n in target])
    return rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target])


def as_list(text: Column) -> Column:
    """JSON text of a list; anything else is an empty list."""
    kind = call("schema_of_variant", call("try_parse_json", text))
    return F.when(F.startswith(kind, F.lit("ARRAY")), text).otherwise("[]")


def as_object(text: Column) -> Column:
    kind = call("schema_of_variant", call("try_parse_json", text))
    return F.when(F.startswith(kind, F.lit("OBJECT")), text).otherwise("{}")


def run_id(object_key: Column, checksum: Column, property_id: Column) -> Column:
    """Same object and payload, same run: a retry overwrites nothing and adds nothing."""
    return F.sha2(F.concat_ws("|", F.coalesce(property_id, F.lit("")), object_key, checksum), 256)
