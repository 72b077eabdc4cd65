"""Checks that need the other files of a batch: set completeness, commit markers, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.functions.common import call
from quaycheck.operators.identity import parent_folder

ANY, ABSENT = "\x01any", "\x01absent"


def present_members(files: DataFrame, keys: list[str], member: str, members: Column) -> DataFrame:
    """Which of the wanted members each batch key has. The list is bounded by the contract's own."""
    return (
        files.where(F.array_contains(members, F.col(member)))
        .groupBy(*keys)
        .agg(F.collect_set(member).alias("present"))
    )


def atomic_set(files: DataFrame, keys: list[str], member: str, members: Column) -> DataFrame:
    """One row per batch key: members still missing, HOLD until there are none."""
    # duplicates of one member in a hot key collapse before they meet
    present = files.groupBy(*keys).agg(
        F.collect_set(F.when(F.array_contains(members, F.col(member)), F.col(member))).alias("present"))
    missing = F.array_except(members, F.col("present"))
    return present.withColumn("missing", missing).withColumn(
        "verdict", F.when(F.size("missing") > 0, "HOLD").otherwise("PASS"))


def siblings_present(files: DataFrame, batch: str, prop: str, date: str, member: str,
                     members: Column) -> DataFrame:
    """Per (batch, property, date): members present among siblings, where an unknown property or date
    on either side matches everything.

    Every provider is listed under the keys that may ask for it and every asker looks up the keys
    that may serve it, so the match stays an equi-join between two small distinct tables.
    """
    served = lambda c: F.when(F.col(c).isNull(), F.array(F.lit(ANY), F.lit(ABSENT))).otherwise(
        F.array(F.col(c), F.lit(ABSENT)))
    asked = lambda c: F.when(F.col(c).isNull(), F.array(F.lit(ABSENT))).otherwise(
        F.array(F.col(c), F.lit(ANY)))
    known = files.where(F.array_contains(members, F.col(member)))
    providers = (
        known.select(batch, prop, date, member).distinct()
        .select(batch, member, F.explode(served(prop)).alias("_p"), served(date).alias("_ds"))
        .select(batch, member, "_p", F.explode("_ds").alias("_d"))
        .groupBy(batch, "_p", "_d").agg(F.collect_set(member).alias("here"))
    )
    askers = files.select(batch, prop, date).distinct()
    looked = (
        askers.select(batch, prop, date, F.explode(asked(prop)).alias("_p"), asked(date).alias("_ds"))
        .select(batch, prop, date, "_p", F.explode("_ds").alias("_d"))
    )
    return (
        looked.join(providers, [batch, "_p", "_d"], "left")
        .select(batch, prop, date, F.explode_outer("here").alias("m"))
        .groupBy(batch, prop, date).agg(F.collect_set("m").alias("present"))
    )


def sibling_verdict(required: Column, own: Column, present: Column) -> tuple[Column, Column]:
    """(verdict, missing): not one of the required types is a QUARANTINE, a gap is a HOLD."""
    have = F.array_union(F.coalesce(present, F.array().cast("array<string>")), F.array_compact(F.array(own)))
    missing = F.array_except(required, have)
    stranger = own.isNotNull() & ~F.array_contains(required, own)
    verdict = (
        F.when(F.size(required) == 0, "PASS")
        .when(stranger, "QUARANTINE")
        .when(F.size(missing) > 0, "HOLD")
        .otherwise("PASS")
    )
    return verdict, missing


def commit_markers(objects: DataFrame, inventory: DataFrame, key: str, marker: Column, salts: int = 32) -> DataFrame:
    """Adds has_marker: the inventory holds the marker file in the object's own folder.

    The join key is (folder, marker name) against the distinct markers asked for, one row per folder. Objects of one
    folder are dealt over `salts` keys, those that ask for no marker over as many as there are.
    """
    own = F.xxhash64(key, *[c for c in ("file_id",) if c in objects.columns])
    salt = F.when(F.col("_marker").isNull(), own).otherwise(F.pmod(own, F.lit(salts)))
    wanted = objects.withColumn("_folder", parent_folder(F.col(key))).withColumn("_marker", marker).withColumn("_salt", salt)
    # unpacked from a list: of a literal, Spark would make a join without keys
    asked = wanted.where("_marker IS NOT NULL").select("_marker").distinct().select(F.explode(F.array("_marker")).alias("_marker"))
    base = F.element_at(F.split(F.col("object_key"), "/"), -1)
    there = (
        inventory.select(parent_folder(F.col("object_key")).alias("_folder"), base.alias("_marker"))
        .join(asked, "_marker", "left_semi").distinct().withColumn("has_marker", F.lit(True))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    )
    return (
        wanted.join(there, ["_folder", "_marker", "_salt"], "left")
        .withColumn("has_marker", F.coalesce("has_marker", F.lit(False)))
        .drop("_folder", "_marker", "_salt")
    )


def delta_logs(objects: DataFrame, inventory: DataFrame, key: str, where: Column) -> DataFrame:
    """Adds has_delta_log: some folder above the object holds a _delta_log. Asked for `where` only."""
    root = F.regexp_extract("object_key", r"^(?:(.*)/)?_delta_log(?:/|$)", 1)
    roots = inventory.where(F.col("object_key").rlike("(^|/)_delta_log(/|$)")).select(
        root.alias("_root")).distinct()
    folders = F.split(parent_folder(F.col(key)), "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(folders)),
        lambda n: F.array_join(F.slice(folders, F.lit(1), n), "/"),
    )
    found = (
        objects.where(where).select(key, F.explode(F.array_distinct(above)).alias("_root"))
        .join(roots, "_root", "left_semi").select(key).distinct().withColumn("has_delta_log", F.lit(True))
    )
    return objects.join(found, key, "left").withColumn("has_delta_log", F.coalesce("has_delta_log", F.lit(False)))


def first_line(text: Column) -> Column:
    """First line that is not blank, trimmed."""
    return F.trim(F.regexp_extract(text, r"^\s*(\S[^\r\n]*)", 1))


def watermark_verdict(row: Column, column: Column) -> Column:
    """Whether a JSON row is an object that has the watermark column."""
    doc = call("try_parse_json", row)
    keys = call("json_object_keys", row)
    return (
        F.when(F.coalesce(row, F.lit("")) == "", "EMPTY")
        .when(doc.isNull(), "INVALID_JSON")
        .when(~F.startswith(call("schema_of_variant", doc), F.lit("OBJECT")), "NOT_OBJECT")
        .when(~F.coalesce(F.array_contains(keys, column), F.lit(False)), "MISSING_COLUMN")
        .otherwise("PASS")
    )


def object_payload_ok(base: Column, fmt: Column, length: Column, marker: Column) -> Column:
    """Marker objects pass; an empty JSONL object does not."""
    control = (base == marker) | F.startswith(base, F.lit("_"))
    return control | ~((fmt == "JSONL") & (length == 0))
