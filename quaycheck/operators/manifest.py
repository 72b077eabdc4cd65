"""Quarantine manifest: what failed, how many rows, which samples, what an operator may decide.

Row indices are a table with one row each, (run, gate, rule, row_no): a rule that a third of a huge
file breaks has too many for one array. Items carry their number and up to three sample records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions.common import blank_to_null, lookup

_CANONICAL = sorted({*fx.RULE_CATEGORY, *fx.FILE_LEVEL_RULES})


# -- rule ids --------------------------------------------------------------------------------

def rule_id(raw: Column, message: Column) -> Column:
    """Canonical id: as given, by another spelling, or by what the message says."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    upper = F.upper(text)
    msg = F.coalesce(message, F.lit(""))
    low = F.lower(msg)
    has = lambda c, s: F.contains(c, F.lit(s))
    by_message = (
        F.when(has(msg, "PHYSICAL_INTEGRITY_FAIL") | has(low, "decode error"), "G1_PHYSICAL_INTEGRITY")
        .when(has(msg, "EMPTY_PAYLOAD"), "G1_EMPTY_PAYLOAD")
        .when(has(msg, "UNREGISTERED_ENDPOINT"), "G1_UNREGISTERED_ENDPOINT")
        .when(has(msg, "Financial imbalance") | (has(msg, "Net sales") & has(msg, "Tender")), "G4_FINANCIAL_IMBALANCE")
        .when(has(msg, "100%") & (has(low, "comp") | has(low, "discount")), "G4_FULL_COMP")
        .when(has(low, "zero cover") | has(low, "0 guest"), "G4_ZERO_COVER_REVENUE")
    )
    return (
        F.when(text == "", "UNKNOWN")
        .when(upper.isin(_CANONICAL), upper)
        .otherwise(F.coalesce(
            lookup(fx.RULE_ALIASES, F.translate(F.lower(text), "- ", "__")),
            by_message,
            F.when(F.startswith(upper, F.lit("G")), upper).otherwise(text),
        ))
    )


def category(rule: Column) -> Column:
    return F.coalesce(lookup(fx.RULE_CATEGORY, rule), F.lit(fx.DEFAULT_CATEGORY))


def is_file_rule(rule: Column) -> Column:
    return rule.isin(fx.FILE_LEVEL_RULES)


def guidance(rule: Column, cat: Column, file_level: Column, message: Column) -> Column:
    g, low = fx.GUIDANCE, F.lower(F.coalesce(message, F.lit("")))
    corrupt = F.contains(low, F.lit("decode error")) | F.contains(low, F.lit("physical integrity"))
    return (
        F.when((cat == "UNBALANCED_REVENUE") | rule.isin("G4_FINANCIAL_IMBALANCE", "G4_UNBALANCED_HEADER"), g["revenue"])
        .when((cat == "BUSINESS_EDGE_CASE") | rule.isin("G4_ZERO_COVER_REVENUE", "G4_FULL_COMP"), g["edge"])
        .when((cat == "FALSE_POSITIVE") | F.startswith(rule, F.lit("G2_VOLUME")) | (rule == "G2_ZSCORE_ANOMALY"), g["volume"])
        .when((cat == "OVERLAP_DRIFT") | (rule == "G2_OVERLAP_DRIFT"), g["overlap"])
        .when(file_level | (rule == "G1_PHYSICAL_INTEGRITY") | corrupt, g["physical"])
        .when(cat == "DATA_QUALITY_BUG", g["quality"])
        .when(cat == "VENDOR_CONFIG_CHANGE", g["vendor"])
        .otherwise(F.coalesce(blank_to_null(message), F.lit(g["other"])))
    )


# -- items -----------------------------------------------------------------------------------

def with_variance(gate: Column, rule_name: Column, message: Column, info: Column) -> Column:
    """Revenue messages state the variance, from the details when the text does not."""
    revenue = (gate == "gate_4") | F.lower(rule_name).isin("sales_vs_tender_balance", "header_vs_line_balance")
    num = lambda k: F.element_at(info, k).try_cast("double")
    given = num("variance")
    pair = F.coalesce(F.abs(num("net_sales") - num("tender_payments")), F.abs(num("header_total") - num("line_sum")))
    tail = lambda v: F.concat(F.rtrim(message, F.lit(".")), F.lit(" Variance: "), v.cast("decimal(28,2)").cast("string"), F.lit("."))
    states = F.contains(message, F.lit("Variance:"))
    return (
        F.when(~revenue | states, message)
        .when(given.isNotNull(), tail(given))
        .when(pair.isNotNull() & F.contains(message, F.lit("Financial imbalance")), tail(pair))
        .otherwise(message)
    )


def manifest_items(evaluations: DataFrame, rows: DataFrame, run: str, record: str | None = None) -> DataFrame:
    """One item per failed evaluation that was not skipped.

    evaluations: run, gate, ord, rule_name, passed, skipped, message, details.
    rows: run, gate, rule_name, row_no, and with `record` the text of the row; counted per rule before it is joined.
    With `record`, an item has `samples`: its first three offending rows with their text.
    """
    counted = rows.groupBy(run, "gate", "rule_name").agg(F.count_distinct("row_no").alias("indexed_rows"))
    if record:
        first = sample_rows(rows, run, record=record).groupBy(run, "gate", "rule_name").agg(
            F.array_sort(F.collect_list(F.struct("row_no", F.col(record).alias("record")))).alias("samples"))
        counted = counted.join(first, [run, "gate", "rule_name"], "left")
    more = [F.coalesce("samples", F.array().cast("array<struct<row_no:int,record:string>>")).alias("samples")] if record else []
    failed = evaluations.where(~F.col("passed") & ~F.coalesce(F.col("skipped"), F.lit(False)))
    items = (
        failed.join(counted, [run, "gate", "rule_name"], "left")
        .withColumn("indexed_rows", F.coalesce("indexed_rows", F.lit(0)))
        .withColumn("message", with_variance(F.col("gate"), F.col("rule_name"), F.col("message"), F.col("details")))
        .withColumn("rule_id", rule_id(F.col("rule_name"), F.col("message")))
    )
    whole = (is_file_rule(F.col("rule_id")) | F.col("gate").isin("gate_1", "gate_2", "gate_4")) & (F.col("indexed_rows") == 0)
    stated = F.nullif(F.element_at("details", "affected_rows").try_cast("bigint"), F.lit(0))
    cat = (
        F.when(F.col("is_file_level") & F.col("rule_id").isin("G1_PHYSICAL_INTEGRITY", "G1_EMPTY_PAYLOAD"), "DATA_QUALITY_BUG")
        .when(F.col("rule_id").isin("G4_FINANCIAL_IMBALANCE", "G4_UNBALANCED_HEADER"), "UNBALANCED_REVENUE")
        .otherwise(category(F.col("rule_id")))
    )
    return (
        items.withColumn("is_file_level", whole)
        .withColumn("affected_rows", F.when(F.col("is_file_level"), 0).otherwise(
            F.coalesce(stated, F.when(F.col("indexed_rows") > 0, F.col("indexed_rows")), F.lit(1))).cast("bigint"))
        .withColumn("suggested_category", cat)
        .withColumn("decision_guidance", guidance(F.col("rule_id"), F.col("suggested_category"), F.col("is_file_level"), F.col("message")))
        .select(run, "gate", "ord", "rule_id", "affected_rows", "suggested_category", "message", "is_file_level", "decision_guidance", *more)
    )


def guaranteed_items(runs: DataFrame, items: DataFrame, run: str) -> DataFrame:
    """An item for every blocked run that has none, out of its reason text."""
    blocked = runs.where(F.upper(F.trim(F.col("overall_outcome"))).isin("REJECT_FILE", "QUARANTINE_FILE", "FLAG", "FLAGGED", "HOLD_SET"))
    reason = F.trim(F.coalesce(blank_to_null(F.col("outcome_reason")), F.lit("Run blocked without detailed sub-check findings.")))
    money = F.lower(F.col("message")).rlike("imbalance|tender")
    rule = F.when(F.lower(F.col("message")).rlike("imbalance|variance|tender"), "G4_FINANCIAL_IMBALANCE").otherwise("RUN_BLOCKED")
    return (
        blocked.join(items.select(run).distinct(), run, "left_anti")
        .select(run, reason.alias("message"))
        .withColumn("rule_id", rule)
        .withColumn("suggested_category", F.when(money, "UNBALANCED_REVENUE").otherwise(category(F.col("rule_id"))))
        .select(
            run, F.lit("run").alias("gate"), F.lit(0).alias("ord"), "rule_id", F.lit(0).cast("bigint").alias("affected_rows"),
            "suggested_category", "message", F.lit(True).alias("is_file_level"),
            guidance(F.col("rule_id"), F.col("suggested_category"), F.lit(True), F.col("message")).alias("decision_guidance"),
        )
    )


def sample_rows(rows: DataFrame, run: str, keep: int = 3, record: str | None = None) -> DataFrame:
    """First offending rows of each rule, with their text if asked for. Tasks pass on no more than `keep` rows of a group:
    a row's several offences against a rule are one to `dense_rank`, and made one after it."""
    w = Window.partitionBy(run, "gate", "rule_name").orderBy("row_no")
    if record:
        near = rows.select(run, "gate", "rule_name", "row_no", record).withColumn("sample_no", F.dense_rank().over(w)).where(F.col("sample_no") <= keep)
        return near.dropDuplicates([run, "gate", "rule_name", "row_no"])
    distinct = rows.select(run, "gate", "rule_name", "row_no").distinct()
    return distinct.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= keep)


def sample_records(samples: DataFrame, data: DataFrame, run: str, record: str) -> DataFrame:
    """The records behind the samples; data: run, row_no and a record column."""
    return samples.join(data.select(run, "row_no", record), [run, "row_no"])


def quarantined_rows(items: DataFrame, rows: DataFrame, run: str) -> DataFrame:
    """Distinct offending rows per run; without any, the rows the items claim."""
    seen = rows.select(run, "row_no").distinct().groupBy(run).agg(F.count(F.lit(1)).alias("seen"))
    claimed = items.groupBy(run).agg(F.sum(F.greatest("affected_rows", F.lit(0))).alias("claimed"))
    return claimed.join(seen, run, "full").select(
        run, F.coalesce(F.nullif("seen", F.lit(0)), "claimed", F.lit(0)).cast("bigint").alias("quarantined_rows"))


def readiness(total: Column, quarantined: Column, outcome: Column) -> Column:
    """Share of rows fit for use. Blocked or empty files have none."""
    t = F.greatest(F.coalesce(total, F.lit(0)), F.lit(0))
    q = F.least(F.greatest(F.coalesce(quarantined, F.lit(0)), F.lit(0)), t)
    blocked = (t == 0) | F.upper(F.trim(F.coalesce(outcome, F.lit("")))).isin("REJECT_FILE", "QUARANTINE_FILE")
    pct = lambda n: F.round(n / F.nullif(t, F.lit(0)) * 100.0, 2)
    return F.struct(
        t.cast("bigint").alias("total_rows"),
        F.when(blocked, 0).otherwise(t - q).cast("bigint").alias("verified_rows"),
        F.when(blocked, F.greatest(t, F.lit(1))).otherwise(q).cast("bigint").alias("quarantined_rows"),
        F.when(blocked, 0.0).otherwise(pct(t - q)).alias("readiness_pct"),
        F.when(blocked, 100.0).otherwise(pct(q)).alias("quarantine_pct"),
    )


# -- operator side ---------------------------------------------------------------------------

def merge_classifications(items: DataFrame, patches: DataFrame, run: str, order: str) -> DataFrame:
    """The last patch per rule sets category and note of every item with that rule."""
    last = patches.groupBy(run, "rule_id").agg(
        F.max_by(F.struct("user_category", "user_notes"), order).alias("patch"))
    return (
        items.join(last, [run, "rule_id"], "left")
        .withColumn("user_category", F.coalesce(F.col("patch.user_category"), F.col("user_category")))
        .withColumn("user_notes", F.when(F.col("patch").isNotNull(), F.col("patch.user_notes")).otherwise(F.col("user_notes")))
        .drop("patch")
    )


def failure_highlights(evaluations: DataFrame, run: str, keep: int = 12) -> DataFrame:
    """Telling details of a run's failures, in report order, at most twelve."""
    path = F.concat(F.col("gate"), F.lit(".evaluations["), F.col("ord").cast("string"), F.lit("]."))
    said = F.when(~F.col("passed") & (F.col("message") != ""), F.struct(
        F.lit(-1).alias("at"), F.concat(path, F.lit("passed/message")).alias("key"), F.col("message").alias("value")))
    hits = [
        F.when(F.element_at("details", k).isNotNull(), F.struct(
            F.lit(i).alias("at"), F.concat(path, F.lit(f"details.{k}")).alias("key"), F.element_at("details", k).alias("value")))
        for i, k in enumerate(fx.HIGHLIGHT_KEYS)
    ]
    w = Window.partitionBy(run).orderBy("gate", "ord", "at")
    return (
        evaluations.select(run, "gate", "ord", F.inline(F.array_compact(F.array(said, *hits))))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
        .select(run, "rank", "key", "value")
    )


STORED_GATE = ("struct<evaluations: array<struct<rule_name:string, check_name:string, passed:boolean, message:string,"
               " details:map<string,string>>>, findings: array<struct<rule_name:string, check_name:string,"
               " passed:boolean, message:string, details:map<string,string>>>>")


def stored_evaluations(runs: DataFrame, run: str, doc: str) -> DataFrame:
    """Evaluations out of the stored gate JSON of a run."""
    gates = runs.select(run, F.explode(F.from_json(F.col(doc), "map<string,string>")).alias("gate", "body")).where(
        F.col("gate").rlike("(?i)^gate[_-]?[0-9]$"))
    body = gates.withColumn("b", F.from_json("body", STORED_GATE))
    evals = F.coalesce(F.when(F.size("b.evaluations") > 0, F.col("b.evaluations")), F.col("b.findings"))
    return body.select(run, "gate", F.posexplode(evals).alias("ord", "e")).select(
        run, "gate", "ord", F.coalesce("e.rule_name", "e.check_name", F.lit("UNKNOWN")).alias("rule_name"),
        F.coalesce("e.passed", F.lit(False)).alias("passed"),
        F.coalesce(F.element_at("e.details", "skipped") == "true", F.lit(False)).alias("skipped"),
        F.coalesce("e.message", F.lit("")).alias("message"), F.col("e.details").alias("details"))


def effective_category(user: Column, rule: Column, message: Column, file_level: Column, suggested: Column) -> Column:
    msg = F.coalesce(message, F.lit(""))
    return (
        F.when(user.isNotNull(), user)
        .when(rule.isin("G4_FINANCIAL_IMBALANCE", "G4_UNBALANCED_HEADER") | msg.rlike("(?i)Financial imbalance|Net sales.*Tender"), "UNBALANCED_REVENUE")
        .when(file_level | (rule == "G1_PHYSICAL_INTEGRITY") | msg.rlike("(?i)physical|decode"), "DATA_QUALITY_BUG")
        .otherwise(suggested)
    )


def money_in(message: Column) -> Column:
    """struct(left, right, variance) read back out of an imbalance message."""
    num = r"\s*\$?\s*([0-9]+(?:\.[0-9]+)?)"
    read = lambda label: blank_to_null(F.regexp_extract(message, f"(?i)(?:{label}){num}", 1)).try_cast("double")
    left = F.coalesce(read("Net sales"), read("Header total"))
    right = F.coalesce(read("Tender payments"), read("Line sum"))
    return F.struct(left.alias("left"), right.alias("right"), F.coalesce(read("Variance:"), F.abs(left - right)).alias("variance"))


def decide(requests: DataFrame) -> DataFrame:
    """What an operator's action on an item means: category, note, note type and follow-up."""
    a = F.col("action")
    return (
        requests
        .withColumn("user_category", F.coalesce(lookup({k: v[0] for k, v in fx.ACTIONS.items()}, a), F.col("suggested_category")))
        .withColumn("user_notes", F.coalesce(lookup({k: v[1] for k, v in fx.ACTIONS.items()}, a), a))
        .withColumn("note_type", F.when(a == "reject_escalate_audit", "VENDOR_ESCALATION").otherwise("DECISION_REASON"))
        .withColumn("follow_up", F.when(a == "declare_short_release", "DECLARE_SHORT").when(a.isin(fx.RELEASING_ACTIONS), "RELEASE").otherwise("NONE"))
    )
