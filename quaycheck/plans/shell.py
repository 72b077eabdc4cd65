"""The rule shell: structural rules of one profile family over a table of landed files.

A file is one row here, so every rule about its lines is a higher-order function on that row and
the whole evaluation is narrow; only set completeness and the registry need another table. Files
too large for one row go through the line operators (operators.lines) instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions import patterns as pt
from quaycheck.functions.common import call
from quaycheck.operators import contracts, identity, lines, outcome, physical, sets

SKIPPED = "Skipped due to earlier hard failure."
LINE_RULE = "array<struct<pattern:string>>"
SECTION = "array<struct<section_id:string,marker_pattern:string,required:boolean>>"
SET = "array<struct<set_id:string,members:array<string>,group_by:array<string>,applies_to_report_types:array<string>>>"


def normalise_profiles(profiles: DataFrame, doc: str) -> DataFrame:
    """Profile documents to typed columns, with the errors that make one unusable."""
    d = F.col("_d")
    t = lambda *p: contracts.text_at(d, *p)
    ty = lambda kind, p: call("try_variant_get", d, p, kind)
    rules = lambda n: pt.any_of(F.transform(F.coalesce(ty(LINE_RULE, f"$.row_classification.{n}"), F.array().cast(LINE_RULE)), lambda r: r["pattern"]))
    pattern = lambda p, anchored=False: pt.compiled(t(p), anchored)
    sections = F.transform(F.coalesce(ty(SECTION, "$.structure.expected_sections"), F.array().cast(SECTION)), lambda s: F.struct(
        s["section_id"].alias("id"), pt.compiled(s["marker_pattern"])["regex"].alias("regex"), F.coalesce(s["required"], F.lit(True)).alias("required")))
    return profiles.withColumn("_d", contracts.parsed(F.col(doc))).select(
        t("$.profile_id").alias("profile_id"), contracts.lint(F.col(doc)).alias("profile_errors"),
        F.coalesce(t("$.filename.transport"), F.lit("filename")).alias("transport"),
        pattern("$.filename.pattern", True).alias("name_pattern"), pattern("$.filename.uri_path_pattern").alias("uri_pattern"),
        pattern("$.filename.manifest_identity.pattern").alias("body_pattern"),
        F.coalesce(ty("array<string>", "$.filename.required_groups"), F.array().cast("array<string>")).alias("required_groups"),
        pt.date_format(F.coalesce(t("$.filename.date_format"), F.lit("%Y%m%d"))).alias("token_format"),
        pattern("$.content_identity.property_pattern").alias("c_property"), pattern("$.content_identity.report_type_pattern").alias("c_report_type"),
        pattern("$.content_identity.business_date_pattern").alias("c_date"),
        ty("variant", "$.content_identity").isNotNull().alias("checks_content"),
        pt.date_format(F.coalesce(t("$.content_identity.business_date_format"), F.lit("%Y-%m-%d"))).alias("content_format"),
        F.coalesce(t("$.physical.encoding"), F.lit("utf-8")).alias("encoding"), F.coalesce(t("$.physical.delimiter"), F.lit("|")).alias("delimiter"),
        F.coalesce(t("$.physical.line_ending"), F.lit("any")).alias("line_ending"), F.coalesce(t("$.physical.compression"), F.lit("none")).alias("compression"),
        F.coalesce(ty("boolean", "$.physical.allow_bom"), F.lit(False)).alias("allow_bom"), F.coalesce(ty("int", "$.physical.min_bytes"), F.lit(1)).alias("min_bytes"),
        rules("header_rules").alias("header_re"), rules("footer_rules").alias("footer_re"), rules("ignore_rules").alias("ignore_re"), rules("reject_rules").alias("reject_re"),
        ty("int", "$.row_classification.data_row_shape.exact_fields").alias("exact_fields"), ty("int", "$.row_classification.data_row_shape.min_fields").alias("min_fields"),
        ty("int", "$.row_classification.data_row_shape.max_fields").alias("max_fields"), pattern("$.row_classification.row_count_declaration.pattern").alias("count_pattern"),
        F.coalesce(t("$.row_classification.row_count_declaration.compares_to"), F.lit("total_read_rows")).alias("compares_to"),
        pattern("$.date_bounds.content_date_pattern").alias("date_pattern"), pt.date_format(t("$.date_bounds.date_format")).alias("bound_format"),
        call("try_to_date", t("$.date_bounds.floor_date")).alias("floor_date"), F.coalesce(ty("boolean", "$.date_bounds.allow_future"), F.lit(False)).alias("allow_future"),
        F.coalesce(ty(SET, "$.atomic_sets"), F.array().cast(SET)).alias("atomic_sets"), sections.alias("sections"),
        pattern("$.structure.udf.slot_pattern").alias("slot_pattern"), F.coalesce(ty("int", "$.structure.udf.expected_slot_count"), F.lit(0)).alias("expected_slots"),
        F.coalesce(t("$.structure.udf.count_mode"), F.lit("distinct_slots")).alias("count_mode"),
    )


def _named_all(line: Column, pattern: Column, name: str) -> Column:
    """All captures of a named group in a line; the whole match where the pattern does not name it."""
    at = F.coalesce(F.array_position(pattern["names"], F.lit(name)).cast("int"), F.lit(0))
    return F.coalesce(call("regexp_extract_all", line, pattern["regex"], at), F.array().cast("array<string>"))


def evaluate(files: DataFrame, profiles: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """One report per file.

    files: file_id, batch_id, profile_id, filename, path, content, manifest_text.
    registry: property_id, active, pms_profile.
    """
    c, lit = F.col, F.lit
    none = F.array().cast("array<string>")
    f = files.join(profiles, "profile_id", "left")
    ok_bytes = physical.encoding_check(c("content"), c("encoding"), lit(False))["ok"]
    body = F.coalesce("manifest_text", F.when(ok_bytes, physical.decoded(c("content"), physical.encoding_name(c("encoding")))))
    f = (
        f.withColumn("tokens", identity.transported_tokens(c("transport"), c("filename"), c("path"), body, c("name_pattern"), c("uri_pattern"), c("body_pattern")))
        .withColumn("missing_tokens", identity.missing_groups(c("required_groups"), F.coalesce("tokens", F.create_map().cast("map<string,string>"))))
        .withColumn("property", F.element_at("tokens", "property")).withColumn("report_type", F.element_at("tokens", "report_type"))
        .withColumn("date_token", F.element_at("tokens", "date"))
        .withColumn("business_date", call("try_to_date", c("date_token"), c("token_format")))
    )
    known = registry.select(c("property_id").alias("property"), c("active"), c("pms_profile"), lit(True).alias("registered"))
    f = f.join(known, "property", "left").withColumn("registry", identity.registry_verdict(c("property"), c("registered"), c("active"), c("pms_profile"), c("profile_id")))

    # physical
    f = (
        f.withColumn("length", F.coalesce(F.length("content"), lit(0))).withColumn("checksum", physical.checksum(c("content")))
        .withColumn("decodes", ok_bytes & c("content").isNotNull()).withColumn("bom", physical.has_bom(c("content")) & (physical.encoding_name(c("encoding")) == "utf-8"))
        .withColumn("endings_ok", physical.line_endings_ok(physical.latin1(c("content")), c("line_ending")))
    )
    text = F.coalesce(F.when(c("decodes"), physical.decoded(c("content"), physical.encoding_name(c("encoding")))), lit(""))
    f = f.withColumn("split", lines.split_strict(text, c("line_ending"))).withColumn("lines", c("split.lines"))

    # content identity: the first line with a usable capture, per token
    first = lambda p, n: F.get(F.array_compact(F.transform("lines", lambda l: pt.group(l, c(p), n))), 0)
    f = f.withColumn("in_property", first("c_property", "property")).withColumn("in_report_type", first("c_report_type", "report_type")).withColumn(
        "in_date_token", first("c_date", "business_date")).withColumn("in_date", call("try_to_date", c("in_date_token"), c("content_format")))
    pairs = [("property", c("property"), c("in_property")), ("report_type", c("report_type"), c("in_report_type")), ("business_date", c("business_date"), c("in_date"))]
    agree = F.when(~c("checks_content"), "PASS").when(c("in_date_token").isNotNull() & c("in_date").isNull(), "MISFILED_OBJECT").otherwise(identity.content_verdict(pairs))
    f = f.withColumn("content_verdict", agree)

    # rows
    shape = lambda l: lines.shape_ok(l, c("delimiter"), c("exact_fields"), c("min_fields"), c("max_fields"))
    f = f.withColumn("classes", F.transform("lines", lambda l: lines.shell_class(l, c("header_re"), c("footer_re"), c("ignore_re"), c("reject_re"), shape(l))))
    n = lambda k: F.size(F.filter("classes", lambda x: x == k)).cast("bigint")
    declared = F.get(F.array_compact(F.transform("lines", lambda l: lines.declared_value(l, c("count_pattern"), lines.SHELL_COUNT_NAMES, False))), 0)
    total = F.size("lines").cast("bigint")
    f = (
        f.withColumn("total_read_rows", total).withColumn("declared_total", declared)
        .withColumn("header_footer_rows", n("header_footer")).withColumn("accepted_rows", n("accepted")).withColumn("rejected_rows", n("rejected"))
        .withColumn("quarantined_rows", n("quarantined")).withColumn("ignored_rows", n("ignored"))
    )
    observed = F.when(c("compares_to") == "total_read_rows", c("total_read_rows")).otherwise(c("accepted_rows"))
    f = f.withColumn("unaccounted_rows", lines.unaccounted(c("declared_total"), observed, c("split.segments"), c("total_read_rows"), c("total_read_rows"), c("split.skipped")))

    # dates, sections, slots
    tokens = F.flatten(F.transform("lines", lambda l: _named_all(l, c("date_pattern"), "biz_date")))
    f = f.withColumn("dates", F.transform(F.filter(tokens, lambda x: x != ""), lambda x: call("try_to_date", x, c("bound_format"))))
    real = F.array_compact("dates")
    dates = lines.date_verdict(F.size("dates"), F.size(F.filter("dates", lambda x: x.isNull())), F.array_min(real), F.array_max(real), c("floor_date"), as_of, c("allow_future"))
    hit = lambda s: F.exists("lines", lambda l: pt.matches(l, s["regex"]))
    slots = F.transform("lines", lambda l: _named_all(l, c("slot_pattern"), "slot"))
    distinct = F.array_sort(F.array_distinct(F.flatten(slots)))
    per_line = F.transform(slots, lambda s: F.size(s))
    f = (
        f.withColumn("date_verdict", dates)
        .withColumn("sections_found", F.transform(F.filter("sections", hit), lambda s: s["id"]))
        .withColumn("missing_sections", F.transform(F.filter("sections", lambda s: s["required"] & ~hit(s)), lambda s: s["id"]))
        .withColumn("slots", distinct)
        .withColumn("slots_detected", F.when(c("count_mode") == "distinct_slots", F.size(distinct)).when(c("count_mode") == "max_per_row", F.coalesce(F.array_max(per_line), lit(0)))
                    .otherwise(F.aggregate(per_line, lit(0), lambda a, x: a + x)))
    )
    f = f.withColumn("unmapped", F.when((c("count_mode") == "distinct_slots") & (c("slots_detected") > c("expected_slots")),
                                        F.slice("slots", c("expected_slots") + 1, F.size("slots"))).otherwise(none))
    f = f.drop("content", "lines", "split", "classes", "dates", "slots")
    f = _with_sets(f)
    f = f.withColumn("rules", _ladder(f)).withColumn("stop_at", _stop_at()).withColumn("evaluations", _statuses())
    failed = F.filter("evaluations", lambda e: e["status"].isin("FAIL", "HOLD", "FLAG"))
    worst = F.array_max(F.transform(failed, lambda e: outcome.rank(e["on_fail"], fx.SHELL_RANK)))
    return f.withColumn("overall_outcome", outcome.by_rank(F.coalesce(worst, lit(0)), fx.SHELL_RANK)).withColumn(
        "outcome_reason", F.coalesce(F.get(failed, 0)["message"], lit("All extraction rules passed."))).select(
        "file_id", "filename", "profile_id", c("property").alias("property_id"), "report_type", "business_date", c("checksum").alias("checksum_sha256"),
        "overall_outcome", "outcome_reason", "total_read_rows", "header_footer_rows", "accepted_rows", "rejected_rows", "quarantined_rows", "ignored_rows",
        "unaccounted_rows", "declared_total", "sections_found", "missing_sections", "slots_detected", "unmapped",
        F.transform("evaluations", lambda e: F.struct(e["rule_id"].alias("rule_id"), e["status"].alias("status"), e["message"].alias("message"))).alias("evaluations"))


def _with_sets(f: DataFrame) -> DataFrame:
    """Adds the sets a file belongs to that are not complete. Siblings are the files of its batch."""
    applies = lambda s: (F.coalesce(F.size(s["applies_to_report_types"]), F.lit(0)) <= 0) | F.coalesce(
        F.array_contains(s["applies_to_report_types"], F.col("report_type")), F.lit(False))
    key = lambda s: F.transform(s["group_by"], lambda g: F.coalesce(F.element_at("tokens", g), F.lit("")))
    per_set = f.where(F.col("tokens").isNotNull()).select("file_id", "batch_id", "profile_id", "report_type", "tokens", F.explode("atomic_sets").alias("s")).withColumn(
        "set_key", F.concat_ws("\x01", key(F.col("s"))))
    on = ["batch_id", "profile_id", "set_id", "set_key"]
    rows = per_set.select("file_id", "batch_id", "profile_id", "report_type", F.col("s.set_id").alias("set_id"), "set_key", F.col("s.members").alias("members"), applies(F.col("s")).alias("applies"))
    present = sets.present_members(rows, on, "report_type", F.col("members"))
    gaps = rows.where("applies").join(present, on, "left").select("file_id", "set_id", F.array_except("members", F.coalesce("present", F.array().cast("array<string>"))).alias("missing"))
    held = gaps.where(F.size("missing") > 0).groupBy("file_id").agg(F.collect_list(F.concat(F.lit("set '"), "set_id", F.lit("' missing members "), F.array_join("missing", ", "))).alias("holds"))
    return f.join(held, "file_id", "left")


def _rung(rule: str, failed: Column, on_fail: Column | str, message: Column, status: str = "FAIL", stop: bool = False) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.coalesce(failed, F.lit(False)).alias("failed"), (F.lit(on_fail) if isinstance(on_fail, str) else on_fail).alias("on_fail"),
                    F.when(failed, message).otherwise("Passed.").alias("message"), F.lit(status).alias("status"), F.lit(stop).alias("stop"))


def _ladder(f: DataFrame) -> Column:
    c, lit, q = F.col, F.lit, "QUARANTINE_FILE"
    bad_token = c("date_token").isNotNull() & c("business_date").isNull()
    broken = F.coalesce(F.size("profile_errors") > 0, lit(True))
    naming = (
        F.when(c("tokens").isNull(), F.concat(lit("Identity transport '"), F.coalesce("transport", lit("")), lit("' does not match the profile's pattern.")))
        .when(F.size("missing_tokens") > 0, F.concat(lit("Identity match missing required named groups: "), F.array_join("missing_tokens", ", "), lit(".")))
        .when(bad_token, "Identity date token does not have the profile's format.")
        .otherwise(F.concat(lit("Property registry: "), F.coalesce("registry", lit(""))))
    )
    small = ~physical.big_enough(c("length"), c("min_bytes"))
    bytes_bad = ~physical.compression_ok(c("compression")) | small | ~c("decodes") | (c("bom") & ~c("allow_bom")) | ~c("endings_ok")
    bytes_message = (
        F.when(~physical.compression_ok(c("compression")), "Only compression=none is accepted.").when(small, "File size below min_bytes.")
        .when(~c("decodes"), "Decode failed for the declared encoding.").when(c("bom") & ~c("allow_bom"), "BOM present but allow_bom=false.")
        .otherwise("Line endings are not the declared ones.")
    )
    below = c("slots_detected") < c("expected_slots")
    return F.array(
        _rung("R00_PROFILE_SCHEMA", broken, "REJECT_FILE", F.concat(lit("INVALID_PROFILE_CONFIG: "), F.array_join(F.coalesce("profile_errors", F.array(lit("unknown profile"))), "; ")), stop=True),
        _rung("R01_NAMING_CONTRACT", c("tokens").isNull() | (F.size("missing_tokens") > 0) | bad_token | c("registry").isNotNull(), q, naming, stop=True),
        _rung("R02_PHYSICAL_INTEGRITY", bytes_bad, F.when(small, "REJECT_FILE").otherwise(q), bytes_message, stop=True),
        _rung("R01B_IDENTITY_AGREEMENT", c("content_verdict") != "PASS", q, lit("MISFILED_OBJECT: Filename identity does not agree with content identity."), stop=True),
        _rung("R03_ROW_CONSERVATION", c("unaccounted_rows") != 0, q, F.concat(lit("Row conservation invariant violated: declared_row_count="), F.coalesce(c("declared_total").cast("string"), lit("none")),
              lit(" unaccounted_rows="), c("unaccounted_rows").cast("string"), lit("."))),
        _rung("R04_STATIC_DATE_BOUNDS", c("date_verdict") != "PASS", q, F.concat(lit("Content dates: "), c("date_verdict"))),
        _rung("R05_ATOMIC_SET", F.coalesce(F.size("holds"), lit(0)) > 0, "HOLD_SET", F.concat(lit("HOLD_SET: "), F.array_join(F.array_sort("holds"), "; ")), "HOLD"),
        _rung("R06_STRUCTURAL_UDF", F.size("missing_sections") > 0, q, F.concat(lit("Required sections missing: "), F.array_join("missing_sections", ", "), lit("."))),
        _rung("R06_STRUCTURAL_UDF", (F.size("missing_sections") == 0) & (below | (F.size("unmapped") > 0)), "FLAG", F.when(below, "Slot inventory below expected.").otherwise(
            F.concat(lit("Unmapped slots: "), F.array_join("unmapped", ", "))), "FLAG"),
    )


def _stop_at() -> Column:
    """Place of the first rule whose failure ends the evaluation."""
    halts = F.transform("rules", lambda r, i: F.when(r["failed"] & r["stop"], i))
    return F.coalesce(F.array_min(halts), F.lit(99))


def _statuses() -> Column:
    """PASS, FAIL, HOLD, FLAG or SKIPPED per rule.

    Rule 0 shows only when it fails, and then alone. Of the two halves of rule 6 (places 7 and 8)
    the flag shows when it is raised, the other one otherwise.
    """
    stop_at, flagged = F.col("stop_at"), F.get("rules", 8)["failed"] & (F.col("stop_at") == 99)
    numbered = F.transform("rules", lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    shown = F.filter(numbered, lambda s: (
        F.when(s["i"] == 0, s["r"]["failed"]).when(s["i"] == 7, ~flagged).when(s["i"] == 8, flagged).otherwise(F.lit(True))
        & ((stop_at != 0) | (s["i"] == 0))))
    return F.transform(shown, lambda s: F.struct(
        s["r"]["rule_id"].alias("rule_id"),
        F.when(s["i"] > stop_at, "SKIPPED").when(s["r"]["failed"], s["r"]["status"]).otherwise("PASS").alias("status"),
        F.when(s["i"] > stop_at, SKIPPED).otherwise(s["r"]["message"]).alias("message"), s["r"]["on_fail"].alias("on_fail")))
