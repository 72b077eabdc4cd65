"""Contracts as a table: documents to typed columns, presets, fallbacks, upserts, lint.

Documents are JSON strings. Reading, aliasing and pattern rewriting are column expressions, so a
contract table of any size is normalised where it lies; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions import patterns as pt
from quaycheck.functions.common import blank_to_null, call, dim, let, lookup, strings
from quaycheck.operators.identity import noise_folders, noise_regex


# -- reading loose documents -----------------------------------------------------------------

def parsed(doc: Column) -> Column:
    return call("try_parse_json", doc)


def text_at(doc: Column, *paths: str) -> Column:
    """First non-blank text among alias paths."""
    return F.coalesce(*[blank_to_null(call("try_variant_get", doc, p, "string")) for p in paths])


# Every spelling a contract document has used. Scalars and lists are read as text: JSON that is not
# a string keeps its source form, and is cast or unfolded below.
_F = "encoding:string,delimiter:string,line_ending:string,allow_encoding_fallback:string"
_G3 = "required_columns:string,non_null_columns:string,required_non_null:string,numeric_columns:string,numeric_ranges:string,value_ranges:string"
_G4 = ("max_variance:string,max_allowed_variance:string,header_vs_line_balance:string,enable_header_line_balance:string,"
       "sales_vs_tender_balance:string,enable_sales_tender_balance:string,header_total_columns:string,"
       "line_amount_columns:string,tax_columns:string,net_sales_columns:string,tender_columns:string")
DOCUMENT = (
    "profile_id string, preset_id string, feed_category string, property_code string, property_id string, encoding string,"
    " delimiter string, failure_route string, filename_regex string, allow_encoding_fallback string, noise_filter string,"
    " header_patterns string, footer_patterns string, ignore_patterns string, declared_line_count_regex string,"
    " metadata struct<feed_category:string,property_id:string,system_preset:string>,"
    " filename struct<pattern:string,path_agree:string,path_pattern:string,path_regex:string,uri_path_pattern:string,required_groups:string>,"
    f" file_format struct<{_F}>, physical struct<{_F}>,"
    " row_classification struct<header_rules:string,header_patterns:string,footer_rules:string,footer_patterns:string,"
    "ignore_rules:string,ignore_patterns:string,row_count_declaration:struct<pattern:string>>,"
    " atomic_set struct<is_multi_file:string,is_multi_file_atomic_set:string,required_endpoints:string,required_set_endpoints:string,members:string>,"
    " atomic_sets array<struct<members:string>>,"
    " object_landing struct<format:string,partition_key:string,watermark_column:string,partition_path:string,"
    "partition_path_template:string,require_commit_marker:string,commit_marker:string>,"
    " gate_2 struct<max_z_score:string,enforce_dow_baseline:string,frozen_date_threshold_days:string,rolling_window_days:string,"
    "min_historical_samples:string,amount_z_threshold:string>,"
    f" gate_3 struct<{_G3}>, quality_rules struct<{_G3}>, gate_4 struct<{_G4}>, revenue_rules struct<{_G4}>,"
    " gates struct<gate1_extraction:struct<filename_pattern:string,delimiter:string,encoding:string,atomic_set_members:string>,"
    "gate2_anomaly:struct<zscore_threshold:string,max_allowed_age_days:string,frozen_window:struct<max_allowed_age_days:string>,"
    "rolling_window_days:string,min_historical_samples:string,amount_z_threshold:string>,"
    "gate3_quality:struct<required_columns:string>,gate4_revenue:struct<tolerance_eur:string>>"
)
RANGE = "array<struct<column:string,column_name:string,min_value:double,max_value:double>>"


def first_text(*paths: str) -> Column:
    """First non-blank value among fields of the document column `_c`."""
    return F.coalesce(*[blank_to_null(F.col(f"_c.{p}")) for p in paths])


def unfold(raw: Column) -> Column:
    """A list of strings, a list of {pattern: ..} objects or a single string, as array<string>."""
    items = F.transform(F.from_json(raw, "array<string>"), lambda e: F.when(
        F.startswith(e, F.lit("{")), call("get_json_object", e, "$.pattern")).otherwise(e))
    return F.when(F.startswith(raw, F.lit("[")), F.array_compact(items)).when(raw.isNotNull(), F.array(raw))


def first_list(*paths: str) -> Column:
    """First list among fields that is not empty."""
    given = [F.when(~F.col(f"_c.{p}").isin("", "[]", "[ ]", "null"), F.col(f"_c.{p}")) for p in paths]
    return F.coalesce(*given)


def normalise(contracts: DataFrame, key: str, doc: str, property_code: Column | None = None) -> DataFrame:
    """Loose documents (three historical spellings) to one row of typed columns each.

    Keep the result as a table: it changes when a contract does, not when a file lands.
    """
    c, lit = F.col, F.lit
    g1, g2 = "gates.gate1_extraction", "gates.gate2_anomaly"
    src = contracts.select(key, F.from_json(c(doc), DOCUMENT).alias("_c"),
                           (property_code if property_code is not None else lit(None).cast("string")).alias("_code"))
    has_obj = F.coalesce(*[c(f"_c.object_landing.{x}") for x in ("format", "partition_key", "watermark_column", "partition_path",
                         "partition_path_template", "require_commit_marker", "commit_marker")]).isNotNull()
    lists = {
        "l_groups": ["filename.required_groups"],
        "l_multi": ["atomic_set.required_endpoints", "atomic_set.required_set_endpoints", "atomic_set.members"],
        "l_header": ["row_classification.header_rules", "row_classification.header_patterns", "header_patterns"],
        "l_footer": ["row_classification.footer_rules", "row_classification.footer_patterns", "footer_patterns"],
        "l_ignore": ["row_classification.ignore_rules", "row_classification.ignore_patterns", "ignore_patterns"],
        "l_noise": ["noise_filter"],
        "l_required": ["gate_3.required_columns", "quality_rules.required_columns", "gates.gate3_quality.required_columns"],
        "l_non_null": ["gate_3.non_null_columns", "gate_3.required_non_null", "quality_rules.non_null_columns", "quality_rules.required_non_null"],
        "l_numeric": ["gate_3.numeric_columns", "quality_rules.numeric_columns"],
        **{f"l_{n}": [f"gate_4.{n}", f"revenue_rules.{n}"] for n in (
            "header_total_columns", "line_amount_columns", "tax_columns", "net_sales_columns", "tender_columns")},
    }
    ranges = first_list("gate_3.numeric_ranges", "gate_3.value_ranges", "quality_rules.numeric_ranges", "quality_rules.value_ranges")
    read = src.select(
        key, "_code", "_c", has_obj.alias("has_obj"), F.lower(first_text("feed_category", "metadata.feed_category")).alias("cat"),
        F.lower(F.coalesce(first_text("file_format.line_ending", "physical.line_ending"), lit("lf"))).alias("ending"),
        c("_c.atomic_sets")[0]["members"].alias("l_first_set"), first_list(f"{g1}.atomic_set_members").alias("l_v2_set"),
        F.coalesce(F.from_json(ranges, RANGE), F.array().cast(RANGE)).alias("ranges"),
        *[first_list(*paths).alias(n) for n, paths in lists.items()],
    )
    # one small step after the other: each list is unfolded once, then only referred to
    empty = F.array().cast("array<string>")
    names = [*lists, "l_first_set", "l_v2_set"]
    multi = F.coalesce(first_text("atomic_set.is_multi_file", "atomic_set.is_multi_file_atomic_set") == "true", lit(False))
    listed = read.select("*", *[F.coalesce(unfold(c(n)), empty).alias(f"{n}_") for n in names]).withColumns({
        "cat": F.when(c("cat").isin([x for x, _, _ in fx.CATEGORIES]), c("cat")).otherwise(F.when(c("has_obj"), "lake").otherwise("pos")),
        "noise": F.when(F.size("l_noise_") > 0, c("l_noise_")).otherwise(strings(fx.NOISE_DEFAULT)),
        "ranges": F.transform("ranges", lambda r: F.struct(F.coalesce(r["column_name"], r["column"]).alias("column"),
                                                           r["min_value"].alias("min_value"), r["max_value"].alias("max_value"))),
    })
    number = lambda default, kind, *paths: F.coalesce(*[c(f"_c.{p}").try_cast("double") for p in paths], lit(float(default))).cast(kind)
    flag = lambda default, *paths: F.coalesce(*[c(f"_c.{p}").try_cast("boolean") for p in paths], lit(default))
    alias4 = lambda n, default: F.when(F.size(f"l_{n}_") > 0, c(f"l_{n}_")).otherwise(strings(default)).alias(n)
    text = lambda default, *paths: F.coalesce(first_text(*paths), lit(default))
    return listed.select(
        key,
        F.coalesce(blank_to_null(c("_code")), text("", "property_code", "property_id", "metadata.property_id")).alias("property_code"),
        c("cat").alias("feed_category"),
        text("custom", "profile_id", "preset_id", "metadata.system_preset").alias("preset_id"),
        (c("cat").isin("lake", "dwh") | c("has_obj")).alias("is_object"),
        text("UTF-8", "file_format.encoding", "physical.encoding", "encoding", f"{g1}.encoding").alias("encoding"),
        text(",", "file_format.delimiter", "physical.delimiter", "delimiter", f"{g1}.delimiter").alias("delimiter"),
        F.when(c("ending") == "\r\n", "crlf").when(c("ending") == "\n", "lf").otherwise(c("ending")).alias("line_ending"),
        flag(False, "file_format.allow_encoding_fallback", "allow_encoding_fallback").alias("allow_fallback"),
        pt.compiled(first_text("filename.pattern", "filename_regex", f"{g1}.filename_pattern"), anchored=True).alias("name_pattern"),
        F.when(F.size("l_groups_") > 0, c("l_groups_")).otherwise(strings(fx.REQUIRED_GROUPS_DEFAULT)).alias("required_groups"),
        flag(True, "filename.path_agree").alias("path_agreement"),
        pt.compiled(first_text("filename.path_pattern", "filename.path_regex", "filename.uri_path_pattern")).alias("path_pattern"),
        F.when(multi, c("l_multi_")).when(F.size("l_first_set_") > 0, c("l_first_set_")).otherwise(c("l_v2_set_")).alias("atomic_set"),
        pt.any_of(c("l_header_")).alias("header_re"), pt.any_of(c("l_footer_")).alias("footer_re"), pt.any_of(c("l_ignore_")).alias("ignore_re"),
        pt.compiled(first_text("row_classification.row_count_declaration.pattern", "declared_line_count_regex")).alias("count_pattern"),
        noise_regex(c("noise")).alias("noise_re"), noise_folders(c("noise")).alias("noise_dirs"),
        F.coalesce(lookup(fx.OBJECT_FORMATS, F.lower(F.trim(c("_c.object_landing.format")))), lit("Parquet")).alias("object_format"),
        text("_ingested_at", "object_landing.watermark_column").alias("watermark_column"),
        text("business_date", "object_landing.partition_key").alias("partition_key"),
        pt.template_pattern(text(fx.PARTITION_TEMPLATE_DEFAULT, "object_landing.partition_path", "object_landing.partition_path_template")).alias("partition_pattern"),
        flag(True, "object_landing.require_commit_marker").alias("require_marker"),
        text("_SUCCESS", "object_landing.commit_marker").alias("commit_marker"),
        F.when(c("_c.failure_route") == "QUARANTINE_FILE", c("_c.failure_route")).otherwise("REJECT_FILE").alias("failure_route"),
        number(2.5, "double", "gate_2.max_z_score", f"{g2}.zscore_threshold").alias("max_z"),
        flag(False, "gate_2.enforce_dow_baseline").alias("same_weekday"),
        number(30, "int", "gate_2.frozen_date_threshold_days", f"{g2}.max_allowed_age_days", f"{g2}.frozen_window.max_allowed_age_days").alias("open_days"),
        number(30, "int", "gate_2.rolling_window_days", f"{g2}.rolling_window_days").alias("window_days"),
        number(7, "int", "gate_2.min_historical_samples", f"{g2}.min_historical_samples").alias("min_samples"),
        number(3, "double", "gate_2.amount_z_threshold", f"{g2}.amount_z_threshold").alias("max_amount_z"),
        c("l_required_").alias("required_columns"), c("l_non_null_").alias("non_null_columns"),
        F.array_union("l_numeric_", F.array_compact(F.transform("ranges", lambda r: r["column"]))).alias("numeric_columns"),
        c("ranges").alias("numeric_ranges"),
        number(0.02, "double", "gate_4.max_variance", "gate_4.max_allowed_variance", "revenue_rules.max_variance",
               "revenue_rules.max_allowed_variance", "gates.gate4_revenue.tolerance_eur").alias("max_variance"),
        flag(True, *[f"{s}.{n}" for s in ("gate_4", "revenue_rules") for n in ("header_vs_line_balance", "enable_header_line_balance")]).alias("check_header_line"),
        flag(True, *[f"{s}.{n}" for s in ("gate_4", "revenue_rules") for n in ("sales_vs_tender_balance", "enable_sales_tender_balance")]).alias("check_sales_tender"),
        alias4("header_total_columns", fx.HEADER_TOTAL_COLUMNS), alias4("line_amount_columns", fx.LINE_AMOUNT_COLUMNS),
        alias4("tax_columns", fx.TAX_COLUMNS), alias4("net_sales_columns", fx.NET_SALES_COLUMNS), alias4("tender_columns", fx.TENDER_COLUMNS),
    )


# -- presets ---------------------------------------------------------------------------------

PRESET_SCHEMA = (
    "preset_id string, category string, name string, delimiter string, line_ending string, encoding string,"
    " filename_regex string, members array<string>, header string, footer string, max_z double,"
    " max_variance double, format string, partition_key string, watermark string, template string, marker boolean")


def preset_dim(spark: SparkSession) -> DataFrame:
    """The vendor presets with platform defaults filled in, one row each."""
    cols = [c.strip().split(" ")[0] for c in PRESET_SCHEMA.split(",")]
    rows = [tuple({"preset_id": k, **fx.PRESET_DEFAULT, **v}[c] for c in cols) for k, v in fx.PRESETS.items()]
    return dim(spark, rows, PRESET_SCHEMA)


def category_mode(category: Column) -> Column:
    return lookup({c: m for c, _n, m in fx.CATEGORIES}, category)


def preset_document(prop: Column, prefix: Column, open_window: bool = True, same_weekday: bool = True) -> Column:
    """Contract document (JSON) of a preset row for a property."""
    s = fx.SCHEDULE_DEFAULT
    file = category_mode(F.col("category")) == "file"
    encoding = F.replace(F.lower("encoding"), F.lit("utf-8-bom"), F.lit("utf-8-sig"))
    lit = F.lit
    no_count = lit(None).cast("struct<pattern:string>")
    return F.to_json(F.struct(
        F.col("preset_id").alias("profile_id"), F.col("category").alias("feed_category"), prop.alias("property_code"),
        prefix.alias("landing_prefix"),
        F.struct(lit(s["timezone"]).alias("timezone"), lit(s["cutoff"]).alias("sla_cutoff_time"), lit(s["grace"]).alias("grace_period_minutes"),
                 lit(True).alias("accept_late_backfill"), lit(True).alias("expect_seven_days")).alias("schedule"),
        F.struct(F.col("max_z").alias("max_z_score"), lit(same_weekday).alias("enforce_dow_baseline"),
                 lit(30 if open_window else 3650).alias("frozen_date_threshold_days")).alias("gate_2"),
        F.struct(lit(True).alias("header_vs_line_balance"), lit(True).alias("sales_vs_tender_balance"), "max_variance").alias("gate_4"),
        F.when(file, F.struct(F.regexp_replace("filename_regex", r"\(\?<", "(?P<").alias("pattern"),
                              strings(fx.REQUIRED_GROUPS_DEFAULT).alias("required_groups"), lit(True).alias("path_agree"))).alias("filename"),
        F.struct(F.when(file, "delimited_text").otherwise(F.lower("format")).alias("type"), F.when(file, encoding).otherwise("utf-8").alias("encoding"),
                 F.when(file, F.col("delimiter")).alias("delimiter"), F.when(file, F.col("line_ending")).alias("line_ending")).alias("file_format"),
        F.when(file, F.struct(
            F.filter(F.array("header"), lambda p: p != "").alias("header_patterns"), F.filter(F.array("footer"), lambda p: p != "").alias("footer_patterns"),
            strings(fx.IGNORE_DEFAULT).alias("ignore_patterns"), no_count.alias("row_count_declaration"))).alias("row_classification"),
        F.when(file, F.struct((F.size("members") > 0).alias("is_multi_file"), F.col("members").alias("required_endpoints"))).alias("atomic_set"),
        F.when(~file, F.struct("format", "partition_key", F.col("watermark").alias("watermark_column"), F.col("template").alias("partition_path"),
                               F.col("marker").alias("require_commit_marker"), lit("_SUCCESS").alias("commit_marker"))).alias("object_landing"),
    ))


FALLBACK_SCHEMA = ("system_preset string, pattern string, delimiter string, encoding string, members array<string>,"
                   " zscore double, window int, required array<string>, tolerance double")


def fallback_dim(spark: SparkSession) -> DataFrame:
    cols = [c.strip().split(" ")[0] for c in FALLBACK_SCHEMA.split(",")][1:]
    rows = [(k, *[v[c] for c in cols]) for k, v in fx.FALLBACK_CONTRACTS.items()]
    return dim(spark, rows, FALLBACK_SCHEMA)


def with_fallback(feeds: DataFrame, published: DataFrame, keys: list[str], preset: str, doc: str) -> DataFrame:
    """Feeds with their published document, else one made from the preset (unknown presets use the first)."""
    own = published.select(*keys, F.col(doc).alias("published_doc"))
    known = F.col(preset).isin(list(fx.FALLBACK_CONTRACTS))
    joined = feeds.join(own, keys, "left").withColumn(
        "system_preset", F.when(known, F.col(preset)).otherwise(next(iter(fx.FALLBACK_CONTRACTS))))
    made = F.to_json(F.struct(
        F.lit("2.0").alias("version"),
        F.struct(
            F.struct(F.col("pattern").alias("filename_pattern"), "delimiter", "encoding", F.col("members").alias("atomic_set_members"),
                     F.lit(True).alias("hold_set_enabled")).alias("gate1_extraction"),
            F.struct(F.col("zscore").alias("zscore_threshold"), F.col("window").alias("rolling_window_days")).alias("gate2_anomaly"),
            F.struct(F.col("required").alias("required_columns")).alias("gate3_quality"),
            F.struct(F.col("tolerance").alias("tolerance_eur")).alias("gate4_revenue")).alias("gates")))
    return (
        joined.join(fallback_dim(feeds.sparkSession), "system_preset", "left")
        .withColumn("contract_doc", F.coalesce("published_doc", made))
        .withColumn("source", F.when(F.col("published_doc").isNotNull(), "database").otherwise("preset_fallback"))
        .drop("pattern", "delimiter", "encoding", "members", "zscore", "window", "required", "tolerance", "published_doc")
    )


def hydrate(requests: DataFrame, properties: DataFrame, contracts: DataFrame, prop: str, contract_id: str,
            doc: str, inline: str) -> DataFrame:
    """Contract of each request: its own if given, else the property's active one, else why there is none."""
    p = properties.select(prop, F.col(contract_id).alias("_cid"), F.lit(True).alias("_known"))
    c = contracts.select(F.col(contract_id).alias("_cid"), F.col(doc).alias("_doc"))
    own = blank_to_null(F.col(inline))
    return (
        requests.join(p, prop, "left").join(c, "_cid", "left")
        .withColumn("contract", F.coalesce(own, F.col("_doc")))
        .withColumn("source", F.when(own.isNotNull(), "inline").when(F.col("_known").isNull(), "unknown_property")
                    .when(F.col("_doc").isNull(), "no_active_contract").otherwise("active"))
        .drop("_cid", "_known", "_doc")
    )


def with_landing_prefix(doc: Column, prefix: Column) -> Column:
    """Adds the property's landing prefix to a document that says nothing about paths."""
    d = parsed(doc)
    said = text_at(d, "$.filename.path_pattern", "$.filename.path_regex", "$.s3_prefix_pattern")
    extra = F.to_json(F.struct(prefix.alias("s3_prefix_pattern")))
    return F.when(said.isNotNull() | blank_to_null(prefix).isNull(), doc).otherwise(
        F.concat(F.regexp_replace(doc, r"\}\s*$", ","), F.substring(extra, 2, 1 << 30)))


# -- keeping one row per key -----------------------------------------------------------------

def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row per key of both tables: one aggregate, combined map-side, so a hot key stays small."""
    rest = [c for c in current.columns if c not in keys]
    both = current.unionByName(changes, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def dedupe_feeds(feeds: DataFrame, keys: list[str], contract: str, created: str, feed: str) -> DataFrame:
    """One feed per key: with a contract before without, then the newest, then the highest id."""
    rest = [c for c in feeds.columns if c not in keys]
    best = F.struct(F.col(contract).isNotNull().alias("a"), F.col(created).alias("b"), F.col(feed).alias("c"))
    return feeds.groupBy(*keys).agg(F.max_by(F.struct(*rest), best).alias("_r")).select(*keys, "_r.*")


def version_token(raw: Column, now_ms: Column) -> Column:
    """Whole numbers as they are (64 bit), anything else becomes the current epoch milliseconds."""
    t = F.trim(raw)
    return F.coalesce(F.when(t.rlike(r"^-?\d+$"), t.try_cast("bigint")), now_ms)


def version_time(token: Column) -> Column:
    return F.timestamp_millis(token)


# -- profile lint ----------------------------------------------------------------------------

# Keys a structural profile must have, and all it may have.
PROFILE_REQUIRED = {
    "": ["profile_id", "profile_version", "filename", "physical", "row_classification", "date_bounds", "atomic_sets", "structure"],
    "filename": ["transport", "required_groups"],
    "physical": ["encoding", "delimiter", "line_ending", "compression"],
    "row_classification": ["header_rules", "footer_rules", "ignore_rules", "reject_rules"],
    "date_bounds": ["content_date_pattern", "date_format", "floor_date"],
    "structure": ["expected_sections", "udf"],
    "structure.udf": ["slot_pattern", "expected_slot_count"],
    "content_identity": [],
}
PROFILE_ALLOWED = {
    "": ["profile_id", "profile_version", "description", "filename", "content_identity", "physical", "row_classification", "date_bounds", "atomic_sets", "structure"],
    "filename": ["transport", "required_groups", "pattern", "uri_path_pattern", "manifest_identity", "date_format", "path_glob"],
    "physical": ["encoding", "delimiter", "line_ending", "compression", "allow_bom", "min_bytes"],
    "row_classification": ["header_rules", "footer_rules", "ignore_rules", "reject_rules", "data_row_shape", "row_count_declaration"],
    "date_bounds": ["content_date_pattern", "date_format", "floor_date", "allow_future"],
    "structure": ["expected_sections", "udf"],
    "structure.udf": ["slot_pattern", "expected_slot_count", "count_mode"],
    "content_identity": ["property_pattern", "report_type_pattern", "business_date_pattern", "business_date_format"],
}
# Values a profile key may take.
PROFILE_ENUMS = {
    "filename.transport": ["filename", "uri_path", "manifest"],
    "physical.line_ending": ["lf", "crlf", "cr", "any"],
    "physical.compression": ["none", "gzip", "zip"],
    "structure.udf.count_mode": ["distinct_slots", "max_per_row", "total_matches"],
    "row_classification.row_count_declaration.compares_to": ["total_read_rows", "accepted_rows"],
}
PROFILE_FORMATS = {"profile_id": "^[a-z][a-z0-9_]*$", "date_bounds.floor_date": r"^\d{4}-\d{2}-\d{2}$"}
PROFILE_PATTERNS = ["filename.pattern", "filename.uri_path_pattern", "filename.manifest_identity.pattern",
                    "date_bounds.content_date_pattern", "structure.udf.slot_pattern",
                    "row_classification.row_count_declaration.pattern"]
PROFILE_LISTS = {"row_classification.header_rules": "pattern", "row_classification.footer_rules": "pattern", "row_classification.ignore_rules": "pattern",
                 "row_classification.reject_rules": "pattern", "structure.expected_sections": "marker_pattern"}
PROFILE_DATE_FORMATS = ["filename.date_format", "date_bounds.date_format", "content_identity.business_date_format"]
TRANSPORT_NEEDS = {"filename": "pattern", "uri_path": "uri_path_pattern", "manifest": "manifest_identity"}


def lint(doc: Column) -> Column:
    """array<string> of everything wrong with a profile document; empty means it may be used.

    A document is parsed once, each of its values read once; the rules refer to these.
    """
    return let(parsed(doc), lambda d: let(_profile_values(doc, d), _profile_errors))


def _profile_values(doc: Column, d: Column) -> Column:
    """struct of what the rules look at: keys of the objects, texts, and patterns of the lists."""
    texts = [*PROFILE_ENUMS, *PROFILE_FORMATS, *[f"filename.{n}" for n in TRANSPORT_NEEDS.values()], *PROFILE_PATTERNS, *PROFILE_DATE_FORMATS, "physical.min_bytes"]
    rules = lambda p, kind: F.coalesce(call("try_variant_get", d, f"$.{p}", kind), F.array().cast(kind))
    return F.struct(
        d.isNull().alias("broken"),
        F.struct(*[call("json_object_keys", call("get_json_object", doc, f"$.{where}" if where else "$")).alias(where or "$") for where in PROFILE_ALLOWED]).alias("keys"),
        F.struct(*[call("try_variant_get", d, f"$.{p}", "string").alias(p) for p in dict.fromkeys(texts)]).alias("texts"),
        F.struct(*[F.transform(rules(p, f"array<struct<{field}:string>>"), lambda r: r[field]).alias(p) for p, field in PROFILE_LISTS.items()]).alias("lists"),
    )


def _profile_errors(v: Column) -> Column:
    at = lambda p: v["texts"][p]
    errors = [F.when(v["broken"], F.lit("<root>: not a document"))]
    for where, allowed in PROFILE_ALLOWED.items():
        present = v["keys"][where or "$"]
        prefix = f"{where}." if where else ""
        for k in PROFILE_REQUIRED[where]:
            errors.append(F.when(present.isNotNull() & ~F.array_contains(present, k), F.lit(f"{prefix}{k}: required")))
        unknown = F.array_except(present, strings(allowed))
        errors.append(F.when(F.size(unknown) > 0, F.concat(F.lit(f"{where or '<root>'}: unknown "), F.array_join(F.array_sort(unknown), ","))))
    for p, values in PROFILE_ENUMS.items():
        errors.append(F.when(~at(p).isin(values), F.concat(F.lit(f"{p}: not allowed "), at(p))))
    for p, rx in PROFILE_FORMATS.items():
        errors.append(F.when(~at(p).rlike(rx), F.concat(F.lit(f"{p}: malformed "), at(p))))
    for transport, need in TRANSPORT_NEEDS.items():
        errors.append(F.when((at("filename.transport") == transport) & at(f"filename.{need}").isNull(), F.lit(f"filename.{need}: required by transport")))
    for p in PROFILE_PATTERNS:
        errors.append(F.when(at(p).isNotNull() & ~pt.is_valid(pt.numbered(at(p))), F.lit(f"{p}: invalid pattern")))
    for p in PROFILE_LISTS:
        broken = F.filter(v["lists"][p], lambda x: x.isNotNull() & ~pt.is_valid(pt.numbered(x)))
        errors.append(F.when(F.size(broken) > 0, F.concat(F.lit(f"{p}: invalid pattern "), F.array_join(broken, ", "))))
    for p in PROFILE_DATE_FORMATS:
        errors.append(F.when(at(p).isNotNull() & pt.date_format(at(p)).isNull(), F.lit(f"{p}: unknown date directive")))
    errors.append(F.when(at("physical.min_bytes").try_cast("int") < 1, F.lit("physical.min_bytes: below 1")))
    return F.array_compact(F.array(*errors))


# -- customer tree ---------------------------------------------------------------------------

UNASSIGNED = "__unassigned__"


def customer_tree(customers: DataFrame, properties: DataFrame, feeds: DataFrame, customer: str, prop: str) -> DataFrame:
    """Customer, property and feed counts: one row per customer and property, orphans under one name.

    Flat on purpose: a tree node is a group of rows, so no customer needs to fit into one array.
    """
    counts = feeds.groupBy(prop).agg(F.count(F.lit(1)).alias("feeds"))
    known = customers.withColumn("_known", F.lit(True))
    placed = properties.join(counts, prop, "left").withColumn("feeds", F.coalesce("feeds", F.lit(0)))
    return known.join(placed, customer, "full").withColumn(
        customer, F.when(F.col("_known").isNull(), UNASSIGNED).otherwise(F.col(customer).cast("string"))).drop("_known")
