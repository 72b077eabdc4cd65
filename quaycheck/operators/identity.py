"""Who a file says it is: tokens from its name, its path or its content, and whether they agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions import patterns as pt
from quaycheck.functions.common import blank_to_null, lookup


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def object_key(path: Column) -> Column:
    """Bucket/key of an s3 address, the path of any other address, never a leading slash."""
    text = F.trim(F.coalesce(path, F.lit("")))
    scheme = F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(text, "^[^:]*://([^/?#]*)", 1)
    key = F.regexp_replace(F.regexp_extract(text, "^[^:]*://[^/?#]*([^?#]*)", 1), "^/+", "")
    return (
        F.when(~F.contains(text, F.lit("://")), F.regexp_replace(text, "^/+", ""))
        .when((F.lower(scheme) == "s3") & (host != ""), F.concat(host, F.lit("/"), key))
        .otherwise(key)
    )


def parent_folder(key: Column) -> Column:
    tidy = F.regexp_replace(F.replace(key, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.regexp_replace(tidy, "/?[^/]*$", "")


def canonical_tokens(groups: Column) -> Column:
    """Known token names with their aliases folded in; other groups are kept beside them."""
    g = lambda *names: F.coalesce(*[F.element_at(groups, n) for n in names])
    known = F.create_map(
        F.lit("report_type"), g("report_type"),
        F.lit("property"), g("property", "property_id"),
        F.lit("date"), g("date"),
        F.lit("hash"), g("hash", "checksum", "sha256", "md5"),
    )
    known = F.map_filter(known, lambda _k, v: v.isNotNull())
    extra = F.map_filter(groups, lambda k, _v: ~k.isin("report_type", "property", "date", "hash"))
    return F.map_concat(known, extra)


def missing_groups(required: Column, tokens: Column) -> Column:
    return F.filter(required, lambda g: blank_to_null(F.element_at(tokens, g)).isNull())


def with_identity(df: DataFrame, name: str, pattern: str, required: Column) -> DataFrame:
    """Adds name_matches, tokens and missing_tokens for a filename column and a pattern struct column."""
    base = basename(F.col(name))
    p = F.col(pattern)
    matched = pt.matches(base, p["regex"])
    empty = F.create_map().cast("map<string,string>")
    return (
        df.withColumn("name_matches", matched)
        .withColumn("tokens", F.when(F.col("name_matches"), canonical_tokens(pt.groups(base, p))).otherwise(empty))
        .withColumn("missing_tokens", missing_groups(required, F.col("tokens")))
    )


def transported_tokens(transport: Column, name: Column, path: Column, body: Column,
                       name_pattern: Column, path_pattern: Column, body_pattern: Column) -> Column:
    """Tokens from whichever source the contract names; null when that source does not match."""
    base = basename(name)
    return (
        F.when((transport == "filename") & pt.matches(base, name_pattern["regex"]), pt.groups(base, name_pattern))
        .when((transport == "uri_path") & pt.matches(path, path_pattern["regex"]), pt.groups(path, path_pattern))
        .when((transport == "manifest") & pt.matches(body, body_pattern["regex"]), pt.groups(body, body_pattern))
    )


def registry_verdict(property_id: Column, registered: Column, active: Column,
                     bound_profile: Column, profile_id: Column) -> Column:
    """Null when the property may use this profile, else why not."""
    return (
        F.when(property_id.isNull(), F.lit(None).cast("string"))
        .when(~F.coalesce(registered, F.lit(False)), "NOT_REGISTERED")
        .when(~F.coalesce(active, F.lit(True)), "INACTIVE")
        .when(bound_profile.isNotNull() & (bound_profile != "") & (bound_profile != profile_id), "OTHER_PROFILE")
    )


def same_or_absent(left: Column, right: Column) -> Column:
    """True unless both sides are stated and differ."""
    a, b = blank_to_null(left), blank_to_null(right)
    return F.coalesce(a == b, F.lit(True))


def disagreements(path_tokens: Column, file_tokens: Column) -> Column:
    """Names of the tokens that both sides state with different values."""
    aliased = F.transform(
        F.map_entries(path_tokens),
        lambda e: F.struct(
            F.when(e["key"] == "property_id", F.lit("property")).otherwise(e["key"]).alias("name"),
            e["value"].alias("value"),
        ),
    )
    differing = F.filter(aliased, lambda e: F.element_at(file_tokens, e["name"]) != e["value"])
    return F.array_sort(F.array_distinct(F.transform(differing, lambda e: e["name"])))


def endpoint_accepted(report_type: Column, registered: Column) -> Column:
    """A report type is needed; when the contract lists types, it must be one of them."""
    listed = F.coalesce(F.array_contains(registered, report_type), F.lit(False))
    return blank_to_null(report_type).isNotNull() & ((F.size(registered) <= 0) | listed)


def partition_tokens(key: Column, template: Column, property_code: Column, feed: Column, fmt: Column) -> Column:
    """Tokens of a partition path. Without a template match, a dt= part and the property code will do."""
    by_template = F.map_concat(
        F.map_filter(
            F.create_map(F.lit("feed"), feed, F.lit("report_type"), F.lower(fmt)),
            lambda k, v: v.isNotNull() & ~F.array_contains(template["names"], k),
        ),
        pt.groups(key, template),
    )
    date = blank_to_null(F.regexp_extract(key, "(?:dt|business_date)=([^/]+)", 1))
    code = blank_to_null(property_code)
    soft = F.when(date.isNotNull() & F.contains(key, code), F.create_map(F.lit("date"), date, F.lit("property"), code))
    return F.when(key != "", F.coalesce(F.when(pt.matches(key, template["regex"]), by_template), soft))


def noise_regex(globs: Column) -> Column:
    """All noise globs of a contract as one pattern."""
    return pt.any_of(F.transform(F.filter(globs, lambda g: g != ""), pt.glob_regex))


def noise_folders(globs: Column) -> Column:
    return F.filter(globs, lambda g: F.endswith(g, F.lit("/")))


def is_noise(path: Column, regex: Column, folders: Column) -> Column:
    """A glob on the base name or the whole path, or a folder marker anywhere in it."""
    text = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    inside = F.coalesce(F.exists(folders, lambda d: F.contains(text, d)), F.lit(False))
    return (text != "") & (inside | pt.matches(basename(text), regex) | pt.matches(text, regex))


def feed_category(raw: Column, contract_value: Column | None = None) -> Column:
    own = blank_to_null(F.lower(F.trim(raw)))
    if contract_value is not None:
        own = F.coalesce(own, blank_to_null(F.lower(F.trim(contract_value))))
    return lookup(fx.FEED_SPELLINGS, own)


def first_capture(lines: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    """First non-empty capture of each pattern per file, in line order.

    Matching lines are found before the shuffle, and only those travel.
    """
    found = [
        F.struct(F.lit(name).alias("token"), blank_to_null(F.regexp_extract("line", rx, 1)).alias("value"))
        for name, rx in patterns.items()
    ]
    hits = (
        lines.select(key, "line_no", F.inline(F.filter(F.array(*found), lambda s: s["value"].isNotNull())))
    )
    firsts = hits.groupBy(key, "token").agg(F.min_by("value", "line_no").alias("value"))
    return firsts.groupBy(key).agg(
        *[F.max(F.when(F.col("token") == n, F.col("value"))).alias(f"content_{n}") for n in patterns]
    )


def content_verdict(pairs: list[tuple[str, Column, Column]]) -> Column:
    """PASS, or MISFILED_OBJECT when nothing was found or a stated pair differs."""
    none_found, differ = F.lit(True), F.lit(False)
    for _name, file_side, content_side in pairs:
        none_found = none_found & content_side.isNull()
        differ = differ | F.coalesce(file_side != content_side, F.lit(False))
    return F.when(none_found | differ, "MISFILED_OBJECT").otherwise("PASS")
