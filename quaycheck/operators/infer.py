"""What a sample file looks like: format, encoding, delimiter, headers, tokens in its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions.common import blank_to_null, call, lookup
from quaycheck.operators.physical import latin1

DELIMITERS = [",", "\t", "|", ";"]
SAMPLE_BYTES = 256_000


def sample(content: Column, max_bytes: int = SAMPLE_BYTES) -> Column:
    """The part of a file inference looks at; the limit is the feature's own, an option."""
    return F.substring(content, 1, max_bytes)


def encoding(content: Column) -> Column:
    return F.when(call("is_valid_utf8", content), "utf-8").otherwise("iso-8859-1")


def text(content: Column) -> Column:
    return F.when(call("is_valid_utf8", content), F.decode(content, "UTF-8")).otherwise(latin1(content))


def first_line(body: Column) -> Column:
    return F.trim(F.regexp_extract(body, r"^\s*(\S[^\r\n]*)", 1))


def line_total(body: Column) -> Column:
    """Lines that are not blank, counted without building them."""
    return F.regexp_count(body, F.lit(r"(?m)^[^\S\r\n]*\S"))


def file_format(first: Column) -> Column:
    return (
        F.when(first.rlike(r"^[{\[]"), "json")
        .when(F.startswith(first, F.lit("<")) & ~F.startswith(first, F.lit("<?csv")), "xml")
        .otherwise("delimited_text")
    )


def delimiter(first: Column) -> Column:
    """Most frequent candidate; the earlier one on a tie, a comma when there is none."""
    occurs = lambda d: F.length(first) - F.length(F.replace(first, F.lit(d), F.lit("")))
    votes = F.array(*[F.struct(occurs(d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    best = F.array_max(votes)
    return F.when(F.coalesce(best["n"], F.lit(0)) > 0, best["d"]).otherwise(",")


def clean_header(value: Column) -> Column:
    t = F.trim(value)
    inner = F.trim(F.regexp_replace(t, "^(['\"])(.*)\\1$", "$2"))
    return F.replace(inner, F.lit('""'), F.lit('"'))


def headers(first: Column, sep: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    return F.transform(call("split", first, quoted), clean_header)


def report_type(name: Column) -> Column:
    low = F.lower(name)
    base = F.regexp_extract(name, "[^/]*$", 0)
    named = F.lower(blank_to_null(F.regexp_extract(base, r"(?i)^([a-z_]+)_[A-Z0-9\.]+_\d{4}-\d{2}-\d{2}", 1)))
    return (
        F.when(F.contains(low, F.lit("header")), "headers_data")
        .when(F.contains(low, F.lit("payment")), "payments_data")
        .when(F.contains(low, F.lit("sale")), "sales_data")
        .otherwise(F.coalesce(named, F.lit("sales_data")))
    )


NAME_TOKENS = r"(?i)^([A-Za-z0-9_]+)_([A-Z0-9\.]+)_(\d{4}-\d{2}-\d{2})(?:__([a-f0-9]+))?"


def name_tokens(name: Column) -> Column:
    """struct(report_type, property, date, hash): hints for a naming pattern."""
    base = F.regexp_extract(name, "[^/]*$", 0)
    part = lambda i: blank_to_null(F.regexp_extract(base, NAME_TOKENS, i))
    return F.struct(
        F.coalesce(part(1), report_type(name)).alias("report_type"), part(2).alias("property"),
        F.coalesce(part(3), F.lit("YYYY-MM-DD")).alias("date"), part(4).alias("hash"))


def suggested_pattern(fmt: Column) -> Column:
    return lookup(fx.SUGGESTED_PATTERN, fmt)
