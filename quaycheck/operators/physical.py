"""Bytes of a landed file: size, checksum, encoding, byte-order mark, line endings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions.common import call, lookup

# Longest prefix of well-formed UTF-8, read on the latin-1 view of the bytes. Possessive, so that
# Java neither backtracks nor recurses on long payloads.
WELL_FORMED = (
    r"^(?:[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}"
    r"|\xF4[\x80-\x8F][\x80-\xBF]{2})*+"
)
UNDEFINED_1252 = r"[\x81\x8D\x8F\x90\x9D]"
BOM = "﻿"


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def encoding_name(declared: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(declared, F.lit("utf-8"))))
    return F.coalesce(lookup(fx.ENCODINGS, key), key)


def bad_prefix(content: Column, encoding: Column) -> Column:
    """Bytes before the first one that is wrong for the encoding; null when all are right."""
    view = latin1(content)
    utf8 = encoding.isin("utf-8", "utf-8-sig")
    first = lambda rx: F.length(F.regexp_extract(view, rx, 0))
    return (
        F.when(utf8 & ~call("is_valid_utf8", content), first(WELL_FORMED))
        .when((encoding == "ascii") & view.rlike(r"[^\x00-\x7F]"), first(r"^[\x00-\x7F]*+"))
        .when((encoding == "cp1252") & view.rlike(UNDEFINED_1252), first(r"^[^\x81\x8D\x8F\x90\x9D]*+"))
    )


def encoding_check(content: Column, declared: Column, allow_fallback: Column) -> Column:
    """struct(ok, requested, used, error_start, offending_byte).

    With fallback allowed, utf-8 and ascii payloads may be read as latin-1 instead, which always works.
    """
    bad = bad_prefix(content, encoding_name(declared))
    byte = F.lower(F.hex(F.substring(content, bad + 1, F.lit(1))))
    return _verdict(bad, byte, declared, allow_fallback)


def encoding_verdict(bad: Column, declared: Column, allow_fallback: Column) -> Column:
    """The same from what a stream found: struct of (at, byte) of the first wrong byte by codec."""
    requested = encoding_name(declared)
    pick = lambda f: F.when(requested.isin("utf-8", "utf-8-sig"), bad["utf8"][f]).when(requested == "ascii", bad["ascii"][f]).when(
        requested == "cp1252", bad["cp1252"][f])
    return _verdict(pick("at"), pick("byte"), declared, allow_fallback)


def _verdict(bad: Column, byte: Column, declared: Column, allow_fallback: Column) -> Column:
    requested = encoding_name(declared)
    known = requested.isin("utf-8", "utf-8-sig", "ascii", "latin-1", "cp1252")
    rescued = F.coalesce(allow_fallback, F.lit(False)) & requested.isin("utf-8", "ascii")
    ok = known & (bad.isNull() | rescued)
    return F.struct(
        ok.alias("ok"),
        requested.alias("requested"),
        F.when(ok & bad.isNull(), requested).when(ok, F.lit("latin-1")).alias("used"),
        F.when(~ok, bad).cast("bigint").alias("error_start"),
        F.when(~ok & bad.isNotNull(), byte).alias("offending_byte"),
    )


def decoded(content: Column, used: Column) -> Column:
    """Text in an encoding that `encoding_check` accepted; null otherwise."""
    return (
        F.when(used == "utf-8", F.decode(content, "UTF-8"))
        .when(used == "utf-8-sig", F.regexp_replace(F.decode(content, "UTF-8"), "^" + BOM, ""))
        .when(used.isin("ascii", "latin-1"), latin1(content))
        .when(used == "cp1252", F.translate(latin1(content), fx.CP1252_BYTES, fx.CP1252_CHARS))
    )


def has_bom(content: Column) -> Column:
    return F.startswith(content, F.lit(b"\xef\xbb\xbf"))


def line_endings(view: Column) -> Column:
    """struct(crlf, lf, cr): which terminators occur in the latin-1 view or text."""
    lone = F.replace(view, F.lit("\r\n"), F.lit(""))
    return F.struct(
        F.contains(view, F.lit("\r\n")).alias("crlf"),
        F.contains(lone, F.lit("\n")).alias("lf"),
        F.contains(lone, F.lit("\r")).alias("cr"),
    )


def line_endings_ok(view: Column, policy: Column) -> Column:
    seen = line_endings(view)
    return (
        F.when(policy == "any", True)
        .when(policy == "crlf", seen["crlf"] & ~seen["lf"] & ~seen["cr"])
        .when(policy == "lf", seen["lf"] & ~seen["crlf"] & ~seen["cr"])
        .when(policy == "cr", seen["cr"] & ~seen["crlf"] & ~seen["lf"])
        .otherwise(False)
    )


def big_enough(length: Column, min_bytes: Column) -> Column:
    return length >= F.coalesce(min_bytes, F.lit(1))


def compression_ok(compression: Column) -> Column:
    return F.coalesce(compression, F.lit("none")) == "none"
