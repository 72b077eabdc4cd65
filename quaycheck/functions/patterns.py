"""Patterns as data: named groups, globs, path templates, date formats.

Contracts carry their patterns as columns, so all rewriting happens in Spark. Java's regex engine
rejects group names with underscores, so named groups become numbered ones plus a list of names
(position = group number, '' for an unnamed group). A pattern Java cannot compile would fail the
whole job; `compiled` turns it into null first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaycheck.functions.common import blank_to_null, call

# Date directives of a contract -> letters of a Spark date pattern.
DATE_LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%y": "yy", "%j": "DDD", "%H": "HH",
                "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM"}

NAMED_GROUP = r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>"
GROUP_OPENER = r"\((?:\?P?<([A-Za-z_][A-Za-z0-9_]*)>|(?!\?))"


def numbered(pattern: Column) -> Column:
    """The pattern with named groups, in either spelling, made plain groups."""
    return F.regexp_replace(pattern, NAMED_GROUP, "(")


def group_names(pattern: Column) -> Column:
    """Name of every capturing group in order; '' where a group has none."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[\^?\]?[^\]]*\]", "")
    return call("regexp_extract_all", bare, GROUP_OPENER, 1)


def is_valid(pattern: Column) -> Column:
    return call("try_reflect", "java.util.regex.Pattern", "compile", pattern).isNotNull()


def compiled(pattern: Column, anchored: bool = False) -> Column:
    """struct(source, regex, names): regex is null when the pattern is absent or invalid."""
    source = blank_to_null(pattern)
    plain = numbered(source)
    if anchored:
        plain = F.concat(F.lit("^(?:"), plain, F.lit(")"))
    return F.struct(
        source.alias("source"),
        F.when(is_valid(plain), plain).alias("regex"),
        group_names(source).alias("names"),
    )


def literal_pattern(pattern: str | None, anchored: bool = False) -> Column:
    return compiled(F.lit(pattern).cast("string"), anchored)


def any_of(patterns: Column) -> Column:
    """One alternation out of a list of patterns; invalid ones are dropped, none gives null."""
    plain = F.transform(F.filter(patterns, lambda p: p.isNotNull() & (p != "")), numbered)
    good = F.filter(plain, is_valid)
    return blank_to_null(F.array_join(F.transform(good, lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|"))


def matches(text: Column, regex: Column) -> Column:
    """Whether a column-valued pattern is found; False rather than null when there is none.

    `regexp_instr` keeps the last compiled pattern from row to row; `rlike` would compile a pattern
    that is not a literal anew for every row.
    """
    return F.coalesce(call("regexp_instr", text, regex) > 0, F.lit(False))


def group(text: Column, pattern: Column, name: str) -> Column:
    """Text of a named group; null when absent, empty or not matched."""
    at = F.array_position(pattern["names"], F.lit(name)).cast("int")
    return F.when(at > 0, blank_to_null(call("regexp_extract", text, pattern["regex"], at)))


def groups(text: Column, pattern: Column) -> Column:
    """map<string,string> of all named groups that captured something; of groups with one name the first counts."""
    names = pattern["names"]
    numbers = F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: (F.element_at(names, i) != "") & (F.array_position(names, F.element_at(names, i)) == i))
    entries = F.transform(
        F.when(F.size(names) > 0, numbers).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.element_at(names, i).alias("key"),
            blank_to_null(call("regexp_extract", text, pattern["regex"], i.cast("int"))).alias("value"),
        ),
    )
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.coalesce(F.map_from_entries(kept), F.create_map().cast("map<string,string>"))


def glob_regex(glob: Column) -> Column:
    """Shell glob to a full-match regex: * and ? are wild, [..] is a class, the rest is literal."""
    quoted = F.regexp_replace(glob, r"([\\.^$|+(){}])", r"\\$1")
    wild = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("^(?s:"), F.regexp_replace(wild, r"\[!", "[^"), F.lit(")$"))


def template_pattern(template: Column) -> Column:
    """Path template with {token} parts: each token is one path segment, a tail is allowed."""
    bare = F.regexp_replace(template, "/+$", "")
    quoted = F.regexp_replace(bare, r"([\\.^$|+()\[\]*?\-])", r"\\$1")
    tokens = F.regexp_replace(quoted, r"\{([A-Za-z_][A-Za-z0-9_]*)\}", "(?<$1>[^/]+)")
    return compiled(F.concat(tokens, F.lit("(?:/.*)?$")))


def date_format(directives: Column) -> Column:
    """Spark date pattern of a contract's directives; null if one of them is unknown.

    Letters and signs that are not directives are quoted, as Spark would take them for fields.
    """
    known = "".join(d[1] for d in DATE_LETTERS)
    strange = directives.rlike(f"%(?![{known}])")
    out = F.regexp_replace(F.replace(directives, F.lit("'"), F.lit("''")), r"(?<=%[A-Za-z]|[^%A-Za-z]|^)([A-Za-z\[\]{}#]+)", "'$1'")
    for directive, letters in DATE_LETTERS.items():
        out = F.replace(out, F.lit(directive), F.lit(letters))
    return F.when(~strange, out)


def java_date_format(directives: str) -> str:
    for directive, letters in DATE_LETTERS.items():
        directives = directives.replace(directive, letters)
    return directives
