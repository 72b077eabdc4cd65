"""Lines of landed files: splitting, classification, counting, conservation.

Everything works on a `lines` DataFrame (file key, line_no, line), so that a giant file is many
rows in many tasks. Counts are conditional aggregates: each task reduces its lines to one row per
file before the shuffle, so a hot file costs no more than a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaycheck.functions import patterns as pt
from quaycheck.functions.common import blank_to_null, call


# -- splitting -------------------------------------------------------------------------------

def _without_last(text: Column, *ends: str) -> Column:
    """The text without one final terminator, the first of the given ones that fits."""
    out = None
    for end in ends:
        cut = F.substring(text, F.lit(1), F.length(text) - len(end))
        fits = F.endswith(text, F.lit(end))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(text)


def _parts(text: Column, terminator: str, *ends: str) -> Column:
    """Split once, without the empty part after a final terminator."""
    return F.split(_without_last(text, *(ends or (terminator,))), terminator)


def split_any(text: Column) -> Column:
    """Lines under any of the three terminators; an empty text has none."""
    return F.when(text != "", _parts(text, "\r\n|\r|\n", "\r\n", "\n", "\r")).otherwise(F.array().cast("array<string>"))


def split_strict(text: Column, policy: Column) -> Column:
    """struct(lines, segments, skipped) under one declared terminator.

    Runs of NUL and terminators of another kind are dropped and counted as skipped; segments is
    counted from the terminators alone, independently of the lines.
    """
    plain = F.replace(text, F.lit("\x00"), F.lit(""))
    nul_runs = F.regexp_count(text, F.lit("\x00+"))
    has_pair = F.contains(plain, F.lit("\r\n"))
    lone = F.replace(plain, F.lit("\r\n"), F.lit(""))
    strays = F.length(lone) - F.length(F.translate(lone, "\r\n", ""))
    only_pairs = F.regexp_replace(plain, r"\r(?!\n)|(?<!\r)\n", "")
    no_cr = F.replace(plain, F.lit("\r"), F.lit(""))
    crs = F.length(plain) - F.length(no_cr)

    clean = (
        F.when((policy == "crlf") & has_pair, only_pairs)
        .when(policy == "lf", no_cr)
        .otherwise(plain)
    )
    universal = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
    lines = (
        F.when(clean == "", F.array().cast("array<string>"))
        .when((policy == "crlf") & has_pair, _parts(clean, "\r\n"))
        .when(policy == "lf", _parts(clean, "\n"))
        .when(policy == "cr", _parts(clean, "\r"))
        .otherwise(_parts(clean, universal, "\r\n", *"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"))
    )
    end = F.when(policy == "lf", "\n").when(policy == "cr", "\r").otherwise("\r\n")
    ends = call("regexp_count", clean, end)
    by_terminator = policy.isin("lf", "cr") | ((policy == "crlf") & has_pair)
    segments = F.when(
        by_terminator, ends + F.when((clean != "") & ~F.endswith(clean, end), 1).otherwise(0)
    ).otherwise(F.size(lines))
    skipped = nul_runs + (
        F.when((policy == "crlf") & has_pair, strays).when(policy == "lf", crs).otherwise(0)
    )
    return F.struct(lines.alias("lines"), segments.cast("bigint").alias("segments"),
                    skipped.cast("bigint").alias("skipped"))


def explode_lines(df: DataFrame, lines: Column, *keep: str) -> DataFrame:
    """One row per line, numbered from 0 as in the file."""
    return df.select(*keep, F.posexplode(lines).alias("line_no", "line"))


# -- row shape -------------------------------------------------------------------------------

def field_count(line: Column, delimiter: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    return F.when(line == "", 0).otherwise(F.size(call("split", line, quoted)))


def shape_ok(line: Column, delimiter: Column, exact: Column, least: Column, most: Column) -> Column:
    n = field_count(line, delimiter)
    return F.when(exact.isNotNull(), n == exact).otherwise(
        F.coalesce(n >= least, F.lit(True)) & F.coalesce(n <= most, F.lit(True))
    )


# -- classification --------------------------------------------------------------------------

def shell_class(line: Column, header: Column, footer: Column, ignore: Column, reject: Column,
                well_shaped: Column) -> Column:
    """header/footer, then ignored, then rejected; what is left is accepted if its shape is right."""
    return (
        F.when(pt.matches(line, header) | pt.matches(line, footer), "header_footer")
        .when(pt.matches(line, ignore), "ignored")
        .when(pt.matches(line, reject), "rejected")
        .when(well_shaped, "accepted")
        .otherwise("quarantined")
    )


def engine_class(line: Column, header: Column, footer: Column, ignore: Column) -> Column:
    """ignore, header, footer, else data. Without header and footer patterns see `with_default_header`."""
    return (
        F.when(pt.matches(line, ignore), "ignore")
        .when(pt.matches(line, header), "header")
        .when(pt.matches(line, footer), "footer")
        .otherwise("data")
    )


def with_default_header(lines: DataFrame, key: str, classes: str = "row_class",
                        applies: Column | None = None) -> DataFrame:
    """Turns the first line that is not ignored into the header, where no pattern says what one is.

    The first line number per file is a plain aggregate; it is joined back on (file, line number),
    a key no file can make hot.
    """
    due = F.col(classes) == "data"
    if applies is not None:
        due = due & applies
    first = (
        lines.where(due).groupBy(key).agg(F.min("line_no").alias("line_no"))
        .withColumn("is_first", F.lit(True))
    )
    return (
        lines.join(first, [key, "line_no"], "left")
        .withColumn(classes, F.when(F.col("is_first"), "header").otherwise(F.col(classes)))
        .drop("is_first")
    )


def count_classes(lines: DataFrame, key: str, names: list[str], classes: str = "row_class") -> DataFrame:
    return lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(classes) == n).alias(f"{n}_rows") for n in names],
    )


# -- declared counts and conservation --------------------------------------------------------

def declared_value(line: Column, pattern: Column, names: list[str], first_group: bool) -> Column:
    """The count a line declares: the first filled group of the given names, else group 1."""
    choices = [pt.group(line, pattern, n) for n in names]
    if first_group:
        choices.append(F.when(F.size(pattern["names"]) > 0, blank_to_null(call("regexp_extract", line, pattern["regex"], 1))))
    return F.when(pt.matches(line, pattern["regex"]), F.coalesce(*choices).try_cast("bigint"))


ENGINE_COUNT_NAMES = ["declared_row_count", "declared_count", "count", "rows"]
SHELL_COUNT_NAMES = ["declared_row_count", "declared_total"]


def first_declared(value: Column, line_no: Column) -> Column:
    """Aggregate: the first usable declaration in file order."""
    return F.min_by(value, F.when(value.isNotNull(), line_no))


def engine_conserved(data_rows: Column, declared: Column) -> Column:
    return declared.isNull() | (declared == data_rows)


def unaccounted(declared: Column, observed: Column, segments: Column, total: Column,
                bucketed: Column, skipped: Column) -> Column:
    """Rows that cannot be explained: against the declaration if any, else against the segments."""
    gap = F.when(declared.isNotNull(), F.abs(declared - observed)).otherwise(
        F.when(segments != total, F.abs(segments - total)).otherwise(F.abs(segments - bucketed))
    )
    return gap + skipped


# -- content dates, sections, slots ----------------------------------------------------------

def date_tokens(lines: DataFrame, key: str, regex: str, java_format: str, group: int = 1) -> DataFrame:
    """All date tokens in the lines, with their parsed value (null if unparseable)."""
    return lines.select(
        key, F.explode(call("regexp_extract_all", F.col("line"), regex, group)).alias("token")
    ).withColumn("day", call("try_to_date", F.col("token"), java_format))


def date_bounds(tokens: DataFrame, key: str, floor: Column, as_of: Column, allow_future: Column, files: DataFrame | None = None) -> DataFrame:
    """Per file: earliest and latest date and the verdict. `files` names all files, so that those without a date show up."""
    seen = tokens.groupBy(key).agg(
        F.count(F.lit(1)).alias("dates_seen"),
        F.count_if(F.col("day").isNull()).alias("unparseable"),
        F.min("day").alias("earliest"),
        F.max("day").alias("latest"),
    )
    if files is not None:
        zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
        seen = files.select(key).join(seen, key, "left").select(key, zero("dates_seen"), zero("unparseable"), "earliest", "latest")
    return seen.withColumn("verdict", date_verdict(
        F.col("dates_seen"), F.col("unparseable"), F.col("earliest"), F.col("latest"), floor, as_of, allow_future))


def date_verdict(seen: Column, unparseable: Column, earliest: Column, latest: Column,
                 floor: Column, as_of: Column, allow_future: Column) -> Column:
    return (
        F.when(F.coalesce(unparseable, F.lit(0)) > 0, "UNPARSEABLE")
        .when(F.coalesce(seen, F.lit(0)) == 0, "NO_DATES")
        .when(earliest < floor, "BELOW_FLOOR")
        .when(~allow_future & (latest > as_of), "FUTURE")
        .otherwise("PASS")
    )


def section_inventory(lines: DataFrame, key: str, sections: list[tuple[str, str, bool]]) -> DataFrame:
    """Markers found and required markers missing per file; one pass, one flag per section."""
    flags = [F.bool_or(F.col("line").rlike(rx)).alias(f"has_{name}") for name, rx, _ in sections]
    found = F.array_compact(F.array(*[F.when(F.col(f"has_{n}"), F.lit(n)) for n, _, _ in sections]))
    gone = F.array_compact(F.array(*[
        F.when(~F.col(f"has_{n}") & F.lit(req), F.lit(n)) for n, _, req in sections
    ]))
    return lines.groupBy(key).agg(*flags).select(key, found.alias("found"), gone.alias("missing"))


def section_hits(lines: DataFrame, key: str, sections: str) -> DataFrame:
    """Section ids whose marker occurs, per file; `sections` is an array<struct<id,regex>> column."""
    hit = F.transform(
        F.filter(sections, lambda s: pt.matches(F.col("line"), s["regex"])), lambda s: s["id"]
    )
    return lines.select(key, F.explode(hit).alias("section_id")).distinct()


def slot_counts(lines: DataFrame, key: str, slots: Column) -> DataFrame:
    """Occurrences of every slot per file; the map-side combine shrinks hot files first."""
    return lines.select(key, F.explode(slots).alias("slot")).groupBy(key, "slot").agg(
        F.count(F.lit(1)).alias("hits"))


def slot_inventory(lines: DataFrame, key: str, slots: Column, expected: Column,
                   mode: str = "distinct_slots") -> DataFrame:
    """Slots per file: distinct ones, most per row, or all matches, against the expected number."""
    per_line = F.size(slots).cast("bigint")
    if mode == "max_per_row":
        out = lines.groupBy(key).agg(F.max(per_line).alias("detected"))
    elif mode == "total_matches":
        out = lines.groupBy(key).agg(F.sum(per_line).alias("detected"))
    else:
        # explode_outer keeps files without any slot; distinct in two steps spreads a hot file
        out = (
            lines.select(key, F.explode_outer(slots).alias("slot")).distinct()
            .groupBy(key).agg(F.count("slot").alias("detected"))
        )
    surplus = F.greatest(F.col("detected") - expected, F.lit(0)) if mode == "distinct_slots" else F.lit(0)
    verdict = (
        F.when(F.col("detected") < expected, "BELOW_EXPECTED").when(F.col("surplus") > 0, "UNMAPPED").otherwise("PASS")
    )
    return out.withColumn("surplus", surplus.cast("bigint")).withColumn("slot_verdict", verdict)


def surplus_slots(slots: DataFrame, key: str, expected: Column) -> DataFrame:
    """Distinct slots beyond the expected number, in sorted order: one row each."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("slot"))
    return slots.withColumn("rank", rank).where(F.col("rank") > expected)
