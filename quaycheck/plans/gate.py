"""The four gates over a table of landed files.

Two steps. The first reads payloads: names, bytes and encodings are judged on the file's own row,
lines are exploded and reduced to one row per file inside the task, and only those reductions are
shuffled. Its result, one narrow row per file, is staged. The second step brings in siblings, commit
markers and history, which was reduced to days and hashes (see operators.anomaly); it never sees a
payload again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions import patterns as pt
from quaycheck.functions.common import blank_to_null, call, details
from quaycheck.functions.dates import iso_business_date, parse_business_date
from quaycheck.operators import anomaly, identity, lines, manifest, outcome, physical, quality, revenue, sets
from quaycheck.session import staged
from quaycheck.sources import control, landing

SCOPE = ["property_id", "report_type"]


@dataclass
class GateRun:
    """reports: one row per file. violations: one row per offending data row and rule."""

    reports: DataFrame
    violations: DataFrame

    def findings(self) -> DataFrame:
        return outcome.flat_findings(
            self.reports, ["file_id"], [("gate_1", "g1"), ("gate_2", "g2"), ("gate_3", "g3"), ("gate_4", "g4")])

    def manifest(self) -> DataFrame:
        """Items with up to three sample records each; what blocks a run without any finding of its own has one too."""
        items = manifest.manifest_items(self.findings(), self.violations, "file_id", record="record")
        more = manifest.guaranteed_items(self.reports, items, "file_id").withColumn("samples", F.array().cast(items.schema["samples"].dataType))
        return items.unionByName(more)


def evaluate(landed: DataFrame, contracts: DataFrame, history: DataFrame, as_of: Column,
             siblings: DataFrame | None = None, inventory: DataFrame | None = None) -> GateRun:
    """Scores every landed file.

    landed: file_id, batch_id, property_id, contract_id, filename, path, content.
    contracts: `contracts.normalise` output keyed by contract_id.
    history: property_id, report_type, business_date, overall_outcome, checksum_sha256, row_count, net_amount.
    siblings: batch_id, contract_id, filename of other files of a batch (default: the landed ones).
    inventory: object_key of everything in the landing zone, for commit markers (default: the landed ones).
    """
    contracts = staged(contracts, "contracts")
    files = _from_content(_named(landed, contracts))
    rows = lambda f: f.select(*OF_LINES, "header", "header_no", F.posexplode("lines").alias("line_no", "line"))
    narrow = files.drop("content", "lines", *PATTERNS)
    facts = staged(narrow.join(_per_file(_body(rows(files))), "file_id", "left"), "facts")
    # offending rows are looked up only in the payloads that have any
    suspects = facts.where(F.col("bad_rows") > 0).select("file_id")
    bad = _body(rows(_from_content(_named(landed.join(suspects, "file_id", "left_semi"), contracts))))
    return _judged(facts, landed, contracts, history, as_of, siblings, inventory, bad)


def evaluate_split(landed: DataFrame, lines_read: DataFrame, contracts: DataFrame, history: DataFrame, as_of: Column,
                   siblings: DataFrame | None = None, inventory: DataFrame | None = None) -> GateRun:
    """Scores files of any size: the same reports as `evaluate`, from lines that Spark read in splits.

    landed: as for `evaluate`, with `uri` and the columns of `landing.payload_facts` in place of content.
    lines_read: `landing.read_splits` of the landed files.

    A file's lines meet its contract on (file, stretch of the file), so a huge file is dealt like many small ones.
    Scans of the text: one finds every file's header line and counts each split, one fetches the header lines, one
    reduces all lines. Lines are numbered by their place in the split and the sums of the splits before.
    """
    contracts = staged(contracts, "contracts")
    files = staged(_physical(_named(landed, contracts)).drop(*FACTS), "split-files")
    lines_read = _marked(lines_read, files)
    of_line = _split_lines(lines_read, files)

    flagged = of_line.withColumn("heads", _is_header(F.col("line")))
    splits = flagged.groupBy("file_id", "split_at").agg(
        F.min("seen").alias("first_seen"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("heads"), F.col("seen"))).alias("head_seen"))
    before = Window.partitionBy("file_id").orderBy("split_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = staged(splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "splits")

    # the line that names the columns: the first header line, or the first line where none is marked
    first = splits.groupBy("file_id").agg(
        F.min(F.when(F.col("head_seen").isNotNull(), F.col("split_at"))).alias("marked"), F.min("split_at").alias("start"))
    first = first.select("file_id", F.coalesce("marked", "start").alias("split_at")).join(splits, ["file_id", "split_at"])
    first = first.select("file_id", "split_at", F.coalesce("head_seen", "first_seen").alias("seen"),
                         (F.coalesce("head_seen", "first_seen") - F.col("first_seen") + F.col("offset")).cast("int").alias("header_no"))
    heads = of_line.join(first, ["file_id", "split_at", "seen"]).select(
        "file_id", "header_no", quality.csv_fields(F.col("line"), F.col("delimiter")).alias("header"))
    files = files.join(heads, "file_id", "left").withColumns({
        "header": F.coalesce("header", F.array().cast("array<string>")), "header_no": F.coalesce("header_no", F.lit(0))})
    files = staged(files, "headed-files")

    places = splits.select("file_id", "split_at", (F.col("offset") - F.col("first_seen")).alias("shift"))
    numbered = lambda f: _split_lines(lines_read, f, "header", "header_no").join(places, ["file_id", "split_at"]).withColumn(
        "line_no", (F.col("seen") + F.col("shift")).cast("int")).select(*OF_LINES, "header", "header_no", "line_no", "line")
    facts = staged(files.drop(*PATTERNS, "uri").join(_per_file(_body(numbered(files))), "file_id", "left"), "facts")
    suspects = files.join(facts.where(F.col("bad_rows") > 0).select("file_id"), "file_id", "left_semi")
    return _judged(facts, landed, contracts, history, as_of, siblings, inventory, _body(numbered(suspects)))


def _split_lines(lines_read: DataFrame, files: DataFrame, *more: str) -> DataFrame:
    """Lines with what their file's contract says about them; as text in the encoding found for the file."""
    dims = files.where(~F.col("is_object") & (F.col("length") > 0)).select(
        *OF_LINES, *more, landing.same_form(F.col("uri")).alias("uri"), F.col("enc.used").alias("used"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("length") / landing.STRETCH))).alias("stretch"))
    lines_of = lines_read.withColumn("stretch", F.floor(F.col("split_at") / landing.STRETCH)).join(dims, ["uri", "stretch"])
    text = F.coalesce(physical.decoded(F.col("raw"), F.col("used")), physical.latin1(F.col("raw")))
    # a byte-order mark belongs to the text unless the encoding says otherwise
    mark = F.when(F.col("used") == "utf-8", physical.BOM).otherwise("\u00ef\u00bb\u00bf")
    lost = F.col("at_start") & ~F.col("used").eqNullSafe("utf-8-sig")
    return lines_of.withColumn("line", F.when(lost, F.concat(mark, text)).otherwise(text)).drop("raw", "used", "at_start", "uri", "stretch")


def _marked(lines_read: DataFrame, files: DataFrame) -> DataFrame:
    """Lines with a mark at the first one of files that begin with a byte-order mark, which the reader drops."""
    with_mark = files.where("has_bom").select(landing.same_form(F.col("uri")).alias("uri"), F.col("length"), F.col("enc.used").alias("used"))
    if not with_mark.limit(1).count():
        return lines_read.withColumn("at_start", F.lit(False))
    start = lines_read.where("split_at = 0").join(with_mark, "uri").groupBy("uri", "split_at").agg(F.min("seen").alias("seen"))
    start = staged(start.withColumn("at_start", F.lit(True)), "marked")
    marked = lines_read.join(start, ["uri", "split_at", "seen"], "left").withColumn("at_start", F.coalesce("at_start", F.lit(False)))
    alone = with_mark.where((F.col("length") == 3) & ~F.col("used").eqNullSafe("utf-8-sig")).select(
        "uri", F.lit(0).cast("bigint").alias("split_at"), F.lit(0).cast("bigint").alias("seen"), F.lit(b"").alias("raw"), F.lit(True).alias("at_start"))
    return marked.unionByName(alone)


def _judged(facts: DataFrame, landed: DataFrame, contracts: DataFrame, history: DataFrame, as_of: Column,
            siblings: DataFrame | None, inventory: DataFrame | None, bad: DataFrame) -> GateRun:
    """Second step: siblings, markers and history, on one narrow row per file."""
    present = _present(facts, siblings, contracts)
    keys = inventory if inventory is not None else landed.select(
        identity.object_key(F.coalesce(blank_to_null(F.col("path")), F.col("filename"))).alias("object_key"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    joined = facts.join(
        present, same("batch_id", "_b") & same("contract_id", "_c") & same("property", "_p") & same("date", "_d"), "left"
    ).drop("_b", "_c", "_p", "_d")
    joined = sets.commit_markers(joined, keys, "key", F.when(F.col("is_object"), F.col("commit_marker")))
    joined = sets.delta_logs(joined, keys, "key", F.col("is_object") & (F.col("object_format") == "Delta"))
    first = outcome.with_ladder(outcome.with_ladder(joined, "as_file", _file_ladder()), "as_object", _object_ladder())
    first = first.withColumn("g1", F.when(F.col("is_object"), F.col("as_object")).otherwise(F.col("as_file"))).drop("as_file", "as_object")
    first = staged(first.withColumns({
        "g1_outcome": outcome.ladder_outcome(F.col("g1")),
        "g1_reason": F.coalesce(outcome.first_failure(F.col("g1"))["message"], F.lit("All extraction checks passed.")),
    }), "gate1")
    reports = _report(_gate_three_four(_gate_two(first, history, as_of)), as_of)
    violations = bad.where(F.size("bad") > 0).select("file_id", F.lit("gate_3").alias("gate"), "row_no", "line", F.inline("bad")).select(
        "file_id", "gate", F.col("rule").alias("rule_name"), "row_no", "column", "value", F.col("line").alias("record"))
    return GateRun(reports, violations)


# -- facts on the file's own row -------------------------------------------------------------

PATTERNS = ["header_re", "footer_re", "ignore_re", "count_pattern", "name_pattern", "path_pattern", "partition_pattern", "noise_re", "noise_dirs"]
#: What the rules about lines need of the file.
OF_LINES = ["file_id", "delimiter", "patterned", "header_re", "footer_re", "ignore_re", "count_pattern",
            "non_null_columns", "numeric_columns", "numeric_ranges", "header_total_columns", "line_amount_columns",
            "tax_columns", "net_sales_columns", "tender_columns"]
#: Facts about a payload's bytes that `_physical` turns into verdicts.
FACTS = [f for f in landing.FACTS if f not in ("length", "checksum", "has_bom")]


def _named(landed: DataFrame, contracts: DataFrame) -> DataFrame:
    """What names and paths say."""
    c = contracts.drop("property_code") if "property_code" in landed.columns else contracts
    files = landed.join(c, "contract_id", "left")
    files = identity.with_identity(files, "filename", "name_pattern", F.col("required_groups"))
    key = identity.object_key(F.coalesce(blank_to_null(F.col("path")), F.col("filename")))
    files = (
        files.withColumn("key", key)
        .withColumn("is_object", F.coalesce("is_object", F.lit(False)))
        .withColumn("noisy", identity.is_noise(F.coalesce(blank_to_null(F.col("path")), F.col("filename")), F.col("noise_re"), F.col("noise_dirs"))
                    | identity.is_noise(F.col("filename"), F.col("noise_re"), F.col("noise_dirs")))
        .withColumn("has_name_pattern", F.col("name_pattern.source").isNotNull())
        .withColumn("name_pattern_valid", F.col("name_pattern.regex").isNotNull())
        .withColumn("has_path_pattern", F.col("path_pattern.source").isNotNull())
        .withColumn("path_tokens", pt.groups(F.col("key"), F.col("path_pattern")))
        .withColumn("path_matches", pt.matches(F.col("key"), F.col("path_pattern.regex")))
        .withColumn("part_tokens", identity.partition_tokens(F.col("key"), F.col("partition_pattern"), F.col("property_code"),
                                                             F.col("feed_category"), F.col("object_format")))
        .withColumn("tokens", F.when(F.col("is_object"), F.coalesce("part_tokens", F.create_map().cast("map<string,string>"))).otherwise(F.col("tokens")))
        .withColumn("patterned", F.col("header_re").isNotNull() | F.col("footer_re").isNotNull())
    )
    for t in ("property", "report_type", "date"):
        files = files.withColumn(t, F.element_at("tokens", t))
    return files


def _watermark(first_line: Column) -> Column:
    return F.when(F.col("is_object") & (F.col("object_format") == "JSONL"), sets.watermark_verdict(first_line, F.col("watermark_column")))


def _physical(files: DataFrame) -> DataFrame:
    """Verdicts on bytes from facts that a stream over the payload gathered."""
    bad = F.struct(*[F.struct(F.col(f"bad_{n}").alias("at"), F.col(f"bad_{n}_byte").alias("byte")).alias(n) for n in landing.CODECS])
    return (
        files.withColumn("length", F.coalesce("length", F.lit(0).cast("bigint")))
        .withColumn("checksum", F.when(F.col("length") > 0, F.col("checksum")))
        .withColumn("enc", physical.encoding_verdict(bad, F.col("encoding"), F.col("allow_fallback")))
        .withColumn("has_bom", F.coalesce("has_bom", F.lit(False)))
        .withColumn("watermark", _watermark(F.col("first_line")))
    )


def _is_header(line: Column) -> Column:
    return F.when(F.col("patterned"), ~pt.matches(line, F.col("ignore_re")) & pt.matches(line, F.col("header_re"))).otherwise(
        ~pt.matches(line, F.col("ignore_re")))


def _from_content(files: DataFrame) -> DataFrame:
    """Verdicts on bytes and lines of payloads that are columns."""
    enc = physical.encoding_check(F.col("content"), F.col("encoding"), F.col("allow_fallback"))
    files = (
        files.withColumn("length", F.coalesce(F.length("content"), F.lit(0)))
        .withColumn("checksum", F.when(F.col("length") > 0, physical.checksum(F.col("content"))))
        .withColumn("enc", enc)
        .withColumn("watermark", _watermark(sets.first_line(F.when(call("is_valid_utf8", F.col("content")), F.decode("content", "UTF-8")))))
    )
    # what later gates read; payloads that fail their encoding are read as latin-1
    text = F.when(F.col("is_object") | (F.col("length") == 0), F.lit("")).otherwise(
        F.coalesce(physical.decoded(F.col("content"), F.col("enc.used")), physical.latin1(F.col("content"))))
    files = files.withColumn("lines", lines.split_any(text))
    at, c_at = F.array_position(F.transform("lines", _is_header), F.lit(True)).cast("int"), F.col("_at")
    return (
        files.withColumn("_at", at)
        # the line that names the columns: the first header line, or the first line where none is marked
        .withColumn("header_no", F.when(c_at > 0, c_at - 1).otherwise(0)).drop("_at")
        .withColumn("header", F.when(F.size("lines") > 0, quality.csv_fields(F.get("lines", F.col("header_no")), F.col("delimiter"))).otherwise(
            F.array().cast("array<string>")))
    )


# -- lines -----------------------------------------------------------------------------------

def _body(rows: DataFrame) -> DataFrame:
    """Numbered lines with their class and, for data lines, cells, violations and amounts."""
    by_pattern = lines.engine_class(F.col("line"), F.col("header_re"), F.col("footer_re"), F.col("ignore_re"))
    rows = rows.withColumn("row_class", F.when(F.col("patterned"), by_pattern).otherwise(
        F.when(pt.matches(F.col("line"), F.col("ignore_re")), "ignore").when(F.col("line_no") == F.col("header_no"), "header").otherwise("data")))
    is_data = F.col("row_class") == "data"
    rows = (
        rows.withColumn("declared", lines.declared_value(F.col("line"), F.col("count_pattern"), lines.ENGINE_COUNT_NAMES, True))
        .withColumn("row_no", F.col("line_no") - F.col("header_no") - 1)
        .withColumn("cells", F.when(is_data & (F.col("row_no") >= 0), quality.cells(quality.csv_fields(F.col("line"), F.col("delimiter")), F.col("header"))))
    )
    cell = lambda c: F.element_at("cells", c)
    known = lambda c: F.array_contains("header", c)
    bad = lambda rule, c, v: F.struct(F.lit(rule).alias("rule"), c.alias("column"), v.alias("value"))
    nulls = F.transform(F.filter("non_null_columns", lambda c: known(c) & cell(c).isNull()),
                        lambda c: bad("non_null_constraints", c, F.lit(None).cast("string")))
    poison = F.transform(F.filter("numeric_columns", lambda c: quality.is_poison(cell(c))),
                         lambda c: bad("numeric_column_integrity", c, cell(c)))
    out = F.transform(F.filter("numeric_ranges", lambda r: F.coalesce(
        (quality.number(cell(r["column"])) < r["min_value"]) | F.lit(False), F.lit(False)) | F.coalesce(
        quality.number(cell(r["column"])) > r["max_value"], F.lit(False))),
        lambda r: bad("numeric_range_bounds", r["column"], cell(r["column"])))
    none = F.array().cast("array<struct<rule:string,column:string,value:string>>")
    return rows.withColumn("bad", F.when(F.col("cells").isNotNull(), F.concat(nulls, poison, out)).otherwise(none))


def _per_file(body: DataFrame) -> DataFrame:
    """One row per file. Every aggregate has a fixed-size buffer, so Spark hashes and combines early."""
    has = lambda rule: F.exists("bad", lambda b: b["rule"] == rule)
    first_value, first_order = revenue.first_number(F.col("cells"), F.col("header_total_columns"), F.col("line_no"))
    one = lambda aliases: F.array_compact(F.array(revenue.first_alias(F.col("header"), F.col(aliases))))
    here = lambda aliases: revenue.aliases_present(F.col("header"), F.col(aliases))
    total = lambda names: F.sum(F.when((F.size(names) > 0) & F.col("cells").isNotNull(), revenue.row_sum(F.col("cells"), names)))
    return body.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col("row_class") == n).alias(f"{n}_rows") for n in ("header", "data", "footer", "ignore")],
        lines.first_declared(F.col("declared"), F.col("line_no")).alias("declared_count"),
        F.count_if(has("non_null_constraints")).alias("null_rows"),
        F.count_if(has("numeric_column_integrity")).alias("poison_rows"),
        F.count_if(has("numeric_range_bounds")).alias("range_rows"),
        F.count_if(F.size("bad") > 0).alias("bad_rows"),
        F.min_by(first_value, F.when(first_value.isNotNull(), first_order)).alias("header_total"),
        total(here("line_amount_columns")).alias("line_part"),
        total(here("tax_columns")).alias("tax_part"),
        total(one("net_sales_columns")).alias("net_sales"),
        total(one("tender_columns")).alias("tender_payments"),
    )


# -- gate 1 ----------------------------------------------------------------------------------

def _present(files: DataFrame, siblings: DataFrame | None, contracts: DataFrame) -> DataFrame:
    """Report types present for every (batch, contract, property, date)."""
    cols = ["batch_id", "contract_id", "property", "date", "report_type", "atomic_set"]
    own = files.where(~F.col("is_object")).select(*cols)
    if siblings is not None:
        dims = contracts.select("contract_id", "name_pattern", "atomic_set", "required_groups")
        named = identity.with_identity(siblings.join(dims, "contract_id"), "filename", "name_pattern", F.col("required_groups"))
        for t in ("property", "report_type", "date"):
            named = named.withColumn(t, F.element_at("tokens", t))
        own = own.unionByName(named.where("name_matches").select(*cols))
    own = own.withColumn("_set", F.to_json(F.struct("batch_id", "contract_id")))  # keeps nulls apart from each other and from texts
    found = sets.siblings_present(own, "_set", "property", "date", "report_type", F.col("atomic_set"))
    return found.select(F.get_json_object("_set", "$.batch_id").alias("_b"), F.get_json_object("_set", "$.contract_id").alias("_c"),
                        F.col("property").alias("_p"), F.col("date").alias("_d"), "present")


def _file_ladder() -> list[outcome.Rung]:
    c = F.col
    verdict, missing = sets.sibling_verdict(c("atomic_set"), c("report_type"), c("present"))
    q, r = "QUARANTINE_FILE", "REJECT_FILE"
    text = F.lit
    differ = identity.disagreements(c("path_tokens"), c("tokens"))
    path_due = F.coalesce("path_agreement", F.lit(True)) & c("has_path_pattern")
    path_ok = ~path_due | (c("path_matches") & (F.size(differ) == 0))
    unit = lambda n: F.coalesce(n, F.lit(0)).cast("string")
    name_message = (
        F.when(~c("has_name_pattern"), "Filename syntax deviation: contract missing filename_regex.")
        .when(~c("name_pattern_valid"), "Filename syntax deviation: invalid regex.")
        .when(~c("name_matches"), "Filename syntax deviation")
        .when(F.size("missing_tokens") > 0, F.concat(text("Filename syntax deviation: missing groups "), F.array_join("missing_tokens", ", "), text(".")))
        .otherwise("Filename matched; tokens extracted.")
    )
    return [
        *_first_rungs(),
        outcome.Rung("filename_regex", c("name_matches") & (F.size("missing_tokens") == 0), q, name_message),
        outcome.Rung("property_code", identity.same_or_absent(c("property"), c("property_code")), q,
                      F.concat(text("Property code mismatch: filename="), F.coalesce("property", text("")), text(" contract="), F.coalesce("property_code", text(""))), quiet=True),
        outcome.Rung("endpoint_registered", identity.endpoint_accepted(c("report_type"), c("atomic_set")), q,
                      F.when(identity.endpoint_accepted(c("report_type"), c("atomic_set")), "Endpoint accepted.").otherwise(
                          F.concat(text("UNREGISTERED_ENDPOINT: Report type '"), F.coalesce("report_type", text("")), text("' is not registered in the contract for property '"),
                                   F.coalesce("property", "property_code", text("")), text("'.")))),
        outcome.Rung("path_agreement", path_ok, q,
                      F.when(path_ok, "Path agrees with the filename.").when(~c("path_matches"), "Path-to-filename agreement failed: path does not match pattern.")
                      .otherwise(F.concat(text("Path-to-filename agreement failed: "), F.array_join(differ, ", ")))),
        outcome.Rung("physical_integrity", c("enc.ok"), r,
                      F.when(c("enc.ok"), F.concat(text("Physical integrity OK ("), c("enc.used"), text(")."))).otherwise(
                          F.concat(text("Physical integrity failed: decode error at byte "), F.coalesce(c("enc.error_start").cast("string"), text("?")), text("."))),
                      info={"error_start": c("enc.error_start"), "offending_byte": c("enc.offending_byte"), "encoding": c("enc.requested")}),
        outcome.Rung("line_conservation", lines.engine_conserved(F.coalesce("data_rows", F.lit(0)), c("declared_count")), q,
                      F.concat(text("Line conservation: data_lines="), unit(c("data_rows")), text(" declared_count="), F.coalesce(c("declared_count").cast("string"), text("none"))),
                      stop=False, info={"total_lines": c("total_rows"), "header_lines": c("header_rows"), "data_lines": c("data_rows"),
                                        "footer_lines": c("footer_rows"), "ignore_lines": c("ignore_rows"), "declared_count": c("declared_count")}),
        outcome.Rung("non_empty_payload", F.coalesce("data_rows", F.lit(0)) > 0, q,
                      F.when(F.coalesce("data_rows", F.lit(0)) > 0, F.concat(text("Payload contains "), unit(c("data_rows")), text(" data row(s)."))).otherwise(
                          "EMPTY_PAYLOAD: File contains headers/trailers but zero data rows."), stop=False),
        outcome.Rung("atomic_set", verdict == "PASS", F.when(F.size(missing) > 0, "HOLD_SET").otherwise(q),
                      F.when(verdict == "HOLD", F.concat(text("HOLD_SET: atomic set incomplete; waiting for: "), F.array_join(missing, ", ")))
                      .when(verdict == "QUARANTINE", "Atomic set failed: report type is not a required endpoint.").otherwise("Atomic set complete or not required."),
                      stop=False, info={"missing_endpoints": F.when(F.size(missing) > 0, F.array_join(missing, ","))}),
    ]


def _first_rungs() -> list[outcome.Rung]:
    return [
        outcome.Rung("noise_filter", ~F.col("noisy"), "QUARANTINE_FILE", F.lit("Object matches a noise filter pattern and will not be ingested."), quiet=True, final=True),
        outcome.Rung("non_empty_payload", F.col("length") > 0, "QUARANTINE_FILE", F.lit("PHYSICAL_INTEGRITY_FAIL: File is 0 bytes."), quiet=True, final=True),
    ]


def _object_ladder() -> list[outcome.Rung]:
    c, text = F.col, F.lit
    route = c("failure_route")
    held = ~c("require_marker") | c("has_marker") | ((c("object_format") == "Delta") & c("has_delta_log"))
    base = identity.basename(F.coalesce(blank_to_null(c("filename")), c("key")))
    return [
        *_first_rungs(),
        outcome.Rung("partition_path", c("part_tokens").isNotNull(), route, F.when(c("part_tokens").isNull(), "Partition path does not match the configured template.").otherwise(
            "Partition path matched; identity tokens extracted.")),
        outcome.Rung("property_code", identity.same_or_absent(c("property"), c("property_code")), route, text("Property code mismatch between path and contract."), quiet=True),
        outcome.Rung("commit_marker", held, "HOLD_SET", F.when(held, "Commit marker present or not required.").otherwise(
            F.concat(text("HOLD: commit marker '"), c("commit_marker"), text("' not present in partition.")))),
        outcome.Rung("watermark", F.coalesce("watermark", text("PASS")) == "PASS", "QUARANTINE_FILE",
                      F.concat(text("Watermark column '"), c("watermark_column"), text("': "), F.coalesce("watermark", text("deferred to read time")))),
        outcome.Rung("object_payload", sets.object_payload_ok(base, c("object_format"), c("length"), c("commit_marker")), "REJECT_FILE", text("Object payload judged.")),
    ]


# -- gate 2 ----------------------------------------------------------------------------------

def _gate_two(files: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    files = (
        files.withColumn("skip_two", outcome.skip_gate_two(c("g1_outcome")))
        .withColumn("business_date", parse_business_date(F.coalesce("date", F.date_format(as_of, "yyyy-MM-dd"))))
        .withColumn("volume", F.when(c("enc.ok"), F.coalesce("total_rows", F.lit(0))).otherwise(0))
    )
    lookback = F.greatest(F.lit(45), c("open_days") + 15, c("window_days") + 15)
    files = files.withColumn("oldest_day", F.date_sub(as_of, lookback))
    asking = files.where(~c("skip_two"))
    known = history.withColumnRenamed("business_date", "day")
    if "run_id" not in known.columns:
        known = known.withColumn("run_id", F.lit(None).cast("string"))
    # history is reduced before it meets a scope; a stored run without property or report type is history of all, and
    # a file without one has the history of all
    asked = staged(asking.select(*SCOPE, "checksum", "business_date").distinct(), "asked")
    scopes = asked.select(*SCOPE).distinct()
    args = ("day", "checksum_sha256", "overall_outcome")
    under = lambda reduced, by: anomaly.regrouped(anomaly.scoped(scopes, reduced, SCOPE), [*SCOPE, *by])
    hashes = under(anomaly.released_hashes(known, SCOPE, *args), ["checksum_sha256"]).withColumnRenamed("checksum_sha256", "checksum")
    certified = under(anomaly.certified_days(known, SCOPE, *args), ["day"]).withColumnRenamed("day", "business_date")
    days = under(anomaly.baseline_days(known, SCOPE, "day", "row_count", "net_amount", "overall_outcome"), ["day"]).withColumnRenamed("day", "business_date")
    sums = ("n", "s", "ss", "an", "asum", "ass")
    base = anomaly.baseline_for(asking.select(*SCOPE, "business_date", "window_days", "same_weekday", "oldest_day"), days, SCOPE,
                                "business_date", c("window_days"), c("same_weekday"), sums, c("oldest_day"))
    proof = asked.select(*SCOPE, c("checksum").alias("checksum_sha256"), c("business_date").alias("day"))
    matches = anomaly.matching_runs(known, proof.where("checksum_sha256 IS NOT NULL"), SCOPE, *args, "run_id").withColumnRenamed("checksum_sha256", "checksum")
    rivals = anomaly.conflicting_runs(known, proof.where("day IS NOT NULL"), SCOPE, *args, "run_id").withColumnRenamed("day", "business_date")
    joined = files
    for found, keys in ((hashes, ["checksum"]), (certified, ["business_date"]), (base, ["business_date", "window_days", "same_weekday", "oldest_day"]),
                        (matches, ["checksum"]), (rivals, ["business_date"])):
        joined = anomaly.joined_by_scope(joined, found, SCOPE, keys)
    repeated = F.coalesce(c("last_released_on") >= c("oldest_day"), F.lit(False))
    drift = anomaly.drifted(c("checksum"), c("low_hash"), c("high_hash")) & F.coalesce(c("business_date") >= c("oldest_day"), F.lit(False))
    frozen = anomaly.frozen_verdict(c("business_date"), as_of, c("open_days"))
    z = anomaly.z_score(c("volume").cast("double"), c("base_n"), c("base_s"), c("base_ss"))
    az = anomaly.z_score(F.round(c("net_sales").cast("double") * 100), c("base_an"), c("base_asum"), c("base_ass"))
    enough = F.coalesce("base_an", F.lit(0)) >= F.greatest(F.lit(1), c("min_samples"))
    verdict = anomaly.z_verdict(c("base_n"), c("min_samples"), z, c("max_z"))
    amount_out = F.coalesce(enough & (F.abs(az) > c("max_amount_z")), F.lit(False))
    normal = (verdict == "COLD_START") | ((verdict == "NORMAL") & ~amount_out)
    checks = [
        outcome.Rung("G2_DUPLICATE_PAYLOAD", ~repeated, "QUARANTINE_FILE", F.when(~repeated, "Payload hash was not released before.").otherwise(
            "FILE_ALREADY_INGESTED: Identical SHA256 payload hash exists in run history."), stop=False, info={"payload_hash": c("checksum"), "released_runs": F.when(~repeated, None).otherwise(c("released_runs")), "matches": F.when(repeated, F.to_json(
                F.transform("matches", lambda m: F.struct(m["run_id"].alias("run_id"), m["day"].alias("business_date"), F.upper(m["overall_outcome"]).alias("overall_outcome")))))}),
        outcome.Rung("G2_OVERLAP_DRIFT", ~drift, "FLAG", F.when(drift, "OVERLAP_DRIFT_DETECTED: New payload received for an already certified business date.").otherwise(
            "No other payload for this business date."), stop=False, info={"conflicts": F.when(drift, F.to_json(
                F.transform(anomaly.conflicts(c("certified"), "checksum_sha256", c("checksum")), lambda r: F.struct(
                    r["run_id"].alias("run_id"), c("business_date").alias("business_date"), r["checksum_sha256"].alias("prior_hash"), F.upper(r["overall_outcome"]).alias("overall_outcome")))))}),
        outcome.Rung("G2_FROZEN_WINDOW", frozen == "OPEN", "QUARANTINE_FILE", F.when(frozen == "OPEN", "Business date is within the open accounting window.").otherwise(
            F.concat(F.lit("FROZEN_WINDOW_VIOLATION: "), frozen)), stop=False),
        outcome.Rung("G2_ZSCORE_ANOMALY", F.coalesce(normal, F.lit(True)), "FLAG", F.when(verdict == "COLD_START", "Insufficient historical samples; z-score check skipped (cold-start).").when(
            normal, "Volume within rolling baseline.").otherwise("G2_ZSCORE_ANOMALY: Volume/financial variance exceeds rolling baseline."), stop=False,
            info={"z_score": F.when(~F.isnan(z) & (F.abs(z) < float("inf")), F.round(z, 4)), "baseline_n": F.coalesce("base_n", F.lit(0)),
                  "cold_start": F.when(verdict == "COLD_START", "true")}),
    ]
    skipped = F.array(F.struct(
        F.lit("G2_SKIPPED").alias("rule_name"), F.lit(True).alias("passed"), F.lit(True).alias("skipped"),
        F.concat(F.lit("Gate 2 skipped: Gate 1 outcome="), c("g1_outcome"), F.lit(".")).alias("message"), F.lit(None).cast("string").alias("on_fail"),
        details(skipped=F.lit("true")).alias("details")))
    judged = outcome.with_ladder(joined, "g2", checks)
    return judged.withColumn("g2", F.when(c("skip_two"), skipped).otherwise(c("g2"))).withColumn("g2_outcome", _worst("g2"))


def _worst(evaluations: str, ranks: dict[str, int] = fx.GATE_RANK) -> Column:
    failed = F.transform(F.filter(evaluations, lambda e: ~e["passed"]), lambda e: outcome.rank(e["on_fail"], ranks))
    return outcome.by_rank(F.coalesce(F.array_max(failed), F.lit(0)), ranks)


# -- gates 3 and 4 ---------------------------------------------------------------------------

def _gate_three_four(files: DataFrame) -> DataFrame:
    c, q = F.col, "QUARANTINE_FILE"
    gone = quality.missing_columns(c("required_columns"), c("header"))
    lacking = lambda cols: F.size(F.array_except(cols, c("header"))) > 0
    rows = lambda n: F.coalesce(c(n), F.lit(0))
    framed = (F.size("header") > 0) | (c("is_object") & (c("length") > 0))
    ranged = F.transform("numeric_ranges", lambda r: r["column"])
    count = lambda n: F.concat(rows(n).cast("string"), F.lit(" row(s)."))
    ours = ~c("is_object")
    # a file without any row has one finding; lake objects are validated at read time
    absent = lambda on_fail: outcome.Rung("dataframe_present", framed, on_fail, F.lit("No rows available for this gate."), quiet=True, final=True)
    g3 = [
        absent(q),
        outcome.Rung("required_columns", ~ours | (F.size(gone) == 0), q, F.concat(F.lit("Required columns missing: "), F.array_join(gone, ", ")), stop=False),
        outcome.Rung("repeated_columns", ~ours | (F.size(quality.repeated_columns(c("header"))) == 0), "FLAG", F.concat(
            F.lit("Columns named more than once, of which the first is read: "), F.array_join(quality.repeated_columns(c("header")), ", ")), stop=False, quiet=True),
        outcome.Rung("non_null_constraints", ~ours | ((rows("null_rows") == 0) & ~lacking(c("non_null_columns"))), q, F.concat(F.lit("Non-null constraints: "), count("null_rows")), stop=False),
        outcome.Rung("numeric_column_integrity", ~ours | ((rows("poison_rows") == 0) & ~lacking(c("numeric_columns"))), q, F.concat(F.lit("Numeric column poison: "), count("poison_rows")), stop=False),
        outcome.Rung("numeric_range_bounds", ~ours | ((rows("range_rows") == 0) & ~lacking(ranged)), q, F.concat(F.lit("Numeric range bounds: "), count("range_rows")), stop=False),
    ]
    has = lambda aliases: F.size(revenue.aliases_present(c("header"), c(aliases))) > 0
    line_sum = F.when(has("line_amount_columns"), F.coalesce("line_part", F.lit(0)).cast("decimal(28,2)") + F.coalesce("tax_part", F.lit(0)).cast("decimal(28,2)"))
    net = F.when(has("net_sales_columns"), F.coalesce("net_sales", F.lit(0)).cast("decimal(28,2)"))
    tender = F.when(has("tender_columns"), F.coalesce("tender_payments", F.lit(0)).cast("decimal(28,2)"))
    first = F.when(c("check_header_line"), revenue.balance_verdict(c("header_total"), line_sum, c("max_variance"))).otherwise("SKIPPED")
    second = F.when(c("check_sales_tender"), revenue.balance_verdict(net, tender, c("max_variance"))).otherwise("SKIPPED")
    state = lambda v, message: F.when(v == "IMBALANCED", message).otherwise(F.concat(F.lit("Balance: "), v))
    g4 = [
        absent("REJECT_FILE"),
        outcome.Rung("header_vs_line_balance", first != "IMBALANCED", "REJECT_FILE", state(first, revenue.imbalance_message("Header total", c("header_total"), "Line sum", line_sum)),
                     stop=False, info={"variance": F.when(first == "IMBALANCED", revenue.variance(c("header_total"), line_sum))}),
        outcome.Rung("sales_vs_tender_balance", second != "IMBALANCED", "REJECT_FILE", state(second, revenue.imbalance_message("Net sales", net, "Tender payments", tender)),
                     stop=False, info={"variance": F.when(second == "IMBALANCED", revenue.variance(net, tender))}),
    ]
    judged = outcome.with_ladder(outcome.with_ladder(files, "g3", g3), "g4", g4)
    return judged.withColumns({"g3_outcome": _worst("g3"), "g4_outcome": _worst("g4")})


# -- report ----------------------------------------------------------------------------------

def _report(files: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    gates = ["g1_outcome", "g2_outcome", "g3_outcome", "g4_outcome"]
    told = lambda g: F.array_join(F.transform(F.filter(g, lambda e: ~e["passed"]), lambda e: e["message"]), "; ")
    total = F.when(c("enc.ok") & ~c("is_object"), F.coalesce("total_rows", F.lit(0))).otherwise(0)
    day = iso_business_date(c("date"), as_of)
    return (
        files.withColumn("overall_outcome", outcome.worst([c(g) for g in gates]))
        .withColumn("outcome_reason", outcome.gate_reason(
            [("G1", c("g1_outcome"), c("g1_reason"))] + [(f"G{i}", c(f"g{i}_outcome"), told(f"g{i}")) for i in (2, 3, 4)], "All Gates 1–4 passed."))
        .withColumn("run_id", control.run_id(c("key"), F.coalesce("checksum", F.lit("")), c("property_id")))
        .withColumn("readiness", manifest.readiness(total, F.col("bad_rows"), c("overall_outcome")))
        .select(
            "file_id", "run_id", "batch_id", "property_id", "contract_id", F.coalesce("report_type", F.lit("unknown")).alias("report_type"), "tokens",
            F.to_date(parse_business_date(day)).alias("business_date"), F.coalesce(F.weekday(parse_business_date(day)), F.weekday(as_of)).cast("string").alias("day_of_week"),
            "overall_outcome", "outcome_reason", *gates, "g1", "g2", "g3", "g4", total.cast("bigint").alias("total_read_rows"), c("length").cast("bigint").alias("file_size_bytes"),
            F.coalesce("checksum", F.lit("0" * 64)).alias("checksum_sha256"), c("key").alias("s3_path"), "feed_category", "readiness",
            c("data_rows").alias("accepted_rows"), c("net_sales").cast("double").alias("net_amount"))
    )


def stored_form(reports: DataFrame) -> DataFrame:
    """Rows of the run table: nested parts as JSON text."""
    gates = F.to_json(F.struct(*[F.struct(F.col(f"g{i}_outcome").alias("overall_outcome"), F.col(f"g{i}").alias("evaluations")).alias(f"gate_{i}") for i in (1, 2, 3, 4)]))
    return reports.select(
        "run_id", "property_id", "report_type", "business_date", "day_of_week", "overall_outcome", "outcome_reason", "total_read_rows",
        "file_size_bytes", "checksum_sha256", "s3_path", "feed_category", "accepted_rows", "net_amount", gates.alias("gate_evaluations"),
        F.to_json("readiness").alias("readiness_stats"))
