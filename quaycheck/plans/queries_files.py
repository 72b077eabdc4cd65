"""Queries about landed files: sources, identity, bytes, lines, sets, sample inference."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaycheck.functions import dates
from quaycheck.functions import fixed_values as fx
from quaycheck.functions import patterns as pt
from quaycheck.functions.common import call, lookup, strings
from quaycheck.operators import contracts, identity, infer, lines, physical, sets
from quaycheck.plans.registry import query
from quaycheck.plans.twins import (
    DOC_LINES, HDR, IGN, ORDER_LINES, REJ, RUNS, TRL, document_lines, order_lines, runs, table,
)
from quaycheck.sources import control, landing

c, lit = F.col, F.lit


def csv(array):
    """Arrays as sorted text, so that results compare as scalars."""
    return F.array_join(F.array_sort(array), ",")


# -- sources ---------------------------------------------------------------------------------

@query("landing_inventory")
def landing_inventory(spark, sf):
    return landing.list_folder(spark, sf).select("basename", "length", (c("length") == 0).alias("is_empty"))


@query("payload_scan", """SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS checksum FROM documents""")
def payload_scan(spark, sf):
    sent = table(spark, sf, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("b64"), lit(None).cast("string").alias("plain"))
    return landing.inline_payloads(sent, "b64", "plain").select(
        "doc_id", F.octet_length("content").cast("bigint").alias("n_bytes"), physical.checksum(c("content")).alias("checksum"))


@query("lake_scan", "SELECT event_type, count(*) AS n, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::BIGINT AS large FROM events GROUP BY 1")
def lake_scan(spark, sf):
    return landing.read_lake(spark, "Parquet", f"{sf}/events.parquet").groupBy("event_type").agg(
        F.count(lit(1)).alias("n"), F.count_if(c("value") > 10).alias("large"))


@query("delimited_rows", "SELECT o_orderkey AS order_no, o_orderstatus AS status, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS priority FROM orders")
def delimited_rows(spark, sf):
    sent = table(spark, sf, "orders").select(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate"), "o_orderpriority").alias("line"))
    return landing.delimited_rows(sent, [], "line", "order_no bigint, status string, price double, day date, priority string", "|")


@query("jsonl_rows", "SELECT event_id, json_extract_string(props, '$.k') AS k, true AS parses FROM events")
def jsonl_rows(spark, sf):
    rows = landing.json_rows(table(spark, sf, "events"), "props")
    return rows.select("event_id", landing.json_text(c("doc"), "$.k").alias("k"), "parses")


_SEGMENT = {"AUTOMOBILE": "onesait", "BUILDING": "opera", "FURNITURE": "customjson", "HOUSEHOLD": "bigquery", "MACHINERY": "cloudbeds"}
_PRESET_ROWS = ", ".join(
    "('{}', '{}', '{}', '{}', '{}', '{}', {}, '{}', {})".format(
        seg, p, fx.PRESETS[p]["category"], {"onesait": "utf-8", "opera": "iso-8859-1", "cloudbeds": "utf-8-sig"}.get(p, "utf-8"),
        fx.PRESETS[p].get("delimiter", ","), ",".join(sorted(fx.PRESETS[p].get("members", []))), fx.PRESETS[p].get("max_z", 3.0),
        {"customjson": "JSONL", "bigquery": "Avro"}.get(p, "Parquet"), "false" if p == "customjson" else "true")
    for seg, p in _SEGMENT.items())


@query("contract_dim", f"""SELECT c_custkey, concat('P', c_custkey) AS property_code, category AS feed_category, preset AS preset_id, enc AS encoding,
 delim AS delimiter, members AS atomic_set, max_z::DOUBLE AS max_z, fmt AS object_format, marker AS require_marker
 FROM customer JOIN (VALUES {_PRESET_ROWS}) v(seg, preset, category, enc, delim, members, max_z, fmt, marker) ON seg = c_mktsegment""")
def contract_dim(spark, sf):
    """A document per property out of its preset, then read back into typed columns."""
    people = table(spark, sf, "customer").select("c_custkey", lookup(_SEGMENT, c("c_mktsegment")).alias("preset_id"))
    docs = people.join(contracts.preset_dim(spark), "preset_id").select(
        "c_custkey", contracts.preset_document(F.concat(lit("P"), c("c_custkey").cast("string")), lit("raw/")).alias("doc"))
    return contracts.normalise(docs, "c_custkey", "doc").select(
        "c_custkey", "property_code", "feed_category", "preset_id", "encoding", "delimiter", csv(c("atomic_set")).alias("atomic_set"), "max_z", "object_format", "require_marker")


@query("history_scan", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus IN ('F', 'O')
 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500""")
def history_scan(spark, sf):
    where = (c("o_orderdate") >= lit("1997-01-01").cast("timestamp")) & c("o_orderstatus").isin("F", "O")
    rows = control.scan(spark, f"{sf}/orders.parquet", where, ["o_orderkey", "o_totalprice", "o_orderdate"], ([c("o_orderdate").desc(), c("o_orderkey").desc()], 500))
    return rows.select("o_orderkey", "o_totalprice")


@query("drift_align", "SELECT event_id, CAST(NULL AS VARCHAR) AS released_by, user_id, event_type FROM events")
def drift_align(spark, sf):
    target = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("released_by", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])
    return control.align(table(spark, sf, "events"), target)


_LOOSE = "CASE event_type WHEN 'error' THEN concat('[', user_id, ']') WHEN 'view' THEN 'not json' ELSE props END"


@query("json_coerce", f"""SELECT event_id, CASE WHEN event_type = 'error' THEN {_LOOSE} ELSE '[]' END AS as_list,
 CASE WHEN event_type IN ('error', 'view') THEN '{{}}' ELSE props END AS as_object FROM events""")
def json_coerce(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"{_LOOSE} AS raw")
    return rows.select("event_id", control.as_list(c("raw")).alias("as_list"), control.as_object(c("raw")).alias("as_object"))


# -- identity --------------------------------------------------------------------------------

@query("uri_parts", r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_extract(url, '^https?://[^/?#]*/*([^?#]*)', 1) AS object_key,
 regexp_replace(regexp_extract(url, '^https?://[^/?#]*/*([^?#]*)', 1), '(/?[^/]*)/*$', '') AS folder FROM pages""")
def uri_parts(spark, sf):
    key = identity.object_key(c("url"))
    return table(spark, sf, "pages").select("page_id", identity.basename(c("url")).alias("base"), key.alias("object_key"), identity.parent_folder(key).alias("folder"))


_KEY = r"regexp_replace(regexp_extract(url, '^https?://[^/?#]*/*([^?#]*)', 1), '/', '_', 'g')"
_TOKENS = rf"""SELECT page_id, regexp_matches(k, '^[a-z]{{2}}_\d+$') AS name_matches, nullif(regexp_extract(k, '^([a-z]{{2}})_\d+$', 1), '') AS report_type,
 nullif(regexp_extract(k, '^[a-z]{{2}}_(\d+)$', 1), '') AS property FROM (SELECT page_id, {_KEY} AS k FROM pages)"""


def _named_pages(spark, sf, required):
    pages = table(spark, sf, "pages").select("page_id", F.replace(identity.object_key(c("url")), lit("/"), lit("_")).alias("name"))
    rx = pt.literal_pattern(r"^(?P<report_type>[a-z]{2})_(?<property_id>\d+)$", anchored=True)
    return identity.with_identity(pages.withColumn("rx", rx), "name", "rx", strings(required))


@query("identity_tokens", _TOKENS)
def identity_tokens(spark, sf):
    return _named_pages(spark, sf, ["property", "report_type"]).select("page_id", "name_matches", c("tokens")["report_type"].alias("report_type"), c("tokens")["property"].alias("property"))


@query("required_tokens", f"SELECT page_id, CASE WHEN name_matches THEN 'date' ELSE 'date,property,report_type' END AS missing FROM ({_TOKENS})")
def required_tokens(spark, sf):
    return _named_pages(spark, sf, fx.REQUIRED_GROUPS_DEFAULT).select("page_id", csv(c("missing_tokens")).alias("missing"))


@query("identity_transport", r"""SELECT page_id, transport, nullif(CASE transport WHEN 'manifest' THEN regexp_extract(html, '<html lang="([a-z]+)"', 1)
 WHEN 'uri_path' THEN regexp_extract(url, '/([a-z]{2})/\d+', 1) ELSE regexp_extract(regexp_extract(url, '[^/]*$'), '^(\d+)', 1) END, '') AS token
 FROM (SELECT *, CASE WHEN starts_with(url, 'https://m.') THEN 'filename' WHEN starts_with(url, 'https') THEN 'uri_path' ELSE 'manifest' END AS transport FROM pages)""")
def identity_transport(spark, sf):
    p = table(spark, sf, "pages").withColumn("transport", F.when(F.startswith("url", lit("https://m.")), "filename").when(F.startswith("url", lit("https")), "uri_path").otherwise("manifest"))
    name, path, body = pt.literal_pattern(r"(?P<token>\d+)", True), pt.literal_pattern(r"/(?P<token>[a-z]{2})/\d+"), pt.literal_pattern(r'<html lang="(?P<token>[a-z]+)"')
    p = p.withColumns({"n": name, "u": path, "b": body})
    tokens = identity.transported_tokens(c("transport"), c("url"), c("url"), c("html"), c("n"), c("u"), c("b"))
    return p.select("page_id", "transport", tokens["token"].alias("token"))


_DATE_TEXT = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN {iso} WHEN '2' THEN {compact} WHEN '3' THEN concat({compact}, 'T0000')
 WHEN '4' THEN '2001-13-45' ELSE '' END"""


@query("date_tokens", f"""SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN CAST(o_orderdate AS DATE) END AS parsed,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '2' THEN strftime(o_orderdate, '%Y-%m-%d')
 WHEN '3' THEN concat(strftime(o_orderdate, '%Y%m%d'), 'T0') WHEN '4' THEN '2001-13-45' ELSE '2001-08-01' END AS normalised,
 CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN CAST(o_orderdate AS DATE) END AS by_format FROM orders""")
def date_tokens(spark, sf):
    text = _DATE_TEXT.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", compact="date_format(o_orderdate, 'yyyyMMdd')")
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{text} AS token")
    return rows.select("o_orderkey", dates.parse_business_date(c("token")).alias("parsed"), dates.iso_business_date(c("token"), lit("2001-08-01").cast("date")).alias("normalised"),
                       call("try_to_date", F.when(c("token").rlike(r"^\d{8}$"), c("token")), pt.java_date_format("%Y%m%d")).alias("by_format"))


@query("registry_check", """SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN 'NOT_REGISTERED' WHEN NOT s_acctbal > 0 THEN 'INACTIVE'
 WHEN s_nationkey <> c_nationkey THEN 'OTHER_PROFILE' END AS problem FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def registry_check(spark, sf):
    registry = table(spark, sf, "supplier").withColumn("known", lit(True))
    joined = table(spark, sf, "customer").join(registry, c("s_suppkey") == c("c_custkey"), "left")
    verdict = identity.registry_verdict(c("c_custkey").cast("string"), c("known"), c("s_acctbal") > 0, c("s_nationkey").cast("string"), c("c_nationkey").cast("string"))
    return joined.select("c_custkey", verdict.alias("problem"))


@query("property_agreement", """SELECT o_orderkey, (c_nationkey IS NULL OR s_nationkey IS NULL OR c_nationkey = s_nationkey) AS agrees
 FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey""")
def property_agreement(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), c("c_custkey") == c("o_custkey"), "left").join(
        table(spark, sf, "supplier"), c("s_suppkey") == c("o_custkey"), "left")
    return o.select("o_orderkey", identity.same_or_absent(c("c_nationkey").cast("string"), c("s_nationkey").cast("string")).alias("agrees"))


@query("path_agreement", r"""SELECT a.page_id, CASE WHEN regexp_extract(a.url, '/([a-z]{2})/\d+', 1) <> regexp_extract(b.html, '<html lang="([a-z]+)"', 1) THEN 'lang' ELSE '' END AS differing
 FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1""")
def path_agreement(spark, sf):
    """Path tokens against those of the neighbouring page, so that both verdicts occur."""
    pages = table(spark, sf, "pages").withColumns({"u": pt.literal_pattern(r"/(?P<lang>[a-z]{2})/\d+"), "h": pt.literal_pattern(r'<html lang="(?P<lang>[a-z]+)"')})
    path = pages.select("page_id", pt.groups(c("url"), c("u")).alias("path_tokens"))
    other = pages.select((c("page_id") - 1).alias("page_id"), pt.groups(c("html"), c("h")).alias("file_tokens"))
    return path.join(other, "page_id", "left").select("page_id", F.coalesce(csv(identity.disagreements(c("path_tokens"), c("file_tokens"))), lit("")).alias("differing"))


_REGISTERED = {"web": ["en", "fr"], "forum": ["en", "de"], "news": ["en"], "code": []}


@query("endpoint_registered", """SELECT doc_id, CASE source WHEN 'web' THEN lang IN ('en', 'fr') WHEN 'forum' THEN lang IN ('en', 'de') WHEN 'news' THEN lang = 'en' ELSE true END AS accepted FROM documents""")
def endpoint_registered(spark, sf):
    members = F.coalesce(*[F.when(c("source") == s, strings(v)) for s, v in _REGISTERED.items()], strings([]))
    return table(spark, sf, "documents").select("doc_id", identity.endpoint_accepted(c("lang"), members).alias("accepted"))


@query("content_agreement", r"""SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS content_lang, nullif(regexp_extract(html, 'track\((\d+)\)', 1), '') AS content_page,
 CASE WHEN regexp_extract(html, '<html lang="([a-z]+)"', 1) = regexp_extract(url, '/([a-z]{2})/\d+', 1) AND regexp_extract(html, 'track\((\d+)\)', 1) = regexp_extract(url, '/(\d+)', 1)
 THEN 'PASS' ELSE 'MISFILED_OBJECT' END AS verdict FROM pages""")
def content_agreement(spark, sf):
    pages = table(spark, sf, "pages")
    body = lines.explode_lines(pages, lines.split_any(c("html")), "page_id")
    found = identity.first_capture(body, "page_id", {"lang": '<html lang="([a-z]+)"', "page": r"track\((\d+)\)"})
    url = lambda rx: F.regexp_extract("url", rx, 1)
    joined = pages.select("page_id", "url").join(found, "page_id", "left")
    verdict = identity.content_verdict([("lang", url(r"/([a-z]{2})/\d+"), c("content_lang")), ("page", url(r"/(\d+)"), c("content_page"))])
    return joined.select("page_id", "content_lang", "content_page", verdict.alias("verdict"))


@query("partition_path", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderstatus <> 'P' THEN concat('P', o_custkey) END AS property,
 CASE WHEN o_orderstatus = 'F' THEN 'pos' END AS feed, CASE WHEN o_orderstatus = 'F' THEN 'jsonl' END AS report_type FROM orders""")
def partition_path(spark, sf):
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    key = f"""CASE o_orderstatus WHEN 'F' THEN concat('raw/P', o_custkey, '/pos/dt=', {day}, '/part-0.json')
      WHEN 'O' THEN concat('stage/P', o_custkey, '/business_date=', {day}, '/x') ELSE concat('misc/', o_custkey) END"""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{key} AS k", "concat('P', o_custkey) AS code")
    rows = rows.withColumn("t", pt.template_pattern(lit(fx.PARTITION_TEMPLATE_DEFAULT)))
    tokens = identity.partition_tokens(c("k"), c("t"), c("code"), lit("lake"), lit("JSONL"))
    return rows.select("o_orderkey", *[tokens[n].alias(n) for n in ("date", "property", "feed", "report_type")])


@query("noise_filter", "SELECT page_id, (contains(url, '#') OR contains(url, 'm.th') OR regexp_matches(url, '/de/')) AS noise FROM pages")
def noise_filter(spark, sf):
    globs = strings(["*#*", "*m.th*", "/de/", "*.tmp"])
    return table(spark, sf, "pages").select("page_id", identity.is_noise(c("url"), identity.noise_regex(globs), identity.noise_folders(globs)).alias("noise"))


@query("feed_category_norm", f"WITH {RUNS} SELECT run_id, CASE trim(feed_category) WHEN 'pos' THEN 'pos' WHEN 'PMS' THEN 'pms' WHEN 'reservations' THEN 'res' WHEN 'data_lake' THEN 'lake' END AS feed FROM runs")
def feed_category_norm(spark, sf):
    return runs(spark, sf).select("run_id", identity.feed_category(c("feed_category")).alias("feed"))


# -- bytes -----------------------------------------------------------------------------------

@query("payload_checksum", "SELECT page_id, sha256(html) AS checksum FROM pages")
def payload_checksum(spark, sf):
    return table(spark, sf, "pages").select("page_id", physical.checksum(F.encode("html", "UTF-8")).alias("checksum"))


@query("min_bytes", "SELECT source, count(*) AS files, count(*) FILTER (octet_length(encode(text)) >= 400) AS big_enough FROM documents GROUP BY 1")
def min_bytes(spark, sf):
    ok = physical.big_enough(F.octet_length("text"), lit(400))
    return table(spark, sf, "documents").groupBy("source").agg(F.count(lit(1)).alias("files"), F.count_if(ok).alias("big_enough"))


@query("encoding_check", r"""SELECT doc_id, (ascii OR lang = 'de') AS ok, CASE WHEN ascii THEN 'ascii' WHEN lang = 'de' THEN 'latin-1' END AS used,
 CASE WHEN NOT ascii AND lang <> 'de' THEN length(pre) END AS error_start, CASE WHEN NOT ascii AND lang <> 'de' THEN lower(substr(hex(encode(text[length(pre) + 1])), 1, 2)) END AS offending_byte
 FROM (SELECT doc_id, lang, text, NOT regexp_matches(text, '[^\x00-\x7F]') AS ascii, regexp_extract(text, '^[\x00-\x7F]*') AS pre FROM documents)""")
def encoding_check(spark, sf):
    docs = table(spark, sf, "documents")
    e = physical.encoding_check(F.encode("text", "UTF-8"), lit("US-ASCII"), c("lang") == "de")
    return docs.select("doc_id", e.alias("e")).select("doc_id", "e.ok", "e.used", c("e.error_start").cast("bigint").alias("error_start"), "e.offending_byte")


@query("bom_check", "SELECT page_id, starts_with(url, 'https') AS has_bom FROM pages")
def bom_check(spark, sf):
    body = F.concat(F.when(F.startswith("url", lit("https")), lit(physical.BOM)).otherwise(""), c("html"))
    return table(spark, sf, "pages").select("page_id", physical.has_bom(F.encode(body, "UTF-8")).alias("has_bom"))


_ENDED = "CASE lang WHEN 'en' THEN replace(text, {nl}, concat({cr}, {nl})) WHEN 'fr' THEN replace(text, {nl}, {cr}) ELSE text END"


@query("line_ending_check", f"""SELECT doc_id, has AND lang NOT IN ('en', 'fr') AS lf_ok, has AND lang = 'en' AS crlf_ok, has AND lang = 'fr' AS cr_ok
 FROM (SELECT doc_id, lang, contains(text, chr(10)) AS has FROM documents)""")
def line_ending_check(spark, sf):
    body = _ENDED.format(nl="char(10)", cr="char(13)")
    docs = table(spark, sf, "documents").selectExpr("doc_id", f"{body} AS body")
    return docs.select("doc_id", *[physical.line_endings_ok(c("body"), lit(p)).alias(f"{p}_ok") for p in ("lf", "crlf", "cr")])


@query("compression_policy", "SELECT doc_id, source = 'web' AS accepted FROM documents")
def compression_policy(spark, sf):
    declared = F.when(c("source") == "web", "none").otherwise("gzip")
    return table(spark, sf, "documents").select("doc_id", physical.compression_ok(declared).alias("accepted"))


# -- lines -----------------------------------------------------------------------------------

_N = "(length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 0 ELSE 1 END)"


@query("line_split", f"SELECT doc_id, {_N} AS n_lines, {_N} AS segments, CASE WHEN lang = 'en' THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END AS skipped FROM documents")
def line_split(spark, sf):
    """English documents get carriage returns, which an LF policy drops and counts."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN lang = 'en' THEN replace(text, char(10), concat(char(13), char(10))) ELSE text END AS body")
    strict = lines.split_strict(c("body"), lit("lf"))
    return docs.select("doc_id", F.size(lines.split_any(c("body"))).cast("bigint").alias("n_lines"), strict["segments"].alias("segments"), strict["skipped"].alias("skipped"))


_SHELL_CLASS = rf"""CASE WHEN regexp_matches(line, '{HDR}') OR regexp_matches(line, '^TRL\|COUNT\|') THEN 'header_footer' WHEN regexp_matches(line, '{IGN}') THEN 'ignored'
 WHEN regexp_matches(line, '{REJ}') THEN 'rejected' WHEN length(line) - length(replace(line, '|', '')) + 1 BETWEEN 4 AND 32 THEN 'accepted' ELSE 'quarantined' END"""


def _shell_rows(spark, sf):
    shape = lines.shape_ok(c("line"), lit("|"), lit(None).cast("int"), lit(4), lit(32))
    return order_lines(spark, sf).withColumn("row_class", lines.shell_class(c("line"), lit(HDR), lit(TRL), lit(IGN), lit(REJ), shape))


@query("row_classes_shell", f"WITH {ORDER_LINES} SELECT {_SHELL_CLASS} AS row_class, count(*) AS n, count(DISTINCT file_id) AS files FROM olines GROUP BY 1")
def row_classes_shell(spark, sf):
    per_file = _shell_rows(spark, sf).groupBy("row_class", "file_id").agg(F.count(lit(1)).alias("k"))
    return per_file.groupBy("row_class").agg(F.sum("k").alias("n"), F.count(lit(1)).alias("files"))


_FIRST = f"""{DOC_LINES}, cls AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*$') THEN 'ignore' ELSE 'data' END AS k FROM dlines),
 fst AS (SELECT doc_id, min(line_no) AS first_no FROM cls WHERE k = 'data' GROUP BY 1)"""


@query("row_classes_engine", f"""WITH {_FIRST} SELECT doc_id, line_no, CASE WHEN line_no = first_no THEN 'header' ELSE k END AS row_class FROM cls LEFT JOIN fst USING (doc_id)""")
def row_classes_engine(spark, sf):
    none = lit(None).cast("string")
    classed = document_lines(spark, sf).select("doc_id", "line_no", lines.engine_class(c("line"), none, none, lit(r"^\s*$")).alias("row_class"))
    return lines.with_default_header(classed, "doc_id").select("doc_id", c("line_no").cast("bigint").alias("line_no"), "row_class")


@query("row_shape", f"WITH {DOC_LINES} SELECT doc_id, line_no, length(line) - length(replace(line, '|', '')) + 1 AS fields, contains(line, '|') AS ragged FROM dlines")
def row_shape(spark, sf):
    none = lit(None).cast("int")
    rows = document_lines(spark, sf)
    return rows.select("doc_id", c("line_no").cast("bigint").alias("line_no"), lines.field_count(c("line"), lit("|")).cast("bigint").alias("fields"),
                       (~lines.shape_ok(c("line"), lit("|"), lit(1), none, none)).alias("ragged"))


_BUCKETS = ["header_footer", "accepted", "rejected", "quarantined", "ignored"]
_COUNTS = ", ".join(f"count(*) FILTER (k = '{b}') AS {b}_rows" for b in _BUCKETS)


@query("row_accounting", f"WITH {ORDER_LINES} SELECT file_id, count(*) AS total_rows, {_COUNTS} FROM (SELECT file_id, {_SHELL_CLASS} AS k FROM olines) GROUP BY 1")
def row_accounting(spark, sf):
    return lines.count_classes(_shell_rows(spark, sf), "file_id", _BUCKETS)


_DECL = r"TRY_CAST(nullif(regexp_extract(line, '^TRL\|COUNT\|(\d+)', 1), '') AS BIGINT)"


def _declared(spark, sf):
    rx = pt.literal_pattern(r"^TRL\|COUNT\|(?P<declared_row_count>\d+)")
    rows = order_lines(spark, sf).withColumn("rx", rx)
    return rows.withColumn("declared", lines.declared_value(c("line"), c("rx"), lines.ENGINE_COUNT_NAMES, True))


@query("declared_count", f"WITH {ORDER_LINES} SELECT file_id, max({_DECL}) AS declared FROM olines GROUP BY 1")
def declared_count(spark, sf):
    return _declared(spark, sf).groupBy("file_id").agg(lines.first_declared(c("declared"), c("line_no")).alias("declared"))


@query("row_conservation", f"""WITH {ORDER_LINES} SELECT file_id, total, declared, CASE WHEN declared IS NULL THEN 0 ELSE abs(declared - total) END AS unaccounted,
 (declared IS NULL OR declared = data) AS engine_ok FROM (SELECT file_id, count(*) AS total, max({_DECL}) AS declared,
 count(*) FILTER (NOT regexp_matches(line, '^(HDR|TRL|#)\\|')) AS data FROM olines GROUP BY 1)""")
def row_conservation(spark, sf):
    rows = _declared(spark, sf).withColumn("row_class", lines.engine_class(c("line"), lit(HDR), lit(TRL), lit(IGN)))
    per = rows.groupBy("file_id").agg(F.count(lit(1)).alias("total"), lines.first_declared(c("declared"), c("line_no")).alias("declared"), F.count_if(c("row_class") == "data").alias("data"))
    gap = lines.unaccounted(c("declared"), c("total"), c("total"), c("total"), c("total"), lit(0).cast("bigint"))
    return per.select("file_id", "total", "declared", gap.alias("unaccounted"), lines.engine_conserved(c("data"), c("declared")).alias("engine_ok"))


@query("non_empty_payload", f"WITH {ORDER_LINES} SELECT file_id, count(*) FILTER (regexp_matches(line, '^DAT\\|')) > 0 AS has_data FROM olines GROUP BY 1")
def non_empty_payload(spark, sf):
    rows = order_lines(spark, sf)
    return rows.groupBy("file_id").agg((F.count_if(c("line").rlike(r"^DAT\|")) > 0).alias("has_data"))


@query("date_bounds", rf"""WITH {ORDER_LINES}, d AS (SELECT file_id, TRY_CAST(t AS DATE) AS day FROM (SELECT file_id, unnest(regexp_extract_all(line, '(\d{{4}}-\d{{2}}-\d{{2}})', 1)) AS t FROM olines))
 SELECT file_id, count(day) AS dates_seen, min(day) AS earliest, max(day) AS latest, CASE WHEN count(day) = 0 THEN 'NO_DATES' WHEN min(day) < DATE '1995-06-01' THEN 'BELOW_FLOOR' WHEN max(day) > DATE '2001-01-01' THEN 'FUTURE' ELSE 'PASS' END AS verdict FROM (SELECT DISTINCT file_id FROM olines) LEFT JOIN d USING (file_id) GROUP BY 1""")
def date_bounds(spark, sf):
    tokens = lines.date_tokens(order_lines(spark, sf), "file_id", r"(\d{4}-\d{2}-\d{2})(?=[|,\t\r\n]|$)", "yyyy-MM-dd")
    day = lambda s: lit(s).cast("date")
    files = order_lines(spark, sf).select("file_id").distinct()
    return lines.date_bounds(tokens, "file_id", day("1995-06-01"), day("2001-01-01"), lit(False), files).drop("unparseable")


_SECTIONS = [("HEAD", "<head>", True), ("NAV", "<nav>", True), ("CLOSE", "</html>", True), ("TABLE", "<table", False)]


@query("section_inventory", """SELECT page_id, concat_ws(',', CASE WHEN contains(html, '</html>') THEN 'CLOSE' END, CASE WHEN contains(html, '<head>') THEN 'HEAD' END, CASE WHEN contains(html, '<nav>') THEN 'NAV' END,
 CASE WHEN contains(html, '<table') THEN 'TABLE' END) AS found, concat_ws(',', CASE WHEN NOT contains(html, '</html>') THEN 'CLOSE' END, CASE WHEN NOT contains(html, '<head>') THEN 'HEAD' END,
 CASE WHEN NOT contains(html, '<nav>') THEN 'NAV' END) AS missing FROM pages""")
def section_inventory(spark, sf):
    body = lines.explode_lines(table(spark, sf, "pages"), lines.split_any(c("html")), "page_id")
    return lines.section_inventory(body, "page_id", _SECTIONS).select("page_id", csv(c("found")).alias("found"), csv(c("missing")).alias("missing"))


@query("slot_inventory", rf"""WITH {ORDER_LINES}, s AS (SELECT file_id, nullif(regexp_extract(line, '(UDF\d\d)=', 1), '') AS slot FROM olines)
 SELECT file_id, count(DISTINCT slot) AS detected, greatest(count(DISTINCT slot) - 2, 0) AS surplus, CASE WHEN count(DISTINCT slot) < 2 THEN 'BELOW_EXPECTED' WHEN count(DISTINCT slot) > 2 THEN 'UNMAPPED' ELSE 'PASS' END AS slot_verdict FROM s GROUP BY 1""")
def slot_inventory(spark, sf):
    return lines.slot_inventory(order_lines(spark, sf), "file_id", call("regexp_extract_all", c("line"), r"(?:^|\|)(UDF\d{2})=", 1), lit(2))


# -- sets ------------------------------------------------------------------------------------

_TYPES = ["click", "error", "purchase", "signup", "view"]


def _user_days(spark, sf):
    return table(spark, sf, "events").select(c("user_id").cast("string").alias("property"), F.to_date("ts").alias("day"), "event_type", "value")


@query("atomic_set", """SELECT CAST(user_id AS VARCHAR) AS property, CAST(ts AS DATE) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type IN ('click', 'error', 'purchase', 'signup', 'view')) AS present,
 count(DISTINCT event_type) FILTER (event_type IN ('click', 'error', 'purchase', 'signup', 'view')) < 5 AS held FROM events GROUP BY 1, 2""")
def atomic_set(spark, sf):
    out = sets.atomic_set(_user_days(spark, sf), ["property", "day"], "event_type", strings(_TYPES))
    return out.select("property", "day", F.when(F.size("present") > 0, csv(c("present"))).alias("present"), (c("verdict") == "HOLD").alias("held"))


@query("atomic_set_engine", """WITH e AS (SELECT CASE WHEN value >= 2 THEN CAST(user_id AS VARCHAR) END AS property, CAST(ts AS DATE) AS day, event_type FROM events),
 a AS (SELECT DISTINCT property, day FROM e), p AS (SELECT DISTINCT property, day, event_type FROM e WHERE event_type IN ('click', 'purchase', 'view'))
 SELECT a.property, a.day, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS present FROM a LEFT JOIN p ON a.day = p.day AND (a.property IS NULL OR p.property IS NULL OR a.property = p.property) GROUP BY 1, 2""")
def atomic_set_engine(spark, sf):
    """Events of small value do not name their user, so they stand in for any."""
    rows = _user_days(spark, sf).select("day", F.when(c("value") >= 2, c("property")).alias("property"), c("day").cast("string").alias("date"), "event_type")
    out = sets.siblings_present(rows, "day", "property", "date", "event_type", strings(["click", "purchase", "view"]))
    return out.select("property", "day", csv(c("present")).alias("present"))


@query("commit_marker", """SELECT conv_id, turn, bool_or(role = 'system') OVER (PARTITION BY conv_id) AS has_marker FROM conversations""")
def commit_marker(spark, sf):
    objects = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", "concat('talk/', conv_id, '/', turn) AS key")
    inventory = objects.select(F.concat_ws("/", lit("talk"), "conv_id", "role").alias("object_key"))
    return sets.commit_markers(objects, inventory, "key", lit("system")).select("conv_id", "turn", "has_marker")


@query("watermark_present", """SELECT event_id, CASE event_type WHEN 'error' THEN 'NOT_OBJECT' WHEN 'view' THEN 'INVALID_JSON' WHEN 'click' THEN 'MISSING_COLUMN' ELSE 'PASS' END AS verdict FROM events""")
def watermark_present(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "event_type", f"concat(char(10), {_LOOSE}, char(10), props) AS body")
    column = F.when(c("event_type") == "click", "_ingested_at").otherwise("k")
    return rows.select("event_id", sets.watermark_verdict(sets.first_line(c("body")), column).alias("verdict"))


@query("object_payload", """SELECT page_id, NOT (starts_with(url, 'https') AND contains(url, '#')) AS accepted FROM pages""")
def object_payload(spark, sf):
    fmt = F.when(F.startswith("url", lit("https")), "JSONL").otherwise("Parquet")
    size = F.when(F.contains("url", lit("#")), 0).otherwise(F.octet_length("html"))
    return table(spark, sf, "pages").select("page_id", sets.object_payload_ok(identity.basename(c("url")), fmt, size, lit("_SUCCESS")).alias("accepted"))


# -- inference -------------------------------------------------------------------------------

_FIRSTLINE = r"trim(regexp_extract(text, '^\s*(\S[^\r\n]*)', 1))"


@query("infer_format", rf"""SELECT doc_id, CASE WHEN f LIKE '{{%' OR f LIKE '[%' THEN 'json' WHEN f LIKE '<%' THEN 'xml' ELSE 'delimited_text' END AS format, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS sample_lines
 FROM (SELECT doc_id, text, {_FIRSTLINE} AS f FROM documents) UNION ALL SELECT -1 - page_id, 'xml', len(list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '')) FROM pages""")
def infer_format(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", c("text").alias("body")).unionByName(table(spark, sf, "pages").select((-1 - c("page_id")).alias("doc_id"), c("html").alias("body")))
    first = infer.first_line(c("body"))
    return docs.select("doc_id", infer.file_format(first).alias("format"), infer.line_total(c("body")).cast("bigint").alias("sample_lines"))


@query("infer_encoding", r"SELECT doc_id, CASE WHEN lang = 'fr' AND regexp_matches(text, '[^\x00-\x7F]') THEN 'iso-8859-1' ELSE 'utf-8' END AS encoding FROM documents")
def infer_encoding(spark, sf):
    """French text is delivered in latin-1, which is not valid UTF-8 once it has an accent."""
    body = F.when(c("lang") == "fr", F.concat(F.encode("text", "UTF-8"), F.when(c("text").rlike(r"[^\x00-\x7F]"), lit(b"\xe9")).otherwise(lit(b"")))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", infer.encoding(body).alias("encoding"))


_VOTE = "length({f}) - length(replace({f}, {d}, ''))"


@query("infer_delimiter", rf"""SELECT doc_id, CASE WHEN greatest(a, b, p, s) = 0 THEN ',' WHEN a = greatest(a, b, p, s) THEN ',' WHEN b = greatest(a, b, p, s) THEN chr(9) WHEN p = greatest(a, b, p, s) THEN '|' ELSE ';' END AS delimiter FROM
 (SELECT doc_id, {_VOTE.format(f='f', d="','")} AS a, {_VOTE.format(f='f', d='chr(9)')} AS b, {_VOTE.format(f='f', d="'|'")} AS p, {_VOTE.format(f='f', d="';'")} AS s FROM (SELECT doc_id, {_FIRSTLINE} AS f FROM documents))""")
def infer_delimiter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", infer.delimiter(infer.first_line(c("text"))).alias("delimiter"))


@query("infer_headers", r"""SELECT o_orderkey, 4 AS header_count, concat_ws('/', concat('id ', o_custkey), o_orderstatus, 'say "x"', o_orderpriority) AS headers FROM orders""")
def infer_headers(spark, sf):
    first = F.concat(lit("' id "), c("o_custkey").cast("string"), lit(" ' | \""), c("o_orderstatus"), lit('" | "say ""x""" |'), c("o_orderpriority"))
    h = infer.headers(first, lit("|"))
    return table(spark, sf, "orders").select("o_orderkey", F.size(h).alias("header_count"), F.array_join(h, "/").alias("headers"))


@query("infer_tokens", r"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'headers_data' WHEN 'O' THEN 'sales_data' ELSE 'folio_' || lower(regexp_extract(o_orderpriority, '[A-Z]+')) END AS report_type,
 concat('P', o_custkey) AS property, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderstatus = 'F' THEN 'a91f' END AS hash FROM orders""")
def infer_tokens(spark, sf):
    name = F.concat(lit("in/"), F.when(c("o_orderstatus") == "F", "headers_data").when(c("o_orderstatus") == "O", "sales_data").otherwise(F.concat(lit("folio_"), F.lower(F.regexp_extract("o_orderpriority", "[A-Z]+", 0)))),
                    lit("_P"), c("o_custkey").cast("string"), lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(c("o_orderstatus") == "F", "__a91f").otherwise(""), lit(".csv"))
    return table(spark, sf, "orders").select("o_orderkey", infer.name_tokens(name).alias("t")).select("o_orderkey", "t.*")
