"""Operators against plain Python on small inputs."""

import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from quaycheck.functions import patterns as pt
from quaycheck.functions.common import call, strings
from quaycheck.functions.dates import parse_business_date, parse_cutoff_seconds
from quaycheck.operators import anomaly, contracts, identity, infer, lines, manifest, outcome, physical, quality, revenue, sets, sla
from quaycheck.sources import control, landing

c, lit = F.col, F.lit


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_patterns(spark):
    rx = [r"^(?<report_type>[a-z_]+)_(?P<property>[A-Z(]+)(x)?_(?:q)(?P<date>\d+)$", "a(b", "plain"]
    p = pt.compiled(c("p"))
    got = one(spark, [(r,) for r in rx], "p string", p["regex"], p["names"])
    assert got == [(r"^([a-z_]+)_([A-Z(]+)(x)?_(?:q)(\d+)$", ["report_type", "property", "", "date"]), (None, [""]), ("plain", [])]
    g = pt.groups(c("t"), pt.literal_pattern(rx[0]))
    assert one(spark, [("ab_A(_q7",)], "t string", g) == [({"report_type": "ab", "property": "A(", "date": "7"},)]
    n = pt.any_of(strings(["^a", "b(", "", "(?P<x>c)"]))
    assert one(spark, [("",)], "t string", n) == [("(?:^a)|(?:(c))",)]


def test_noise_globs_match_python(spark):
    from fnmatch import fnmatchcase

    globs = ["*.tmp", "._*", "a?c", "[ab]x", "[!ab]y", "x+y.(z)"]
    names = ["f.tmp", "d/._q", "abc", "ac", "ax", "cx", "cy", "ay", "x+y.(z)", "xxy.(z)", "plain"]
    regex, folders = identity.noise_regex(strings(globs)), identity.noise_folders(strings(["__MACOSX/"]))
    got = dict(one(spark, [(n,) for n in names + ["a/__MACOSX/f"]], "n string", c("n"), identity.is_noise(c("n"), regex, folders)))
    for n in names:
        assert got[n] == any(fnmatchcase(n, g) or fnmatchcase(n.rsplit("/")[-1], g) for g in globs), n
    assert got["a/__MACOSX/f"]


def test_object_keys(spark):
    paths = ["s3://b/k/x.csv", "https://h/p/q?x=1", "/a/b", "a\\b\\c", "", "s3://b"]
    got = one(spark, [(p,) for p in paths], "p string", identity.object_key(c("p")), identity.basename(c("p")))
    assert got == [("b/k/x.csv", "x.csv"), ("p/q", "q?x=1"), ("a/b", "b"), ("a\\b\\c", "c"), ("", ""), ("b/", "b")]


def test_encoding_offsets_match_python(spark):
    rng = random.Random(5)
    payloads = [bytes(rng.choice(b"abc\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xff\x81") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    payloads += ["é€😀".encode(), b"\xed\xa0\x80", b"\xc0\xaf", b"\xe2\x82", b"\xf4\x90\x80\x80"]
    rows = [(p, e) for p in payloads for e in ("utf-8", "ASCII", "windows-1252", "latin-1")]
    e = physical.encoding_check(c("b"), c("e"), lit(False))
    text = physical.decoded(c("b"), e["used"])
    got = one(spark, rows, "b binary, e string", c("b"), c("e"), e["ok"], e["error_start"], e["offending_byte"], text)
    for b, enc, ok, start, byte, decoded in got:
        b = bytes(b)
        try:
            want = b.decode(enc)
            assert ok and want == decoded, (b, enc)
        except UnicodeDecodeError as err:
            assert (ok, start, byte) == (False, err.start, b[err.start:err.start + 1].hex()), (b, enc)


#: Per policy: what ends a line, then what is dropped as a stray.
MARKS = {"crlf": "(\r\n)|([\r\n])", "lf": "(\n)|(\r)", "cr": "(\r)"}


def strict_split(text, policy):
    """From the rules: NUL runs and strays are dropped and counted; the rest is lines, each up to and with its end."""
    dropped, text = len(re.findall("\0+", text)), text.replace("\0", "")
    if policy == "any" or (policy == "crlf" and "\r\n" not in text):
        return text.splitlines(), len(text.splitlines()), dropped
    marks = [m.lastindex for m in re.finditer(MARKS[policy], text)]
    marked = re.sub(MARKS[policy], lambda m: "\0" if m.lastindex == 1 else "", text)
    unfinished = marked != "" and not marked.endswith("\0")
    return [x.rstrip("\0") for x in re.findall("[^\0]*\0|[^\0]+", marked)], marks.count(1) + unfinished, dropped + marks.count(2)


def test_split_strict_matches_python(spark):
    rng = random.Random(3)
    texts = ["", "\r\n", "a", "\n\n", "a\r\n\r"] + ["".join(rng.choice(["a", "b|", "\r", "\n", "\r\n", "\x00"]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(t, p) for t in texts for p in ("crlf", "lf", "cr", "any")]
    s = lines.split_strict(c("t"), c("p"))
    for t, p, got, segments, skipped in one(spark, rows, "t string, p string", c("t"), c("p"), s["lines"], s["segments"], s["skipped"]):
        assert (got, segments, skipped) == strict_split(t, p), (t, p)


def test_default_header_and_buckets(spark):
    rng = random.Random(1)
    rows = [(f, i, rng.choice(["", " ", "x", "#n", "y|z"])) for f in range(30) for i in range(rng.randint(1, 12))]
    none = lit(None).cast("string")
    df = spark.createDataFrame(rows, "f int, line_no int, line string").withColumn("row_class", lines.engine_class(c("line"), none, none, lit(r"^\s*$|^#")))
    counts = {r.f: r for r in lines.count_classes(lines.with_default_header(df, "f"), "f", ["ignore", "header", "footer", "data"]).collect()}
    for f in range(30):
        mine = [x for g, _, x in rows if g == f]
        kept = [x for x in mine if x.strip() and not x.startswith("#")]
        r = counts[f]
        assert (r.ignore_rows, r.header_rows, r.data_rows) == (len(mine) - len(kept), min(1, len(kept)), max(0, len(kept) - 1))
        assert r.total_rows == r.ignore_rows + r.header_rows + r.data_rows + r.footer_rows


def test_slots_and_surplus(spark):
    rows = [(1, "U1 U2"), (1, "U2 U3"), (2, "none"), (3, "U9")]
    df = spark.createDataFrame(rows, "f int, line string")
    slots = call("regexp_extract_all", c("line"), r"U\d", 0)
    for mode, want in (("distinct_slots", {1: 3, 2: 0, 3: 1}), ("max_per_row", {1: 2, 2: 0, 3: 1}), ("total_matches", {1: 4, 2: 0, 3: 1})):
        assert {r.f: r.detected for r in lines.slot_inventory(df, "f", slots, lit(2), mode).collect()} == want
    beyond = lines.surplus_slots(lines.slot_counts(df, "f", slots), "f", lit(2)).collect()
    assert [(r.f, r.slot, r["rank"]) for r in beyond] == [(1, "U3", 3)]


def test_siblings_with_unknown_tokens_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.choice(["p", "q", None]), rng.choice(["1", "2", None]), rng.choice("abcz")) for _ in range(60)]
    df = spark.createDataFrame(rows, "b string, p string, d string, m string")
    got = {(r.b, r.p, r.d): sorted(r.present) for r in sets.siblings_present(df, "b", "p", "d", "m", strings("abc")).collect()}
    ok = lambda x, y: x is None or y is None or x == y
    for b, p, d, _ in rows:
        assert got[b, p, d] == sorted({m for b2, p2, d2, m in rows if b2 == b and ok(p, p2) and ok(d, d2) and m in "abc"})


@pytest.mark.parametrize("weekday", [False, True])
def test_baselines_agree_with_statistics(spark, weekday):
    rng = random.Random(4)
    start = dt.date(2026, 1, 1)
    rows = [("a", start + dt.timedelta(days=rng.randint(0, 70)), 100 if i < 60 else rng.randint(0, 10**9), rng.random() * 1e6, "PASS" if i % 5 else "REJECT_FILE") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, d date, n bigint, a double, o string")
    days = anomaly.baseline_days(df, ["k"], "d", "n", "a", "o")
    back = {r.d: r for r in anomaly.rolling(days, ["k"], "d", 21, weekday).withColumn("sd", anomaly.spread(c("base_n"), c("base_s"), c("base_ss"))).collect()}
    asked = {r.d: r for r in anomaly.baseline_for(days.select("k", "d"), days, ["k"], "d", lit(21), lit(weekday)).withColumn(
        "sd", anomaly.spread(c("base_n"), c("base_s"), c("base_ss"))).collect()}
    for d, r in back.items():
        past = [n for _, e, n, _, o in rows if o == "PASS" and d - dt.timedelta(days=21) <= e < d and (not weekday or e.weekday() == d.weekday())]
        if not past:
            assert r.base_n is None and d not in asked
            continue
        assert r.base_n == asked[d].base_n == len(past)
        assert r.sd == pytest.approx(statistics.pstdev(past), rel=1e-9) and asked[d].sd == r.sd


def test_z_of_a_flat_baseline(spark):
    z = anomaly.z_score(c("v"), c("n"), c("s"), c("ss"))
    got = one(spark, [(5.0, 3, 15, 75), (6.0, 3, 15, 75)], "v double, n bigint, s bigint, ss bigint", z, anomaly.z_verdict(c("n"), lit(3), z, lit(2.5)))
    assert got == [(0.0, "NORMAL"), (float("inf"), "ANOMALY")]


def test_dates(spark):
    texts = ["2026-08-09", "20260809", "2026-8-9", "2026-08-09T10:00:00", "2026/8/9", "2026-13-01", "", "x", None]
    got = [r[0] for r in one(spark, [(t,) for t in texts], "t string", parse_business_date(c("t")))]
    day = dt.date(2026, 8, 9)
    assert got == [day, day, day, day, day, None, None, None, None]
    cut = [r[0] for r in one(spark, [("07:30",), ("07:30:15",), ("25:00",), (None,), ("noon",)], "t string", parse_cutoff_seconds(c("t")))]
    assert cut == [27000, 27015, 21600, 21600, 21600]


def test_csv_fields(spark):
    import csv

    texts = ["a,b,c", ",a", "a,,", '"x,y",z', '"say ""hi""",2', "", "a"]
    got = one(spark, [(t,) for t in texts], "t string", c("t"), quality.csv_fields(c("t"), lit(",")))
    for t, fields in got:
        assert fields == (next(csv.reader([t])) if t else [""]), t
    assert one(spark, [("a|b.c|",)], "t string", quality.csv_fields(c("t"), lit("|"))) == [(["a", "b.c", ""],)]


def test_numbers(spark):
    texts = ["1", " 2.5 ", "1e3", "ERR", "10d", "NaN", "", None, "-.5"]
    got = one(spark, [(t,) for t in texts], "t string", quality.number(c("t")), quality.is_poison(c("t")))
    assert [p for _, p in got] == [False, False, False, True, True, True, True, False, False]
    assert one(spark, [("1.005",), ("2.675",), ("x",)], "t string", revenue.cents(c("t")).cast("string")) == [("1.01",), ("2.68",), (None,)]


def test_rule_ids(spark):
    cases = [("physical_integrity", "", "G1_PHYSICAL_INTEGRITY"), ("G2_ZSCORE_ANOMALY", "", "G2_ZSCORE_ANOMALY"), ("sales-vs tender_balance", "", "G4_FINANCIAL_IMBALANCE"), ("", "x", "UNKNOWN"),
             ("zz", "decode error at 3", "G1_PHYSICAL_INTEGRITY"), ("zz", "EMPTY_PAYLOAD", "G1_EMPTY_PAYLOAD"), ("g9_new", "", "G9_NEW"), ("zz", "", "zz"), ("noise_filter", "", "G1_NOISE_FILTER")]
    got = one(spark, [(a, b) for a, b, _ in cases], "a string, b string", manifest.rule_id(c("a"), c("b")))
    assert [g[0] for g in got] == [w for _, _, w in cases]


def test_readiness_adds_up(spark):
    rows = [(1000, 20, "FLAG"), (0, 0, "REJECT_FILE"), (10, 3, "QUARANTINE_FILE"), (3, 9, "PASS"), (7, 2, None)]
    r = manifest.readiness(c("t"), c("q"), c("o"))
    got = [x[0] for x in one(spark, rows, "t bigint, q bigint, o string", r)]
    assert [(x.readiness_pct, x.quarantine_pct, x.verified_rows, x.quarantined_rows) for x in got[:4]] == [(98.0, 2.0, 980, 20), (0.0, 100.0, 0, 1), (0.0, 100.0, 0, 10), (0.0, 100.0, 0, 3)]
    assert all(abs(x.readiness_pct + x.quarantine_pct - 100) < 0.011 for x in got)


def test_worst_of(spark):
    got = one(spark, [("FLAG", "HOLD_SET"), ("REJECT_FILE", "QUARANTINE_FILE"), ("PASS", "PASS")], "a string, b string", outcome.worst([c("a"), c("b")]))
    assert [g[0] for g in got] == ["HOLD_SET", "REJECT_FILE", "PASS"]


def test_inference(spark):
    body = [(b'\xef\xbb\xbf"a";b;c\r\n1;2;3\r\n\r\n',), (b"  \n[1]\n",), (b"<x/>",), (b"caf\xe9|x",), (b"",)]
    t = infer.text(c("b"))
    first = infer.first_line(t)
    got = one(spark, body, "b binary", infer.file_format(first), infer.encoding(c("b")), infer.delimiter(first), infer.line_total(t))
    assert got == [("delimited_text", "utf-8", ";", 2), ("json", "utf-8", ",", 1), ("xml", "utf-8", ",", 1), ("delimited_text", "iso-8859-1", "|", 1), ("delimited_text", "utf-8", ",", 0)]


def test_unknown_zone_is_utc(spark):
    assert [r[0] for r in one(spark, [("Europe/Madrid",), ("Mars/Olympus",), ("",)], "z string", sla.zone_or_utc(c("z")))] == ["Europe/Madrid", "UTC", "UTC"]


def test_landing_prefix_and_version(spark):
    docs = [('{"a":1}', "p/"), ('{"filename":{"path_regex":"x"}}', "p/"), ('{"a":1}', None)]
    got = [r[0] for r in one(spark, docs, "d string, p string", contracts.with_landing_prefix(c("d"), c("p")))]
    assert got == ['{"a":1,"s3_prefix_pattern":"p/"}', '{"filename":{"path_regex":"x"}}', '{"a":1}']
    v = [r[0] for r in one(spark, [("1786501628757",), ("2.0",), (None,)], "v string", contracts.version_token(c("v"), lit(7).cast("bigint")))]
    assert v == [1786501628757, 7, 7]


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    for name, n in (("a.txt", 2000), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = landing.read_lines(spark, str(tmp_path))
        assert landing.read_splits(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        got = df.select(F.element_at(F.split("path", "/"), -1).alias("f"), "line_no", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2003 and all(r.line == f"{r.f} line {r.line_no}" for r in got)


def test_inventory_shows_markers_and_empty_files(spark, tmp_path):
    for name in ("top.csv", "d/_SUCCESS", "d/._x", "d/e/empty.csv"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if name != "top.csv" else "x")
    got = {r.basename: r.length for r in landing.list_folder(spark, str(tmp_path)).collect()}
    assert got == {"top.csv": 1, "_SUCCESS": 0, "._x": 0, "empty.csv": 0}


def test_append_and_replay(spark, tmp_path):
    rows = spark.createDataFrame([("r1", dt.date(2026, 8, 9), "PASS"), ("r2", dt.date(2026, 8, 10), "FLAG")], "run_id string, business_date date, overall_outcome string")
    path = str(tmp_path / "runs")
    control.append_runs(rows, path)
    control.append_runs(control.new_runs_only(rows, spark.read.parquet(path)), path)
    stored = control.scan(spark, path, c("business_date") == lit(dt.date(2026, 8, 9)))
    assert spark.read.parquet(path).count() == 2 and [r.run_id for r in stored.collect()] == ["r1"]
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(business_date" in plan
    assert control.align(rows, ["run_id", "released_by"]).columns == ["run_id", "released_by"]


def test_missing_delivery_rows(spark):
    props = spark.createDataFrame([("A", "UTC", "06:00", "30"), ("B", "Asia/Tokyo", "23:00", "0"), ("C", "UTC", None, None)], "property_id string, tz string, cutoff string, grace string")
    runs = spark.createDataFrame([("A", dt.date(2026, 8, 9), "x", "PASS"), ("A", dt.date(2026, 8, 9), "y", "FLAG")], "property_id string, day date, report_type string, overall_outcome string")
    due = sla.with_deadline(props, "tz", "cutoff", "grace", lit("2026-08-09 07:00:00").cast("timestamp"))
    out = sla.missing_deliveries(due, runs, "property_id", "day", "report_type", F.when(c("property_id") == "A", strings(["x", "y"])).otherwise(strings([])))
    assert {r.property_id: (r.event_type, r.missing) for r in out.collect()} == {"A": ("MISSING_DELIVERY", ["y"]), "B": ("IN_WINDOW", [sla.ANY_DELIVERY]), "C": ("MISSING_DELIVERY", [sla.ANY_DELIVERY])}
    assert {r.run_id for r in sla.missing_delivery_runs(out, "property_id").collect()} == {"missing_A_2026-08-09", "missing_C_2026-08-09"}


def test_lint_parses_a_document_once(spark):
    bad = '{"profile_id":"A","physical":{"min_bytes":0},"structure":{"expected_sections":[{"marker_pattern":"("},{"marker_pattern":"["}]}}'
    docs = spark.createDataFrame([("{",), (bad,)], "doc string")
    assert docs.select(contracts.lint(c("doc"))).columns[0].count("parse_json") == 1
    found = docs.select(contracts.lint(c("doc")).alias("errors"))
    broken, errors = (r.errors for r in found.collect())
    assert broken == ["<root>: not a document"]
    assert {"profile_id: malformed A", "physical.min_bytes: below 1", "structure.expected_sections: invalid pattern (, ["} <= set(errors)
    rows = spark.range(100).select(lit(bad).alias("doc"))
    assert rows.select(F.size(contracts.lint(c("doc"))).alias("n")).distinct().count() == 1


@pytest.mark.parametrize("marker", [None, "_SUCCESS"])
def test_objects_of_one_folder_are_dealt_over_tasks(spark, marker):
    objects = spark.range(4000).select(F.concat(lit("day/part"), c("id").cast("string")).alias("key"))
    inventory = spark.createDataFrame([("day/_SUCCESS",), ("other/_SUCCESS",)], "object_key string")
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = sets.commit_markers(objects, inventory, "key", lit(marker).cast("string"))
        parts = found.select("has_marker", F.spark_partition_id().alias("p")).groupBy("p", "has_marker").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.has_marker for r in parts} == {marker is not None} and sum(r["count"] for r in parts) == 4000
    assert max(r["count"] for r in parts) < 2000
