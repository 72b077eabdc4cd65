"""The four gates over small literal files."""

import datetime as dt
import json

import pytest
from fixtures import OTHER_QUAY, QUAY, SET, pos_body, pos_contract, pos_name
from pyspark.sql import functions as F

from quaycheck.operators import contracts
from quaycheck.plans import gate

LANDED = "file_id string, batch_id string, property_id string, contract_id string, filename string, path string, content binary"
HISTORY = ("run_id string, property_id string, report_type string, business_date date, overall_outcome string,"
           " checksum_sha256 string, row_count bigint, net_amount double")
LAKE = {"feed_category": "lake", "profile_id": "s3parquet", "property_code": QUAY,
        "object_landing": {"format": "parquet", "partition_path": "zone/{property}/till/day={date}/", "require_commit_marker": True}}
CSV = {"feed_category": "pos", "property_code": QUAY,
       "filename": {"pattern": r"^(?P<report_type>[a-z]+)@(?P<property>[A-Z0-9-]+)@(?P<date>\d{8})\.csv$", "path_agree": False},
       "file_format": {"encoding": "utf-8", "delimiter": ","}}
ALONE = {"is_multi_file": False, "required_endpoints": []}


def csv(**over):
    return json.dumps({**CSV, **over})


CONTRACTS = {
    "pos": pos_contract(),
    "single": pos_contract(atomic_set=ALONE),
    "path": pos_contract(filename={"path_agree": True, "path_pattern": r"till/(?<date>\d{8})/(?<property>[A-Z0-9-]+)/"}, atomic_set=ALONE),
    "lake": json.dumps(LAKE),
    "jsonl": json.dumps({**LAKE, "object_landing": {"format": "jsonl", "partition_path": "zone/{property}/till/day={date}/",
                                                    "watermark_column": "seen_at", "require_commit_marker": False}}),
    "delta": json.dumps({**LAKE, "object_landing": {"format": "Delta", "partition_path": "zone/{property}/berths/", "require_commit_marker": True}}),
    "csv": csv(),
    "quality": csv(gate_3={"required_columns": ["ticket", "fare"], "numeric_columns": ["fare"], "non_null_columns": ["ticket"],
                           "numeric_ranges": [{"column": "fare", "min_value": 0, "max_value": 900}]}),
    "footers": csv(row_classification={
        "header_patterns": ["^ticket,"], "footer_patterns": ["^all fares", "^-- close", r"^n=\d+$"],
        "row_count_declaration": {"pattern": r"^n=(?P<declared_row_count>\d+)$"}}),
    "cents": csv(gate_4={"max_variance": 0.01}),
    "badregex": csv(filename={"pattern": "^[a-z", "path_agree": False}),
    "nordic": csv(file_format={"encoding": "utf-8", "delimiter": ",", "allow_encoding_fallback": True}),
    "spike": csv(gate_2={"rolling_window_days": 45, "max_z_score": 2.5}),
}
DAY = dt.date(2025, 3, 14)
FLAT_ROWS = 60
OLD = f"tickets@{QUAY}@20250314.csv"
BODY = b"ticket,fare\n81,4.25\n82,6.75\n"
TWICE, DRIFTED = b"ticket,deck\n44,upper\n", b"ticket,deck\n44,car\n"
KEY = f"harbour/zone/{QUAY}/till/day=2025-03-14/"


def counted(rows):
    return ("ticket,deck\n" + "9,car\n" * rows).encode()


FILES = [
    # file_id, batch, contract, filename, path, content
    ("t", "full", "pos", pos_name("tickets"), None, pos_body()),
    ("b", "full", "pos", pos_name("boardings"), None, pos_body(6)),
    ("r", "full", "pos", pos_name("refunds"), None, pos_body(1)),
    ("held", "alone", "pos", pos_name("boardings"), None, pos_body()),
    ("badname", "full", "pos", "tide table.psv", None, pos_body()),
    ("stranger", "full", "pos", pos_name("parcels"), None, pos_body()),
    ("otherquay", "full", "pos", pos_name("boardings", prop=OTHER_QUAY), None, pos_body()),
    ("declared", "d", "single", pos_name("tickets"), None, pos_body(4, 9)),
    ("zero", "d", "single", pos_name("tickets"), None, b""),
    ("headeronly", "d", "single", pos_name("tickets"), None, b"ticket;fare;deck\r\n-- close\r\n"),
    ("nordic", "d", "single", pos_name("tickets"), None, b"ticket;rider\r\n7;Bj\xf8rn\r\n"),
    ("noise", "d", "single", "._tickets.psv", "__MACOSX/._tickets.psv", pos_body()),
    ("pathok", "d", "path", pos_name("tickets"), f"s3://quay/till/20250314/{QUAY}/x.psv", pos_body()),
    ("pathbad", "d", "path", pos_name("tickets"), f"s3://quay/till/20250314/{OTHER_QUAY}/x.psv", pos_body()),
    ("lakeok", "l", "lake", "a0.parquet", KEY + "a0.parquet", b"PAR1"),
    ("lakehold", "l", "lake", "a1.parquet", KEY.replace("03-14", "03-15") + "a1.parquet", b"PAR1"),
    ("jsonlok", "l", "jsonl", "m.jsonl", KEY + "m.jsonl", b'\n{"deck": 2, "seen_at": "06:10"}\n'),
    ("jsonlbad", "l", "jsonl", "n.jsonl", KEY + "n.jsonl", b'{"deck": 2}\n'),
    ("delta", "l", "delta", "a2.parquet", f"zone/{QUAY}/berths/a2.parquet", b"PAR1"),
    ("poison", "q", "quality", OLD, None, b"ticket,fare\nK1,4.25\nfree,n.a.x\nK3,6.00\n"),
    ("nullrow", "q", "quality", OLD, None, b'ticket,fare\nK1,2.00\n,4.25\n"K,2",6.75\n'),
    ("range", "q", "quality", OLD, None, b"ticket,fare\nK1,12\nK2,901\n"),
    ("nocol", "q", "quality", OLD, None, b"ticket,price\nK1,3\n"),
    ("clean", "q", "quality", OLD, None, b"ticket,fare\nK1,3\nK2,900\n"),
    ("footers", "q", "footers", OLD, None, b"ticket,fare,rider\n81,4.00,Ove\n82,6.50,Siv\n83,3.25,Liv\n84,1.00,Bo\nall fares 14.75\n-- close --\nn=4\n"),
    ("split", "q", "cents", OLD, None, b"check_total,tender_payment,net_sales\n31.00,12.40,31.00\n,7.15,\n,11.45,\n"),
    ("imbalance", "q", "cents", OLD, None, b"tender_payment,net_sales\n61.10,68.00\n5.40,2.00\n"),
    ("headline", "q", "cents", OLD, None, b"header_total,line_item_amount,tax\n24.00,9.50,1.20\n7.00,12.00,1.29\n"),
    ("badregex", "q", "badregex", OLD, None, BODY),
    ("fallback", "q", "nordic", OLD, None, b"ticket,rider\n7,Bj\xf8rn\n"),
    ("dup", "q", "csv", f"twice@{QUAY}@20250314.csv", None, TWICE),
    ("drift", "q", "csv", f"drift@{QUAY}@20250314.csv", None, DRIFTED),
    ("frozen", "q", "csv", f"tickets@{QUAY}@20241220.csv", None, DRIFTED),
    ("spike", "q", "spike", f"volume@{QUAY}@20250316.csv", None, counted(2600)),
    ("cold", "q", "spike", f"fresh@{QUAY}@20250316.csv", None, counted(310)),
    ("flat", "q", "csv", f"flat@{QUAY}@20250316.csv", None, counted(59)),
    ("offflat", "q", "csv", f"flat@{QUAY}@20250316.csv", None, counted(57)),
]


def expected_hash(body):
    import hashlib

    return hashlib.sha256(body).hexdigest()


def history_rows():
    before = lambda days: DAY - dt.timedelta(days=days)
    rows = [("one", QUAY, "twice", before(5), "RELEASED_TO_ETL", expected_hash(TWICE), 40, None),
            ("two", QUAY, "drift", DAY, "PASS", "e" * 64, 40, None)]
    for i in range(12):
        rows.append((f"v{i}", QUAY, "volume", before(3 + i), "PASS", f"{i:064d}", 800 + (i % 4) * 7, None))
        rows.append((f"f{i}", QUAY, "flat", before(i), None, f"{i + 50:064d}", FLAT_ROWS, None))
    rows += [(f"n{i}", QUAY, "fresh", before(4 + 6 * i), "PASS", str(i) * 64, 90, None) for i in range(2)]
    return rows


@pytest.fixture(scope="module")
def run(spark):
    landed = spark.createDataFrame([(i, b, QUAY, c, n, p, body) for i, b, c, n, p, body in FILES], LANDED)
    docs = spark.createDataFrame(list(CONTRACTS.items()), "contract_id string, doc string")
    history = spark.createDataFrame(history_rows(), HISTORY)
    inventory = spark.createDataFrame([(KEY + "_SUCCESS",), (f"zone/{QUAY}/berths/_delta_log/0.json",)], "object_key string")
    return gate.evaluate(landed, contracts.normalise(docs, "contract_id", "doc"), history,
                         F.lit(DAY + dt.timedelta(days=3)), inventory=inventory)


@pytest.fixture(scope="module")
def reports(run):
    return {r["file_id"]: r for r in run.reports.collect()}


def check(report, gate_no, rule):
    return next(e for e in report[f"g{gate_no}"] if e["rule_name"] == rule)


@pytest.mark.parametrize("file_id,gate_one", [
    ("t", "PASS"), ("b", "PASS"), ("r", "PASS"), ("held", "HOLD_SET"), ("badname", "QUARANTINE_FILE"), ("stranger", "QUARANTINE_FILE"),
    ("otherquay", "QUARANTINE_FILE"), ("declared", "QUARANTINE_FILE"), ("zero", "QUARANTINE_FILE"), ("headeronly", "QUARANTINE_FILE"),
    ("nordic", "REJECT_FILE"), ("noise", "QUARANTINE_FILE"), ("pathok", "PASS"), ("pathbad", "QUARANTINE_FILE"), ("lakeok", "PASS"),
    ("lakehold", "HOLD_SET"), ("jsonlok", "PASS"), ("jsonlbad", "QUARANTINE_FILE"), ("delta", "PASS"), ("footers", "PASS"),
    ("badregex", "QUARANTINE_FILE"), ("fallback", "PASS"),
])
def test_gate_one(reports, file_id, gate_one):
    assert reports[file_id]["g1_outcome"] == gate_one


def test_every_file_is_reported_once(run, reports):
    assert run.reports.count() == len(FILES) == len(reports)


def test_line_accounting_keeps_footers_out(reports):
    d = check(reports["footers"], 1, "line_conservation")["details"]
    assert (d["data_lines"], d["footer_lines"], d["declared_count"]) == ("4", "3", "4")


def test_encoding_failure_names_the_byte(reports):
    e = check(reports["nordic"], 1, "physical_integrity")
    assert not e["passed"] and e["details"]["offending_byte"] == "f8" and e["details"]["error_start"] == "18"
    assert [x["skipped"] for x in reports["nordic"]["g1"] if x["rule_name"] == "atomic_set"] == [True]


def test_hold_names_what_is_missing(reports):
    assert check(reports["held"], 1, "atomic_set")["details"]["missing_endpoints"] == ",".join(x for x in SET if x != "boardings")


def test_noise_and_empty_files_list_one_finding(reports):
    assert [e["rule_name"] for e in reports["noise"]["g1"]] == ["noise_filter"]
    assert [e["rule_name"] for e in reports["zero"]["g1"]] == ["non_empty_payload"]
    assert reports["zero"]["overall_outcome"] == "REJECT_FILE" and reports["zero"]["g4_outcome"] == "REJECT_FILE"


def test_gate_two_is_skipped_for_blocked_files_only(reports):
    assert reports["nordic"]["g2"][0]["rule_name"] == "G2_SKIPPED"
    assert len(reports["held"]["g2"]) == 4


@pytest.mark.parametrize("file_id,rule,outcome", [
    ("dup", "G2_DUPLICATE_PAYLOAD", "QUARANTINE_FILE"), ("drift", "G2_OVERLAP_DRIFT", "FLAG"),
    ("frozen", "G2_FROZEN_WINDOW", "QUARANTINE_FILE"), ("spike", "G2_ZSCORE_ANOMALY", "FLAG"), ("offflat", "G2_ZSCORE_ANOMALY", "FLAG"),
])
def test_anomalies(reports, file_id, rule, outcome):
    assert not check(reports[file_id], 2, rule)["passed"]
    assert reports[file_id]["g2_outcome"] == outcome


def test_cold_start_and_flat_baseline_pass(reports):
    assert check(reports["cold"], 2, "G2_ZSCORE_ANOMALY")["details"]["cold_start"] == "true"
    assert check(reports["flat"], 2, "G2_ZSCORE_ANOMALY")["passed"]


@pytest.mark.parametrize("file_id,rule", [
    ("poison", "numeric_column_integrity"), ("nullrow", "non_null_constraints"), ("range", "numeric_range_bounds"), ("nocol", "required_columns")])
def test_quality(reports, file_id, rule):
    assert not check(reports[file_id], 3, rule)["passed"]
    assert reports[file_id]["g3_outcome"] == "QUARANTINE_FILE"
    assert reports["clean"]["g3_outcome"] == "PASS"


def test_violations_name_row_and_value(run):
    rows = {(r.file_id, r.rule_name, r.row_no, r.column, r.value) for r in run.violations.collect()}
    assert ("poison", "numeric_column_integrity", 1, "fare", "n.a.x") in rows
    assert ("nullrow", "non_null_constraints", 1, "ticket", None) in rows


def test_revenue(reports):
    assert reports["split"]["g4_outcome"] == "PASS"
    assert reports["headline"]["g4_outcome"] == "PASS"  # 23.99 of 24.00: one cent is allowed
    assert reports["imbalance"]["g4_outcome"] == "REJECT_FILE"
    assert "Variance: 3.50" in check(reports["imbalance"], 4, "sales_vs_tender_balance")["message"]


def test_readiness(reports):
    assert (reports["nordic"]["readiness"]["readiness_pct"], reports["nordic"]["readiness"]["quarantined_rows"]) == (0.0, 1)
    assert reports["t"]["readiness"]["readiness_pct"] == 100.0


def test_manifest(run):
    items = {(r.file_id, r.rule_id): r for r in run.manifest().collect()}
    poison = items["poison", "G3_TYPE_CAST_FAIL"]
    assert (poison.affected_rows, poison.is_file_level, poison.suggested_category) == (1, False, "DATA_QUALITY_BUG")
    money = items["imbalance", "G4_FINANCIAL_IMBALANCE"]
    assert (money.affected_rows, money.is_file_level, money.suggested_category) == (0, True, "UNBALANCED_REVENUE")
    assert items["nordic", "G1_PHYSICAL_INTEGRITY"].suggested_category == "DATA_QUALITY_BUG"
    assert {f for f, _ in items} == {r.file_id for r in run.reports.where("overall_outcome <> 'PASS'").collect()}


def test_stored_form_round_trips(run, spark):
    from quaycheck.operators import manifest

    stored = gate.stored_form(run.reports.where("file_id = 'poison'"))
    evals = manifest.stored_evaluations(stored, "run_id", "gate_evaluations").where("not passed").collect()
    assert {(e.gate, e.rule_name) for e in evals} == {("gate_3", "numeric_column_integrity")}
