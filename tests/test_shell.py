"""The rule shell over small literal files."""

import copy
import datetime as dt
import json

import pytest
from fixtures import KINDS, PROFILE, shell_body
from pyspark.sql import functions as F

from quaycheck.plans import shell

FILES = "file_id string, batch_id string, profile_id string, filename string, path string, content binary, manifest_text string"


def name(kind, prop="Q204", tide="1"):
    return f"{prop}-14032025-{tide}-{kind}.log"


def full(prefix, batch, body_of):
    return [(f"{prefix}{k}", batch, "berth_log", name(k), None, body_of(k), None) for k in KINDS]


@pytest.fixture(scope="module")
def reports(spark):
    broken = copy.deepcopy(PROFILE)
    broken.update(profile_id="Berth Log")
    del broken["filename"]["transport"]
    by_path = copy.deepcopy(PROFILE)
    by_path.update(profile_id="by_quay", atomic_sets=[])
    by_path["filename"] = {"transport": "uri_path", "required_groups": ["property"], "uri_path_pattern": r"quays/(?P<property>Q\d{3})/"}
    profiles = shell.normalise_profiles(spark.createDataFrame([(json.dumps(p),) for p in (PROFILE, by_path)], "doc string"), "doc")
    bad = shell.normalise_profiles(spark.createDataFrame([(json.dumps(broken),)], "doc string"), "doc")
    body = shell_body()
    single = lambda i, content, prop="Q204": (i, f"batch-{i}", "berth_log", name("LA", prop), None, content, None)
    pathed = lambda i, content, profile="by_quay": (i, f"batch-{i}", profile, f"{i}.log", f"/up/quays/Q204/{i}.log", content, None)
    rows = full("ok", "whole", lambda k: shell_body(kind=k)) + full("short", "counts", lambda k: shell_body(declare=14, kind=k)) + [
        single("alone", body),
        ("weird", "batch-weird", "berth_log", "notes from the pier.txt", None, body, None),
        single("misfiled", shell_body(prop="Q311")),
        single("unknown", shell_body(prop="Q999"), "Q999"),
        single("inactive", shell_body(prop="Q450"), "Q450"),
        single("lf", body.replace(b"\r\n", b"\n")),
        single("empty", b""),
        single("nul", body.replace(b"mole", b"m\x00le")),
        single("future", body.replace(b"2025-03-14;mole", b"2025-04-02;mole")),
        pathed("fewslots", body.replace(b";k3=s", b"")),
        pathed("moreslots", body.replace(b";k3=s", b";k3=s;k4=t")),
        pathed("nosection", body.replace(b"part;dues", b"part;tolls")),
        pathed("broken", body, "Berth Log"),
    ]
    registry = spark.createDataFrame([("Q204", True, None), ("Q311", True, "berth_log"), ("Q450", False, None)],
                                     "property_id string, active boolean, pms_profile string")
    out = shell.evaluate(spark.createDataFrame(rows, FILES), profiles.unionByName(bad), registry, F.lit(dt.date(2025, 3, 15)))
    return {r["file_id"]: r for r in out.collect()}


def status(report):
    return {e["rule_id"]: e["status"] for e in report["evaluations"]}


def test_complete_set_passes(reports):
    r = reports["okLA"]
    assert r["overall_outcome"] == "PASS" and set(status(r).values()) == {"PASS"} and len(r["evaluations"]) == 7
    assert (r["total_read_rows"], r["header_footer_rows"], r["accepted_rows"], r["rejected_rows"], r["ignored_rows"], r["quarantined_rows"]) == (12, 3, 5, 1, 3, 0)
    assert r["business_date"] == dt.date(2025, 3, 14) and r["declared_total"] == 12 and r["slots_detected"] == 3


def test_declared_mismatch(reports):
    r = reports["shortLA"]
    assert r["overall_outcome"] == "QUARANTINE_FILE" and r["unaccounted_rows"] == 2 and status(r)["R03_ROW_CONSERVATION"] == "FAIL"


def test_incomplete_set_holds(reports):
    assert reports["alone"]["overall_outcome"] == "HOLD_SET" and "LB, LC, LD" in reports["alone"]["outcome_reason"]


@pytest.mark.parametrize("file_id", ["weird", "unknown", "inactive"])
def test_identity_failure_skips_the_rest(reports, file_id):
    s = status(reports[file_id])
    assert reports[file_id]["overall_outcome"] == "QUARANTINE_FILE" and s.pop("R01_NAMING_CONTRACT") == "FAIL" and set(s.values()) == {"SKIPPED"}


def test_misfiled(reports):
    assert reports["misfiled"]["overall_outcome"] == "QUARANTINE_FILE" and "MISFILED_OBJECT" in reports["misfiled"]["outcome_reason"]


def test_physical_failures(reports):
    assert status(reports["lf"])["R02_PHYSICAL_INTEGRITY"] == "FAIL" and reports["lf"]["overall_outcome"] == "QUARANTINE_FILE"
    assert reports["empty"]["overall_outcome"] == "REJECT_FILE"


def test_skipped_bytes_break_conservation(reports):
    assert reports["nul"]["unaccounted_rows"] == 1 and reports["nul"]["overall_outcome"] == "QUARANTINE_FILE"


def test_future_date(reports):
    assert status(reports["future"])["R04_STATIC_DATE_BOUNDS"] == "FAIL"


def test_slots_and_sections(reports):
    assert reports["fewslots"]["overall_outcome"] == "FLAG" and status(reports["fewslots"])["R06_STRUCTURAL_UDF"] == "FLAG"
    assert reports["moreslots"]["overall_outcome"] == "FLAG" and reports["moreslots"]["unmapped"] == ["k4"]
    assert reports["nosection"]["overall_outcome"] == "QUARANTINE_FILE" and reports["nosection"]["missing_sections"] == ["DUES"]


def test_broken_profile_rejects(reports):
    r = reports["broken"]
    assert r["overall_outcome"] == "REJECT_FILE" and [e["rule_id"] for e in r["evaluations"]] == ["R00_PROFILE_SCHEMA"]
    assert "profile_id: malformed" in r["outcome_reason"] and "filename.transport: required" in r["outcome_reason"]
