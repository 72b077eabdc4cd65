"""History under scopes, evidence lists and baselines against plain Python."""

import datetime as dt
import json
import random

import pytest
from fixtures import QUAY, pos_body, pos_contract, pos_name
from pyspark.sql import functions as F
from test_gate import ALONE, DAY, HISTORY, LANDED, csv, expected_hash

from quaycheck.operators import anomaly, contracts
from quaycheck.plans import gate

SCOPE = ["property_id", "report_type"]
ROWS = "property_id string, report_type string, day date, checksum string, outcome string, run string, volume bigint, amount double"
OUTCOMES = ["PASS", "released_to_etl", "FLAG", "REJECT_FILE", "PASS_OVERRIDDEN", None, "HOLD_SET"]


@pytest.fixture(scope="module")
def past():
    rng = random.Random(9)
    pick = rng.choice
    return [(pick(["A", "B", None]), pick(["x", "y", None]), DAY - dt.timedelta(days=rng.randrange(60)) if rng.random() < 0.97 else None, pick(["h1", "h2", "h3", "", None]),
             pick(OUTCOMES), f"r{i:04d}", rng.randrange(50, 90), pick([None, 1.25, 7.5, 1e30])) for i in range(900)]


@pytest.fixture(scope="module")
def history(spark, past):
    return spark.createDataFrame(past, ROWS)


SCOPES = [("A", "x"), ("A", None), (None, "y"), (None, None), ("B", "y"), ("C", "x")]


def meets(scope, row):
    return all(a is None or b is None or a == b for a, b in zip(scope, row[:2], strict=True))


def is_in(outcome, allowed):
    return (outcome or "").upper() in allowed


def test_null_keys_match_every_value(spark, history, past):
    asked = spark.createDataFrame(SCOPES, "property_id string, report_type string")
    reduced = anomaly.baseline_days(history, SCOPE, "day", "volume", "amount", "outcome")
    got = {(r.property_id, r.report_type, r.day): (r.n, int(r.s), int(r.ss), r.an) for r in anomaly.regrouped(anomaly.scoped(asked, reduced, SCOPE), [*SCOPE, "day"]).collect()}
    want = {}
    for scope in SCOPES:
        for row in past:
            if meets(scope, row) and row[2] and (row[4] is None or is_in(row[4], anomaly.fx.BASELINE)):
                n, s, ss, an = want.get((*scope, row[2]), (0, 0, 0, 0))
                want[(*scope, row[2])] = (n + 1, s + row[6], ss + row[6] ** 2, an + (row[7] is not None and row[7] < 1e15))
    assert got == want


def test_history_is_reduced_before_it_is_scoped(spark, history, capsys):
    asked = spark.createDataFrame(SCOPES, "property_id string, report_type string")
    anomaly.scoped(asked, anomaly.released_hashes(history, SCOPE, "day", "checksum", "outcome"), SCOPE).explain("simple")
    plan = capsys.readouterr().out
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("CartesianProduct" in line for line in joins)
    assert plan.index("Join") < plan.index("HashAggregate(keys=[property_id")  # the aggregate lies below the joins


def test_matches_are_the_newest_ten(spark, history, past):
    asked = [(p, r, h) for p, r in SCOPES for h in ("h1", "h3", "absent")]
    got = {(r.property_id, r.report_type, r.checksum): [(m.run, m.day) for m in r.matches] for r in anomaly.matching_runs(
        history, spark.createDataFrame(asked, "property_id string, report_type string, checksum string"), SCOPE, "day", "checksum", "outcome", "run").collect()}
    for p, r, h in asked:
        rows = [x for x in past if meets((p, r), x) and x[3] == h and is_in(x[4], anomaly.fx.RELEASED)]
        rows.sort(key=lambda x: (-x[2].toordinal() if x[2] else 1, x[5]))
        assert got.get((p, r, h), []) == [(x[5], x[2]) for x in rows[:10]]


def test_conflicts_are_the_first_ten_of_other_hashes(spark, past):
    rng = random.Random(4)
    busy = [(*x[:3], f"h{rng.randrange(40)}" if i % 3 else "hot", *x[4:]) for i, x in enumerate(past)]
    busy = [(*x[:2], DAY if i % 2 else x[2], *x[3:]) for i, x in enumerate(busy)]
    asked = [(p, r, DAY, h) for p, r in SCOPES for h in ("hot", "h3", "mine")]
    table = spark.createDataFrame(asked, "property_id string, report_type string, day date, checksum string")
    found = anomaly.conflicting_runs(spark.createDataFrame(busy, ROWS), table, SCOPE, "day", "checksum", "outcome", "run")
    assert found.agg(F.max(F.size("certified"))).first()[0] <= 110
    rows = anomaly.joined_by_scope(table, found, SCOPE, ["day"]).select("*", anomaly.conflicts(F.col("certified"), "checksum", F.col("checksum")).alias("c")).collect()
    assert len(rows) == len(asked)
    for row in rows:
        mine = [x for x in busy if meets((row.property_id, row.report_type), x) and x[2] == DAY and is_in(x[4], anomaly.fx.CERTIFIED) and x[3] and x[3] != row.checksum]
        assert [(c.run, c.checksum) for c in row.c or []] == [(x[5], x[3]) for x in sorted(mine, key=lambda x: x[5])[:10]]


def test_baselines_are_differences_of_running_sums(spark, history, past, capsys):
    days = anomaly.baseline_days(history, SCOPE, "day", "volume", "amount", "outcome")
    rng = random.Random(2)
    asked = [(p, r, DAY - dt.timedelta(days=rng.randrange(70)), rng.choice([1, 7, 30, 0, 400]), rng.random() < 0.4, DAY - dt.timedelta(days=rng.choice([0, 10, 45, 90])))
             for p, r in [*SCOPES, ("A", "y")] for _ in range(25)]
    asked.append(("A", "x", None, 7, False, DAY))
    table = spark.createDataFrame(asked, "property_id string, report_type string, day date, span int, same boolean, oldest date")
    base = anomaly.baseline_for(table, days, SCOPE, "day", F.col("span"), F.col("same"), ("n", "s", "ss", "an", "asum", "ass"), F.col("oldest"))
    got = {tuple(r)[:6]: (r.base_n, r.base_s, r.base_ss, r.base_an, r.base_asum) for r in base.select(*SCOPE, "day", "span", "same", "oldest", *[f"base_{c}" for c in ("n", "s", "ss", "an", "asum")]).collect()}
    for a in set(asked):
        p, r, day, span, same, oldest = a
        rows = [x for x in past if x[:2] == (p, r) and x[2] and day and max(day - dt.timedelta(days=max(1, span)), oldest) <= x[2] < day
                and (not same or x[2].weekday() == day.weekday()) and (x[4] is None or is_in(x[4], anomaly.fx.BASELINE))]
        cents = [round(x[7] * 100) for x in rows if x[7] is not None and x[7] < 1e15]
        want = (len(rows), sum(x[6] for x in rows), sum(x[6] ** 2 for x in rows), len(cents), sum(cents) if cents else None) if rows else None
        assert got.get(a) == want, a
    base.explain("simple")
    plan = capsys.readouterr().out
    assert "sequence" not in plan and "Window" in plan


@pytest.fixture(scope="module")
def run(spark):
    docs = {"csv": csv(), "till": pos_contract(atomic_set=ALONE, gate_3={"numeric_columns": ["fare", "ticket"]})}
    body = b"ticket,fare\n1,2\n"
    bad = ("ticket;fare;deck\r\n" + "".join(f"t{i};free;car\r\n" for i in range(5)) + "sum;5\r\n").encode()
    names = [("dup", f"a@{QUAY}@20250314.csv", "csv", body), ("drift", f"a@{QUAY}@20250313.csv", "csv", body), ("bad", pos_name("tickets"), "till", bad), ("fine", pos_name("tickets"), "till", pos_body())]
    landed = spark.createDataFrame([(i, f"b-{i}", QUAY, k, n, None, content) for i, n, k, content in names], LANDED)
    past = [(f"run{i:02d}", QUAY, "a", DAY - dt.timedelta(days=i), "RELEASED_TO_ETL", expected_hash(body), 2, None) for i in range(14)]
    past += [(f"other{i:02d}", QUAY, None if i % 2 else "a", dt.date(2025, 3, 13), "PASS", f"{i % 4:064d}", 2, None) for i in range(30)]
    contracts_ = contracts.normalise(spark.createDataFrame(list(docs.items()), "contract_id string, doc string"), "contract_id", "doc")
    return gate.evaluate(landed, contracts_, spark.createDataFrame(past, HISTORY), F.lit(DAY))


def details(run, file_id, rule):
    g2 = run.reports.where(F.col("file_id") == file_id).select(F.inline("g2")).collect()
    return next(e.details for e in g2 if e.rule_name == rule)


def test_reports_name_matches_and_conflicts(run):
    matches = json.loads(details(run, "dup", "G2_DUPLICATE_PAYLOAD")["matches"])
    assert [m["run_id"] for m in matches] == [f"run{i:02d}" for i in range(10)]
    assert matches[0] == {"run_id": "run00", "business_date": str(DAY), "overall_outcome": "RELEASED_TO_ETL"}
    rivals = json.loads(details(run, "drift", "G2_OVERLAP_DRIFT")["conflicts"])
    assert [m["run_id"] for m in rivals] == [f"other{i:02d}" for i in range(10)]
    assert rivals[1] == {"run_id": "other01", "business_date": "2025-03-13", "prior_hash": f"{1:064d}", "overall_outcome": "PASS"}
    assert "matches" not in details(run, "fine", "G2_DUPLICATE_PAYLOAD") and "conflicts" not in details(run, "fine", "G2_OVERLAP_DRIFT")


def test_manifest_items_have_sample_records(run):
    items = {(r.file_id, r.rule_id): r for r in run.manifest().collect()}
    poison = items["bad", "G3_TYPE_CAST_FAIL"]  # each row offends twice and counts once
    assert poison.affected_rows == 5
    assert [(s.row_no, s.record) for s in poison.samples] == [(i, f"t{i};free;car") for i in range(3)]
    assert all(r.samples == [] for k, r in items.items() if k[0] != "bad")
