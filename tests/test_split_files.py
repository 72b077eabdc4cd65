"""Files in one row and files read in many splits get the same reports."""

import datetime as dt
import hashlib
import json
import random

import pytest
from fixtures import QUAY, pos_contract, pos_name
from pyspark.sql import functions as F
from test_gate import ALONE, CONTRACTS, CSV, DAY, FILES, HISTORY, KEY, LANDED, history_rows

from quaycheck.operators import contracts
from quaycheck.plans import gate
from quaycheck.sources import landing

N = 30_000
BIG = {
    "pos-big": pos_contract(atomic_set=ALONE, gate_3={"required_columns": ["ticket"], "numeric_columns": ["fare"], "non_null_columns": ["deck"]}),
    "plain-big": json.dumps({**CSV, "gate_3": {"numeric_columns": ["fare"], "numeric_ranges": [{"column": "fare", "min_value": 0, "max_value": 90}]},
                             "gate_4": {"max_variance": 0.01}}),
    "sig": json.dumps({**CSV, "file_format": {"encoding": "utf-8-sig", "delimiter": ","}}),
    "cp": json.dumps({**CSV, "file_format": {"encoding": "cp1252", "delimiter": ","}}),
}
NAME = f"tickets@{QUAY}@20250314.csv"


def big_bodies():
    rng = random.Random(5)
    fares = [f"{rng.randrange(9000) / 100:.2f}" for _ in range(N)]
    rows = [f"{700 + i};{'n/a' if i in (0, 17, N // 2, N - 1) else f};{'' if i % 9_973 == 5 else 'car'}" for i, f in enumerate(fares)]
    marked = "\r\n".join(["ticket;fare;deck", *rows, f"sum;{N}", "-- close"]) + "\r\n"
    late = "\n".join([*(f"~ remark {i} before the header" for i in range(9_000)), "ticket;fare;deck", *rows[:9_000], "sum;1"])
    plain = "".join(f"{x}\n" for x in ["ticket,fare,header_total,line_item_amount", *(f"{i},{f},{'' if i else sum_of(fares)},{f}" for i, f in enumerate(fares))])
    plain = plain.replace(f"\n{N // 3},", f"\n{N // 3},4000") + "x,-1,,"
    return [
        ("big", "pos-big", pos_name("tickets"), marked.encode()),
        ("bigcount", "pos-big", pos_name("tickets"), marked.replace(f"sum;{N}", f"sum;{N + 1}").encode()),
        ("late", "pos-big", pos_name("tickets"), late.encode()),
        ("plain", "plain-big", NAME, plain.encode()),
        ("crs", "plain-big", NAME, plain.replace("\n", "\r").encode()),
        ("latebyte", "plain-big", NAME, plain.encode() + b"\xff\n"),
        ("broken", "plain-big", NAME, "ticket,fare\n".encode() + "Bjørn,1\n".encode() * 20_000 + b"a\xc3"),
        ("bom", "plain-big", NAME, b"\xef\xbb\xbf" + plain.encode()),
        ("bomsig", "sig", NAME, b"\xef\xbb\xbfticket,fare\n1,2\n"),
        ("onlybom", "plain-big", NAME, b"\xef\xbb\xbf"),
        ("cp", "cp", NAME, "ticket,fare\nBjørn – 1,2\n".encode("cp1252")),
        ("blank", "plain-big", NAME, b"\n\n\n"),
        ("noend", "plain-big", NAME, b"ticket,fare"),
    ]


def sum_of(fares):
    return f"{sum(round(float(f) * 100) for f in fares) / 100:.2f}"


SPLIT = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing zone+1")
    files = [*FILES, *((i, f"batch-{i}", c, n, None, body) for i, c, n, body in big_bodies())]
    rows = []
    for i, b, c, n, p, body in files:
        file = folder / i / "payload of it.bin"
        file.parent.mkdir()
        file.write_bytes(body)
        rows.append((i, b, QUAY, c, n, p, body, f"file://{file}"))
    landed = spark.createDataFrame(rows, LANDED + ", uri string")
    docs = contracts.normalise(spark.createDataFrame([*CONTRACTS.items(), *BIG.items()], "contract_id string, doc string"), "contract_id", "doc")
    history = spark.createDataFrame(history_rows(), HISTORY)
    inventory = spark.createDataFrame([(KEY + "_SUCCESS",), (f"zone/{QUAY}/berths/_delta_log/0.json",)], "object_key string")
    as_of = F.lit(DAY + dt.timedelta(days=3))
    whole = gate.evaluate(landed.drop("uri"), docs, history, as_of, inventory=inventory)
    before = {k: spark.conf.get(k) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    read = landing.read_splits(spark, str(folder))
    tasks = read.rdd.getNumPartitions()
    splits = {r.uri: r.n for r in read.groupBy("uri").agg(F.count_distinct("split_at").alias("n")).collect()}
    facts = landing.payload_facts(landed.drop("content"), chunk=1 << 16)
    split = gate.evaluate_split(facts, read, docs, history, as_of, inventory=inventory)
    out = {name: ({r["file_id"]: r for r in run.reports.collect()}, sorted(map(str, run.violations.collect())), run.manifest()) for name, run in (("whole", whole), ("split", split))}
    items = {name: sorted(map(str, o[2].collect())) for name, o in out.items()}
    for k, v in before.items():
        spark.conf.set(k, v)
    return out, items, tasks, {u.rsplit("/", 2)[1]: n for u, n in splits.items()}, {i: body for i, *_, body in files}


def test_files_were_split(both):
    _, _, tasks, splits, _ = both
    assert tasks > 40
    assert all(splits[i] >= 7 for i in ("big", "late", "plain", "crs", "bom"))


def test_reports_are_equal(both):
    out = both[0]
    whole, split = out["whole"][0], out["split"][0]
    assert whole.keys() == split.keys()
    for i, r in whole.items():
        assert r.asDict(True) == split[i].asDict(True), i


def test_violations_and_manifests_are_equal(both):
    out, items, *_ = both
    assert out["whole"][1] == out["split"][1] and len(out["whole"][1]) > 8
    assert items["whole"] == items["split"]


def test_large_files_are_judged_rightly(both):
    reports = both[0]["split"][0]
    big = reports["big"]
    assert (big["total_read_rows"], big["accepted_rows"], big["g1_outcome"], big["g3_outcome"]) == (N + 3, N, "PASS", "QUARANTINE_FILE")
    assert reports["bigcount"]["g1_outcome"] == "QUARANTINE_FILE"
    assert reports["plain"]["g4_outcome"] == "PASS"  # header total of row 0 against lines of all splits
    rows = sorted(int(v.split("row_no=")[1].split(",")[0]) for v in both[0]["split"][1] if "file_id='big'" in v and "numeric_column" in v)
    assert rows == [0, 17, N // 2, N - 1]
    assert reports["latebyte"]["g1_outcome"] == "REJECT_FILE" and reports["broken"]["g1_outcome"] == "REJECT_FILE"


def test_payload_facts(both, spark, tmp_path):
    bodies = both[4]
    (tmp_path / "x").write_bytes(b"\xc3")
    for name, body in {**bodies, "x": b"\xc3"}.items():
        (tmp_path / name).write_bytes(body)
    names = [*bodies, "x", "absent"]
    asked = spark.createDataFrame([(n, f"file://{tmp_path}/{n}") for n in names], "name string, uri string")
    got = {r.name: r for r in landing.payload_facts(asked, chunk=7_001).collect()}
    assert got["absent"].length is None and got["absent"].checksum is None
    for name, body in {**bodies, "x": b"\xc3"}.items():
        r = got[name]
        assert (r.length, r.checksum) == (len(body), hashlib.sha256(body).hexdigest())
        for codec, column in (("utf-8", "bad_utf8"), ("ascii", "bad_ascii"), ("cp1252", "bad_cp1252")):
            try:
                body.decode(codec)
                assert r[column] is None
            except UnicodeDecodeError as e:
                assert (r[column], r[column + "_byte"]) == (e.start, f"{body[e.start]:02x}")
    assert got["jsonlok"].first_line == '{"deck": 2, "seen_at": "06:10"}'
