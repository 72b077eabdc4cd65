"""Streams give what the batch plan gives."""

import datetime as dt
import json
import os

import pytest
from fixtures import QUAY, SET, pos_body, pos_contract, pos_name
from pyspark.sql import functions as F

from quaycheck.functions.common import strings
from quaycheck.operators import contracts, sets
from quaycheck.plans import gate
from quaycheck.streaming import landings

ROWS = [("2026-08-09T10:00:00", "A", "m1", "h1"), ("2026-08-09T10:05:00", "A", "m2", "h2"), ("2026-08-09T10:06:00", "B", "m1", "h1"),
        ("2026-08-09T10:07:00", "A", "m2", "h3"), ("2026-08-09T10:08:00", "C", "zz", "h4"), ("2026-08-09T10:09:00", "C", "m2", "h5")]
SCHEMA = "arrived timestamp, prop string, member string, checksum string"


@pytest.fixture()
def source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(0, len(ROWS), 2):
        lines = [json.dumps(dict(zip(("arrived", "prop", "member", "checksum"), r))) for r in ROWS[i : i + 2]]
        (folder / f"{i}.json").write_text("\n".join(lines))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").json(str(folder))


def run(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name)


def test_set_progress_equals_batch(spark, source, tmp_path):
    members = strings(["m1", "m2"])
    out = run(landings.set_progress(source, ["prop"], "member", "arrived", "1 hour", members), "update", "progress", tmp_path)
    last = {r.prop: sorted(r.present) for r in out.collect()}
    batch = spark.createDataFrame([(dt.datetime.fromisoformat(a), p, m, h) for a, p, m, h in ROWS], SCHEMA)
    want = {r.prop: sorted(r.present) for r in sets.atomic_set(batch, ["prop"], "member", members).collect()}
    assert last == want
    assert {r.prop for r in out.where("verdict = 'PASS'").collect()} == {"A"}


def test_duplicate_payloads_drop(source, tmp_path):
    out = run(landings.distinct_payloads(source, "checksum", "arrived", "1 hour"), "append", "distinct_payloads", tmp_path)
    assert sorted(r.checksum for r in out.collect()) == ["h1", "h2", "h3", "h4", "h5"]


def test_sets_release_once(spark, source, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = run(landings.released_sets(source, "prop", "member", ["m1", "m2"], "arrived", "1 minute", 3_600_000), "append", "released", tmp_path)
        rows = [(r.set_key, r.verdict, r.members) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert [r for r in rows if r[1] == "PASS"] == [("A", "PASS", "m1,m2")]


def test_evaluated_stream_appends_once(spark, tmp_path):
    folder, target = tmp_path / "land", str(tmp_path / "runs")
    folder.mkdir()
    for kind in SET:
        (folder / pos_name(kind)).write_bytes(pos_body())
    docs = contracts.normalise(spark.createDataFrame([("pos", pos_contract())], "contract_id string, doc string"), "contract_id", "doc")
    history = spark.createDataFrame([], "property_id string, report_type string, business_date date, overall_outcome string, checksum_sha256 string, row_count bigint, net_amount double")

    def score(batch):
        landed = batch.select(
            F.col("path").alias("file_id"), F.lit("b").alias("batch_id"), F.lit(QUAY).alias("property_id"), F.lit("pos").alias("contract_id"),
            F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("path"), "content")
        return gate.stored_form(gate.evaluate(landed, docs, history, F.lit(dt.date(2025, 3, 17))).reports)

    stream = landings.landed_files(spark, str(folder))
    landings.evaluate_stream(stream, score, target, str(tmp_path / "c1"), once=True).awaitTermination(240)
    first = {r.report_type: r.overall_outcome for r in spark.read.parquet(target).collect()}
    assert first == dict.fromkeys(SET, "PASS")
    # a second run without its checkpoint replays the files and adds nothing
    landings.evaluate_stream(stream, score, target, str(tmp_path / "c2"), once=True).awaitTermination(240)
    assert spark.read.parquet(target).count() == 3


def test_sets_that_complete_in_later_batches_equal_the_batch_plan(spark, tmp_path):
    """Members of a set come in three micro-batches, before and after midnight, one of them late; another set never completes."""
    day = lambda s: f"2025-03-{s}"
    pieces = [  # file, batch, kind, business day, arrived
        [("t", "b", "tickets", "20250314", day("14T23:58:00")), ("x", "b", "tickets", "20250315", day("14T23:58:30")), ("solo", "c", "refunds", "20250314", day("14T23:59:00"))],
        [("r", "b", "refunds", "20250314", day("15T00:01:00")), ("y", "b", "boardings", "20250315", None)],
        [("b", "b", "boardings", "20250314", day("14T22:00:00"))],
    ]
    schema = "file_id string, batch_id string, property_id string, contract_id string, filename string, path string, content binary, arrived timestamp"
    folder = tmp_path / "in"
    rows = [[(f, b, QUAY, "pos", pos_name(kind, d), None, pos_body(2 + i), dt.datetime.fromisoformat(at) if at else None) for i, (f, b, kind, d, at) in enumerate(p)] for p in pieces]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / f"p{i}"))
        for f in (folder / f"p{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    docs = contracts.normalise(spark.createDataFrame([("pos", pos_contract())], "contract_id string, doc string"), "contract_id", "doc")
    history = spark.createDataFrame([], "run_id string, property_id string, report_type string, business_date date, overall_outcome string, checksum_sha256 string, row_count bigint, net_amount double")
    as_of = F.lit(dt.date(2025, 3, 16))
    score = lambda files, siblings: gate.evaluate(files.drop("arrived"), docs, history, as_of, siblings=siblings).reports
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(folder))
    target, waiting = str(tmp_path / "runs"), str(tmp_path / "waiting")
    q = landings.evaluate_sets_stream(stream, score, target, waiting, str(tmp_path / "ck"), once=True)
    q.awaitTermination(600)
    out = spark.read.parquet(target).select("file_id", "overall_outcome").collect()
    said = {f: sorted(r.overall_outcome for r in out if r.file_id == f) for f in {r.file_id for r in out}}
    whole = gate.evaluate(spark.createDataFrame([r for p in rows for r in p], schema).drop("arrived"), docs, history, as_of).reports
    final = {r.file_id: r.overall_outcome for r in whole.select("file_id", "overall_outcome").collect()}
    assert final == {"t": "PASS", "r": "PASS", "b": "PASS", "x": "HOLD_SET", "y": "HOLD_SET", "solo": "HOLD_SET"}
    assert said == {"t": ["HOLD_SET", "PASS"], "r": ["HOLD_SET", "PASS"], "b": ["PASS"], "x": ["HOLD_SET"], "y": ["HOLD_SET"], "solo": ["HOLD_SET"]}
    assert {r.file_id for r in spark.read.parquet(f"{waiting}/version=2").collect()} == {"x", "y", "solo"}


def test_undated_and_repeated_runs_are_stored_once(spark):
    from quaycheck.sources import control

    schema = "run_id string, overall_outcome string, business_date date"
    day = dt.date(2025, 3, 14)
    stored = spark.createDataFrame([("a", "PASS", day), ("b", "FLAG", None)], schema)
    reports = spark.createDataFrame([("a", "PASS", day), ("b", "FLAG", None), ("b", "FLAG", None), ("c", "PASS", None), ("c", "PASS", None), ("a", "HOLD_SET", day)], schema)
    assert {r.run_id for r in control.new_runs_only(reports, stored).collect()} == {"c"}
    assert sorted((r.run_id, r.overall_outcome) for r in control.new_runs_only(reports, stored, ["run_id", "overall_outcome"]).collect()) == [("a", "HOLD_SET"), ("c", "PASS")]
