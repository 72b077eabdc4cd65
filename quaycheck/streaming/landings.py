"""The gate on landings as they arrive: micro-batches, held sets, duplicate payloads, deadlines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quaycheck.session import staged
from quaycheck.sources import control

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def landed_files(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """New files of a landing folder as a stream of payloads."""
    return (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_batch)).load(folder)
    )


def evaluate_stream(landings: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
                    once: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Scores each micro-batch with a batch plan and appends its reports.

    A batch that is replayed after a failure finds its run ids stored already and adds nothing.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        reports = score(batch)
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            reports = control.new_runs_only(reports, spark.read.schema(reports.schema).parquet(target))
        else:
            reports = reports.dropDuplicates(["run_id"])
        control.append_runs(reports, target)

    writer = landings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


SET_KEY = ["batch_id", "contract_id", "property", "date"]


def evaluate_sets_stream(landings: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], target: str, waiting: str, checkpoint: str,
                         patience_days: int = 7, arrived: str = "arrived", once: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Scores micro-batches of files whose sets may complete later, in any batch and on any day.

    landings: the columns `gate.evaluate` reads, and when a file came. score(files, siblings) gives reports.

    Files reported HOLD_SET wait in a table, one version per micro-batch, so that a replayed batch starts from what its
    first attempt started from. A later batch scores its own files with the names of all that wait, then scores again those
    waiting files whose set a new file belongs to; a file's second report differs in its outcome and is appended
    beside the first. Files of sets that stay incomplete are forgotten `patience_days` after they came, which bounds the
    table; files without a time came with the last of their batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(waiting).getFileSystem(spark._jsc.hadoopConfiguration())
        there = lambda path: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
        last = F.coalesce(F.lit(batch.agg(F.max(arrived)).first()[0]).cast("timestamp"), F.current_timestamp())
        new = batch.withColumn(arrived, F.coalesce(F.col(arrived), last))
        schema = ", ".join(f"`{n}` {t}" for n, t in new.dtypes) + ", property string, date string"
        before = f"{waiting}/version={number - 1}"
        held = spark.read.schema(schema).parquet(before) if there(before) else spark.createDataFrame([], schema)
        names = ["batch_id", "contract_id", "filename"]
        siblings = held.select(*names).unionByName(new.select(*names)).distinct()

        first = staged(score(new, siblings), "stream-reports")
        key = [F.element_at("tokens", t).alias(t) for t in ("property", "date")]
        keyed = first.select("file_id", "overall_outcome", *key)
        mine = new.join(keyed, "file_id")
        touched = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in SET_KEY]
        keys = mine.select(*[F.col(k).alias(f"_{k}") for k in SET_KEY]).distinct()
        again = staged(held.join(keys, touched, "left_semi"), "stream-again")
        second = staged(score(again.drop("property", "date"), siblings), "stream-second") if again.limit(1).count() else first.limit(0)
        reports = first.unionByName(second)
        if there(target):
            reports = control.new_runs_only(reports, spark.read.schema(reports.schema).parquet(target), ["run_id", "overall_outcome"])
        else:
            reports = reports.dropDuplicates(["run_id", "overall_outcome"])
        control.append_runs(reports, target)

        released = second.where("overall_outcome <> 'HOLD_SET'").select("file_id")
        wait = held.join(released, "file_id", "left_anti").unionByName(mine.where("overall_outcome = 'HOLD_SET'").drop("overall_outcome"))
        wait.where(F.col(arrived) >= last - F.make_dt_interval(F.lit(patience_days))).write.mode("overwrite").parquet(f"{waiting}/version={number}")

    writer = landings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def distinct_payloads(landings: DataFrame, checksum: str, arrived: str, delay: str) -> DataFrame:
    """Landings without those whose payload already came in within the delay; older ones are found in history."""
    return landings.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([checksum])


def set_progress(landings: DataFrame, keys: list[str], member: str, arrived: str, delay: str, members: Column) -> DataFrame:
    """Members present per set so far, updated as files arrive (update mode).

    Windows of two days start every day, so members less than a day apart share one whatever the hour; a set has passed
    once one of its windows has. State per window is the set of wanted members, bounded by the contract; windows
    older than the watermark leave the state.
    """
    seen = landings.withWatermark(arrived, delay).where(F.array_contains(members, F.col(member)))
    per_set = seen.groupBy(F.window(arrived, "2 days", "1 day").alias("day"), *keys).agg(F.collect_set(member).alias("present"))
    return per_set.withColumn("missing", F.array_except(members, "present")).withColumn(
        "verdict", F.when(F.size("missing") > 0, "HOLD").otherwise("PASS"))


RELEASE = "set_key string, verdict string, members string"


def released_sets(landings: DataFrame, key: str, member: str, members: list[str], arrived: str, delay: str,
                  patience_ms: int) -> DataFrame:
    """One row per set: PASS when its last member arrives, EXPIRED when patience runs out first.

    The state of a set is one flag per wanted member plus a timer; it is cleared with the row, so
    neither repeated files nor sets that never complete make it grow.
    """
    wanted = sorted(members)

    class Hold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.present = handle.getMapState("present", "member string", "seen boolean")
            self.done = handle.getValueState("done", "done boolean")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            latest = timerValues.getCurrentWatermarkInMs()
            fresh = not list(self.handle.listTimers())
            for batch in rows:
                last = batch[arrived].max()  # files without a time take part, but move no clock
                if not pd.isna(last):
                    latest = max(latest, int(last.timestamp() * 1000))
                for m in set(batch[member]):
                    if m in wanted:
                        self.present.updateValue((m,), (True,))
            if fresh:  # from the files' own time, also for a set complete at once, so that its state ends
                self.handle.registerTimer(latest + patience_ms)
            have = sorted(k[0] for k in self.present.keys())
            if have == wanted and not self.done.exists():
                self.done.update((True,))
                yield pd.DataFrame({"set_key": [key[0]], "verdict": ["PASS"], "members": [",".join(have)]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            have = sorted(k[0] for k in self.present.keys())
            was_done = self.done.exists()
            self.present.clear()
            self.done.clear()
            if not was_done:
                yield pd.DataFrame({"set_key": [key[0]], "verdict": ["EXPIRED"], "members": [",".join(have)]})

        def close(self) -> None:
            pass

    return landings.withWatermark(arrived, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Hold(), outputStructType=RELEASE, outputMode="Append", timeMode="EventTime")


def sla_ticks(spark: SparkSession, check: Callable[[], DataFrame], target: str, checkpoint: str, every: str = "15 minutes",
              once: bool = False) -> StreamingQuery:
    """Runs the delivery check on a schedule; each tick reads the run history anew, so late files count.

    `check` returns run rows of missing deliveries, as `sla.missing_delivery_runs` makes them.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(_batch: DataFrame, _batch_id: int) -> None:
        events = check().where(F.col("overall_outcome") == "MISSING_DELIVERY")
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            events = control.new_runs_only(events, spark.read.schema(events.schema).parquet(target))
        else:
            events = events.dropDuplicates(["run_id"])
        events.write.mode("append").parquet(target)

    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
