"""Session settings shared by tests, the benchmark and local runs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "quaycheck") -> SparkSession:
    """A local session. On a cluster, use the session that already exists."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # a stack capture per Column call makes building large plans several times slower
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return with_settings(spark)


def with_settings(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan relies on: UTC clock and adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Gives this package's source to the executors, once per context, so that tasks can import it anywhere."""
    # texts are long: batches of a few MB, held by the JVM and by Python on the way in and out
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    context = spark.sparkContext
    if not getattr(context, "_quaycheck_shipped", False):
        home = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="package-")) / "quaycheck-source.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(home.rglob("*.py")):
                out.write(file, Path(home.name) / file.relative_to(home))
        context.addPyFile(str(target))
        context._quaycheck_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read and write, named by the cluster in spark.checkpoint.dir.

    Only where the session names none (tests, a laptop) is a fresh local folder used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a step's result to the shared folder and reads it back.

    Cuts the lineage in a way that survives lost executors, keeps later plans small, and gives the
    optimiser a table with known size and prunable columns.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
