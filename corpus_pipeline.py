"""The corpus pipeline: documents judged, identified, deduplicated and packed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a table that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, unchanged.

Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns are handled as
the operators state. Texts without letters leave at the language stage. Where ids are null or repeated, the
deduplication stage numbers the rows itself, so that exactly one row of each group stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaycheck.llm import language_id, minhash_dedup, packing, quality_classifier
from quaycheck.llm.common import staged, table
from quaycheck.llm.queries import tokenizer_json
from quaycheck.session import ship_package


def kept(docs: DataFrame, results: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stage keeps, with their own columns: those named like its results are set aside while it works."""
    aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c in results}
    out = stage(docs.withColumnsRenamed(aside)).where("kept")
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality."""
    return kept(docs, quality_classifier.RESULTS, lambda own: quality_classifier.classify(own, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told."""
    return kept(docs, language_id.RESULTS, lambda own: language_id.identify(own, declared=F.col("lang"), host=F.col("source")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    ids = docs.groupBy("doc_id").count().agg(F.max("count"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    key, own = "doc_id", docs
    if (ids[0] or 0) > 1 or ids[1]:
        key = next(f"__row{i}" for i in range(len(docs.columns) + 1) if f"__row{i}" not in docs.columns)
        own = staged(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    gone = staged(minhash_dedup.near_duplicates(own.select(key, "text"), id_col=key).where("NOT kept").select(key), "gone")
    return own.join(gone, key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents in sequences of at most 2,048 tokens."""
    return packing.pack(docs, tokenizer_json("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shipped(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(ship_package(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", shipped(quality)),
    ("language_id", shipped(language)),
    ("minhash_dedup", shipped(near_duplicates)),
    ("packing", shipped(pack)),
]

#: SQL cannot express the trained stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
