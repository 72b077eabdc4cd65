"""Small helpers of the training-data operators: table access, staging, hash buckets and bounded broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaycheck.session import shared_folder, staged  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_tasks(df: DataFrame) -> int:
    """Partitions of a table's scan: grows with its bytes, so buckets made in proportion stay of one size."""
    return max(1, df.rdd.getNumPartitions())


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function that handles each batch on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return run


def bucket_edges(n: int) -> np.ndarray:
    """First 64-bit hash of each of n equal ranges."""
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first, dtype=counts.dtype)


def small(a: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold them; the first byte is the width."""
    top = int(a.max()) if len(a) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + a.astype(kind).tobytes()


def unsmall(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def planes(a: np.ndarray) -> bytes:
    """64-bit numbers as their first bytes, their second bytes and so on: what is alike compresses."""
    return np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About `rows` rows, at most a quarter more, chosen by a hash of the key whatever the table's order; all rows of a smaller table."""
    n = df.count()
    if n <= rows:
        return df
    share = int(1.1 * rows / n * 2**62)
    return df.where(F.shiftrightunsigned(F.xxhash64(*key), 2) < share).limit(rows * 5 // 4)
