"""Whitened leading components of integer vectors.

Components become integers floor(scale * c). Each distinct vector counts once: equal ones fall together as short byte
strings, in a hash aggregation that combines before it shuffles. Two passes give the count, the sums and, centred on the
rounded mean, the products of all dimensions, all exact; each task sends one row per dimension, and dimensions x
dimensions numbers come to the driver. There `contour` finds the leading eigenpairs of the covariance, and a pass over
all vectors projects them. The covariance of the whitened vectors is measured over the distinct ones.

Left out: vectors that are null or empty, hold null or non-finite entries, or have another length than most (of equally
frequent lengths the longest counts). Components whose variance cannot be told from zero have no rows: one distinct vector
has none at all. Repeated rows and null ids are kept; an empty table gives no rows; other columns are left out.
Integers of 2^53 and more fail the job. `deviation` is null where it does not fit in a long, `deviation_wide` has it.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaycheck.llm import contour
from quaycheck.llm.common import staged
from quaycheck.llm.embedding_rows import vectors

#: Sums of integers below it are exact in double precision.
EXACT = 1 << 53
#: Vectors multiplied at once.
BLOCK = 8192


def usable(embeddings: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the vectors that take part, and their number of dimensions."""
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    most = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return rows.where(F.size("v") == (most.dims if most else 0)), most.dims if most else 0


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(v * scale)
    if len(x) and np.abs(x).max() >= EXACT:
        raise ValueError("a component is too large for exact sums")
    return x.astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """A byte string per row, equal for equal rows: the width of its integers, then the integers."""
    top = np.abs(x).max(1)
    width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
    out: list = [b""] * len(x)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw = x[at].astype(f"<i{w}").tobytes()
        step = w * x.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = bytes([w]) + raw[k * step : (k + 1) * step]
    return out


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    widths = np.array([r[0] for r in rows])
    out = np.zeros((len(rows), dims), np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join([rows[i][1:] for i in at.tolist()]), f"<i{w}").reshape(-1, dims)
    return out


def distinct_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """Each distinct integer vector once, packed."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(integers(vectors(batch.column(0)), scale)), pa.binary())], ["x"])

    return staged(rows.select("v").mapInArrow(run, "x binary").distinct(), "distinct")


def parts(batches, dims: int):
    """Packed rows as blocks of integers."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            yield unpacked(batch.column(0).slice(lo, BLOCK).to_pylist(), dims)


def added_up(rows: DataFrame, name: str) -> list:
    """Sums of decimal texts by (i, j)."""
    each = rows.select("i", F.posexplode("values").alias("j", "value"))
    return each.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias(name)).collect()


def moments(held: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and sum of each dimension."""

    def run(batches):
        n, total = 0, [0] * dims
        for x in parts(batches, dims):
            n += len(x)
            total = [a + b for a, b in zip(total, exact_sum(x), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([[str(n), *map(str, total)]], pa.list_(pa.string()))], ["i", "values"])

    found = {r.j: int(r.total) for r in added_up(held.mapInArrow(run, "i int, values array<string>"), "total")}
    return found.get(0, 0), [found.get(d + 1, 0) for d in range(dims)]


def exact_sum(x: np.ndarray) -> list[int]:
    """Column sums; high and low halves apart, so that neither overflows."""
    high, low = x >> 26, x & ((1 << 26) - 1)
    return [(int(a) << 26) + int(b) for a, b in zip(high.sum(0), low.sum(0), strict=True)]


def products(y: np.ndarray) -> np.ndarray:
    """Exact y^T y as Python integers. In double precision while no sum passes 2^53, else half by half."""
    top = int(np.abs(y).max(initial=0))
    if top * top * max(1, len(y)) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    if len(y) > 1 and top < 1 << 26:
        half = len(y) // 2
        return products(y[:half]) + products(y[half:])
    z = y.astype(object)
    return z.T @ z


def covariance(held: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the distinct vectors, each entry rounded once."""
    middle = [round(Fraction(s, n)) for s in sums]

    def run(batches):
        total = np.zeros((dims, dims), object)
        for x in parts(batches, dims):
            total = total + products(x - np.array(middle, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([list(map(str, row)) for row in total], pa.list_(pa.string()))], ["i", "values"])

    v, rest = np.zeros((dims, dims)), [s - n * m for s, m in zip(sums, middle, strict=True)]
    for r in added_up(held.mapInArrow(run, "i int, values array<string>"), "total"):
        v[r.i, r.j] = (int(r.total) * n - rest[r.i] * rest[r.j]) / (n * n)  # integers divide correctly rounded
    return v


class Projection:
    """What a task needs to whiten vectors: as many numbers as dimensions times components."""

    def __init__(self, n: int, sums: list[int], e: np.ndarray, u: np.ndarray):
        self.n, self.sums, self.weights = n, sums, u / np.sqrt(e)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as long integers where they fit."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums)) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(np.float64) @ self.weights

    def deviations(self, x: np.ndarray) -> list[int]:
        y = self.centred(x)
        top = int(np.abs(y).max(initial=0))
        if top * top * x.shape[1] < 1 << 62:
            return np.square(y).sum(1).tolist()
        if top < 1 << 52 and x.shape[1] <= 1 << 9:
            high, low = y >> 26, y & ((1 << 26) - 1)
            terms = (np.square(high).sum(1).tolist(), (high * low).sum(1).tolist(), np.square(low).sum(1).tolist())
            return [(a << 52) + (b << 27) + c for a, b, c in zip(*terms, strict=True)]
        return [sum(int(a) ** 2 for a in row) for row in y]


def identity_error(held: DataFrame, dims: int, projection: Projection) -> float:
    """Largest entry of the whitened distinct vectors' covariance minus the identity."""
    k = projection.weights.shape[1]

    def run(batches):
        total = np.zeros((k, k))
        for x in parts(batches, dims):
            w = projection.whitened(x)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "values"])

    each = held.mapInArrow(run, "i int, values array<double>").select("i", F.posexplode("values").alias("j", "value"))
    found = each.groupBy("i", "j").agg(F.sum("value").alias("total")).collect()
    # whitened vectors are centred before they are multiplied, so their own mean is zero
    return max(abs(r.total / projection.n - (r.i == r.j)) for r in found)


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_wide) of every vector that takes part and component."""
    rows, dims = usable(embeddings, id_col, vector)
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
    none = embeddings.sparkSession.createDataFrame([], schema)
    if not dims:
        return none
    held = distinct_vectors(rows, scale)
    n, sums = moments(held, dims)
    v = covariance(held, dims, n, sums)
    e, u = contour.largest(v, components)
    if not len(e):
        return none
    projection = Projection(n, sums, e, u)
    error, share = identity_error(held, dims, projection), e / np.trace(v)
    k = len(e)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = integers(vectors(part.column(1)), scale)
                far = projection.deviations(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([d if d < 1 << 63 else None for d in far], pa.int64()),
                    pa.array([str(d) for d in far], pa.string()), pa.array(list(projection.whitened(x)), pa.list_(pa.float64())),
                ], ["id", "deviation", "wide", "values"])

    out = rows.select("id", "v").mapInArrow(run, "id long, deviation long, wide string, values array<double>")
    each = out.select("id", "deviation", "wide", F.posexplode("values").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(s)) for s in share[:k]]), F.col("at") + 1)
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(float(error)).alias("identity_error"), F.col("wide").cast("decimal(38,0)").alias("deviation_wide"),
    )
