"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers floor(scale * x). Vectors are staged once as blocks of bounded size: for each dimension the
integers that occur in the block, in order, and for each vector the places of its own integers among them. In each
round a block tabulates the squared difference of every occurring integer to every centroid, dimension by dimension;
distances are then gathers from these tables and sums, all in integers.

Each task sums its vectors per cluster; only (cluster, dimension, sum, count) is shuffled, and clusters x dimensions
numbers come to the driver, whatever the table's size. A round that changes no centroid is followed by equal ones, so the
remaining ones are not run.

Left out: vectors that are null, have another number of components than asked for, or null or non-finite ones. Repeated
rows are vectors of their own. Starting vectors are the first by hash of the id; equal ids come in the order of their
vectors, null ids last. With fewer vectors than clusters there are fewer clusters; an empty table gives no rows. Other
columns are left out. Integers beyond 2^27 fail the job, as distances might not fit in a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.llm.common import small, staged, unsmall
from quaycheck.llm.embedding_rows import vectors

#: Vectors of a block.
BLOCK = 8192
LARGEST = 1 << 27


def kept(embeddings: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def blocks(rows: DataFrame, scale: int) -> DataFrame:
    """Blocks as (ids array<long>, codes binary, sizes binary, occurring binary)."""

    def pack(ids: list, x: np.ndarray) -> dict:
        occurring, codes = [], []
        for column in x.T:
            u, back = np.unique(column, return_inverse=True)
            occurring.append(u)
            codes.append(back)
        sizes = np.array([len(u) for u in occurring], np.int64)
        return {"ids": ids, "codes": small(np.concatenate(codes)), "sizes": small(sizes), "occurring": np.concatenate(occurring).astype("<i8").tobytes()}

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = np.floor(vectors(part.column(1)) * scale)
                if np.abs(x).max() > LARGEST:
                    raise ValueError("a component is too large for squared distances in a long")
                one = pack(part.column(0).to_pylist(), x.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([one["ids"]], pa.list_(pa.int64())), *[pa.array([one[k]], pa.binary()) for k in ("codes", "sizes", "occurring")]], list(one))

    return rows.select("id", "v").mapInArrow(run, "ids array<long>, codes binary, sizes binary, occurring binary")


class Block:
    """Codes of a block's vectors, a row per dimension, and the integers they stand for."""

    def __init__(self, row: dict):
        sizes = unsmall(row["sizes"])
        self.ids = row["ids"]
        self.codes = unsmall(row["codes"]).reshape(len(sizes), -1)
        cuts = np.cumsum(sizes)[:-1]
        self.occurring = np.split(np.frombuffer(row["occurring"], "<i8"), cuts)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every vector to every centroid: a table per dimension, a gather from it, a sum."""
        out = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for codes, integers, centre in zip(self.codes, self.occurring, centroids.T, strict=True):
            table = np.square(integers[:, None] - centre[None, :])
            out += table[codes]
        return out

    def vectors(self) -> np.ndarray:
        return np.stack([integers[codes] for codes, integers in zip(self.codes, self.occurring, strict=True)], 1)


def rows_of(batch: pa.RecordBatch):
    for row in batch.to_pylist():
        yield Block(row)


def first_vectors(rows: DataFrame, clusters: int, seed: str, scale: int) -> np.ndarray:
    """Integer vectors of the smallest hashes of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = rows.select(key.alias("key"), "id", "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    return np.floor(np.array([r.v for r in first], np.float64) * scale).astype(np.int64)


def sums(held: DataFrame, centroids: np.ndarray) -> list:
    """Per cluster and dimension the exact sum, and the count, of the vectors nearest to its centroid."""

    def run(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for block in rows_of(batch):
                near = block.distances(centroids).argmin(1)  # the first of equal ones
                x = block.vectors()
                for k in np.unique(near):
                    mine = x[near == k]
                    count[k] += len(mine)
                    total[k] += mine.sum(0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "totals"])

    part = held.mapInArrow(run, "cluster int, n long, totals array<long>")
    each = part.select("cluster", "n", F.posexplode("totals").alias("dim", "total"))
    return each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def refined(held: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after the rounds."""
    for _ in range(rounds):
        new = centroids.copy()
        for r in sums(held, centroids):
            new[r.cluster, r.dim] = int(r.total) // r.n
        if (new == centroids).all():
            break
        centroids = new
    return centroids


def assigned(held: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block in rows_of(batch):
                far = block.distances(centroids)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near], pa.int64())], [id_col, "cluster", "distance"])

    return held.mapInArrow(run, f"{id_col} long, cluster int, distance long")


def cluster(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of every vector that takes part."""
    rows = kept(embeddings, id_col, vector, dims)
    start = first_vectors(rows, clusters, seed, scale)
    extra = "cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not len(start):
        return rows.where("false").select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *[F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for c in extra.split(", "))])
    held = staged(blocks(rows, scale), "blocks")
    centroids = refined(held, start, rounds)
    out = staged(assigned(held, centroids, id_col), "assigned")
    inertia = {r.cluster: int(r.inertia) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def each(values: list, kind: str) -> Column:
        """The value of a row's cluster; as many literals as clusters."""
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    return out.select(
        id_col, "cluster", "distance", each([inertia.get(k, 0) for k in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        each(digest, "string").alias("centroid_sha256"), F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in c]) for c in centroids.tolist()]), F.col("cluster") + 1).alias("centroid"),
    )
