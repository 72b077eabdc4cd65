"""Quality rules: an isolation forest over rule statistics, its threshold set from labelled rows.

One pass writes the statistics of every text, without the text. Trees are grown from `trees` x `depth_rows` rows at most,
chosen by hash: each split takes a random statistic and a random value between the node's extremes, so odd texts
end on short paths. The score is 2^(-mean path / expected path). Scores of all labelled rows are counted in a
fixed number of bins per label, and the threshold is the one that rejects most bad rows among those that keep at least
`keep_good` of the good ones; without labelled good and bad rows the method rejects nothing.

Null text has no words and fails the base rules. A null id, repeated rows and labels are kept as they come: a row
with several labels counts once for each. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaycheck.llm import stats
from quaycheck.llm.common import bounded_sample, per_batch, staged

BASE = stats.COUNTS[:5]
BINS = 4096


def statistics(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, base counts, ratios array) of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = stats.counts(batch.column(1))
        r = stats.ratios(c)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, r.size + 1, r.shape[1], dtype=np.int32)), pa.array(r.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[k]) for k in BASE), flat], [id_col, *BASE, "ratios"])

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(per_batch(run), f"{id_col} long, " + ", ".join(f"{k} long" for k in BASE) + ", ratios array<double>")


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as arrays: statistic split on (-1: leaf), value, and left child; a leaf's value is its path length."""
    feature, value, left = [], [], []

    def new() -> int:
        feature.append(-1), value.append(0.0), left.append(0)
        return len(feature) - 1

    todo = [(new(), rows, 0)]
    while todo:
        at, own, level = todo.pop()
        low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(1), np.zeros(1))
        split = np.flatnonzero(high > low)
        if level >= depth or len(own) < 2 or not len(split):
            value[at] = level + float(expected_path(len(own)))
            continue
        f = int(rng.choice(split))
        cut = float(rng.uniform(low[f], high[f]))
        below = own[:, f] < cut
        if not below.any():
            cut = float(np.nextafter(own[:, f].min(), np.inf))
            below = own[:, f] < cut
        feature[at], value[at] = f, cut
        left[at] = new()
        new()
        todo += [(left[at], own[below], level + 1), (left[at] + 1, own[~below], level + 1)]
    return np.array(feature), np.array(value), np.array(left)


class Forest:
    def __init__(self, rows: np.ndarray, trees: int, depth_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.rows = min(depth_rows, len(rows))
        depth = int(np.ceil(np.log2(max(2, self.rows))))
        self.trees = [grow(rows[rng.choice(len(rows), self.rows, replace=False)], rng, depth) for _ in range(trees)] if len(rows) else []
        self.depth = depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; near 1 for rows on short paths."""
        total = np.zeros(len(x))
        i = np.arange(len(x))
        for feature, value, left in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, left[node] + (x[i, np.maximum(f, 0)] >= value[node]), node)
            total += value[node]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(1e-9, float(expected_path(self.rows)))) if self.trees else np.zeros(len(x))


def threshold(good: np.ndarray, bad: np.ndarray, keep_good: float) -> float:
    """Scores of this much and more are rejected. good, bad: counts per bin of the score."""
    if not good.sum() or not bad.sum():
        return np.inf
    kept = np.r_[0, np.cumsum(good)] / good.sum()
    caught = 1 - np.r_[0, np.cumsum(bad)] / bad.sum()
    ok = np.flatnonzero(kept >= keep_good)
    best = ok[np.flatnonzero(caught[ok] == caught[ok].max())[-1]]
    return float(best / len(good))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", trees: int = 128, depth_rows: int = 256, keep_good: float = 0.995, seed: int = 7) -> DataFrame:
    """Each text's base counts, base_failed, anomaly score and kept."""
    spark = docs.sparkSession
    measured = staged(statistics(docs, id_col, text), "rules")
    sample = np.array([r[0] for r in bounded_sample(measured.select("ratios", id_col), trees * depth_rows, id_col, "ratios").orderBy(F.xxhash64(id_col, "ratios")).select("ratios").collect()], float).reshape(-1, len(stats.RATIOS))
    forest = spark.sparkContext.broadcast(Forest(sample, trees, depth_rows, seed))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("ratios").flatten().to_numpy().reshape(-1, len(stats.RATIOS))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(forest.value.score(x))], [*batch.schema.names[:-1], "anomaly"])

    scored = staged(measured.mapInArrow(per_batch(run), f"{id_col} long, " + ", ".join(f"{k} long" for k in BASE) + ", anomaly double"), "anomaly")
    known = labels.select(F.col(id_col), (F.col(label) > 0).alias("good")).where(F.col(label).isNotNull())
    bins = scored.join(known, id_col).groupBy("good", F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect()
    good, bad = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for g, b, n in bins:
        (good if g else bad)[b] += n
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select(id_col, *BASE, failed.alias("base_failed"), (~failed & (F.col("anomaly") < F.lit(threshold(good, bad, keep_good)))).alias("kept"), "anomaly")
