"""Quality classifier by co-training of two views.

The text view sees statistics of the whole text and their squares; the metadata view sees the length and hashed
values of the metadata columns. Both start from labelled rows. In each round each view marks all rows without a label
of which its calibrated probability is at least `sure` for the good or the bad class; the other view learns from these too.
A row that the views are sure of in opposite ways is not used. Held-out labelled rows calibrate each view and fit how
the two log odds add up; the same rows set the threshold that keeps `keep_good` of the good ones. Every row of the
table is scored.

The views of all rows are staged once, as short binary rows. A round's marks are never gathered: each task adds up the
gradient and curvature of the rows it marks, dimensions x dimensions numbers whatever the table's size, and the
driver takes a Newton step from their sums and the labelled rows'. Marked rows weigh no more than the labelled ones
together. Fitting uses at most `labelled` labelled rows, chosen by hash of id and views; nothing else is limited.

Null text is empty; null metadata is a value of its own. Repeated rows are scored each. Labels of null id or value are
left out, and of an id's several labels the worst counts; rows of a labelled id are never marked. Where both classes are
not present every row is kept with probability 1. Columns named like the results (p_text, p_meta, probability, kept) are
replaced; all others pass unchanged. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaycheck.llm import stats
from quaycheck.llm.common import per_batch, staged

RESULTS = ("p_text", "p_meta", "probability", "kept")
HASHED = 32


def text_view(col: pa.Array) -> np.ndarray:
    c = stats.counts(col)
    r = stats.ratios(c)
    r[:, 0] = np.log1p(r[:, 0])
    return np.concatenate([r, np.sqrt(np.clip(r[:, 1:], 0, 4)), (c["n_words"] == 0)[:, None]], 1)


def meta_view(columns: list[pa.Array]) -> np.ndarray:
    """Numbers as log and its square, texts as hashed indicators."""
    out = []
    for i, col in enumerate(columns):
        if pa.types.is_integer(col.type) or pa.types.is_floating(col.type):
            x = np.log1p(np.abs(np.nan_to_num(col.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False))))
            out.append(np.stack([x, x * x], 1))
        else:
            one = np.zeros((len(col), HASHED))
            values = [zlib.crc32(f"{i}:{v}".encode()) % HASHED for v in col.cast(pa.string()).to_pylist()]
            one[np.arange(len(col)), values] = 1
            out.append(one)
    return np.concatenate(out, 1) if out else np.zeros((0, 0))


@dataclass
class Logistic:
    """Standardised logistic regression, then a line that calibrates its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (self.standard(x) @ self.weights[:-1] + self.weights[-1]) + self.shift

    def calibrated(self, weights: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> Logistic:
        """The same with other weights, whose log odds are fitted to held-out rows."""
        plain = Logistic(self.mean, self.scale, weights)
        slope, shift = newton(plain.odds(held_x)[:, None], held_y, 1e-2)
        return Logistic(self.mean, self.scale, weights, slope, shift)


def newton(z: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression; the last one is the constant."""
    z = np.c_[z, np.ones(len(z))]
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> Logistic:
    mean, scale = x.mean(0), x.std(0) + 1e-6
    plain = Logistic(mean, scale, np.zeros(x.shape[1] + 1))
    return plain.calibrated(newton(plain.standard(x), y, 1.0), held_x, held_y)


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    weights: np.ndarray
    least: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.odds(text), self.meta.odds(meta)
        chance = lambda o: 1 / (1 + np.exp(-np.clip(o, -40, 40)))
        return chance(a), chance(b), chance(np.c_[a, b, np.ones(len(a))] @ self.weights)


@dataclass
class Curve:
    """Gradient and curvature of the logistic loss at given weights, and the number of rows in them."""

    slope: np.ndarray
    bend: np.ndarray
    rows: float

    @classmethod
    def of(cls, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> Curve:
        z = np.c_[z, np.ones(len(z))]
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        return cls(z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z, float(len(z)))


def marks(models: dict[str, Logistic], views: dict[str, np.ndarray], sure: float) -> dict[str, np.ndarray]:
    """What each view learns of rows without a label: the class that the other view is sure of, -1 where it is not or where
    both are sure of opposite ones."""
    odds = np.log(sure / (1 - sure))
    own = {name: np.where((o := models[name].odds(x)) >= odds, 1, np.where(o <= -odds, 0, -1)) for name, x in views.items()}
    clash = (own["text"] >= 0) & (own["meta"] >= 0) & (own["text"] != own["meta"])
    return {"text": np.where(clash, -1, own["meta"]), "meta": np.where(clash, -1, own["text"])}


def unpacked(col: pa.Array) -> np.ndarray:
    """Binary rows of single-precision numbers as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), "<f4").reshape(len(col), -1).astype(np.float64)


def marked_curves(pool: DataFrame, models: dict[str, Logistic], weights: dict[str, np.ndarray], sure: float) -> dict[str, Curve]:
    """Curves of both views at `weights` over all rows that `models` mark."""

    def run(batches):
        total: dict[str, Curve] = {}
        for batch in batches:
            views = {"text": unpacked(batch.column(0)), "meta": unpacked(batch.column(1))}
            for name, told in marks(models, views, sure).items():
                use = told >= 0
                new = Curve.of(models[name].standard(views[name][use]), told[use], weights[name])
                old = total.get(name)
                total[name] = new if old is None else Curve(old.slope + new.slope, old.bend + new.bend, old.rows + new.rows)
        for name, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([np.r_[c.rows, c.slope, c.bend.ravel()]], pa.list_(pa.float64()))], ["view", "sums"])

    part = pool.select("text", "meta").mapInArrow(run, "view string, sums array<double>").select("view", F.posexplode("sums").alias("at", "x"))
    got = part.groupBy("view", "at").agg(F.sum("x").alias("x")).collect()
    out = {}
    for name, w in weights.items():
        d = len(w)
        sums = np.zeros(1 + d + d * d)
        for r in got:
            if r.view == name:
                sums[r.at] = r.x
        out[name] = Curve(sums[1 : 1 + d], sums[1 + d :].reshape(d, d), sums[0])
    return out


def co_train(labelled: dict[str, np.ndarray], y: np.ndarray, key: np.ndarray, pool: DataFrame, rounds: int, steps: int, sure: float, keep_good: float) -> Model | None:
    """Both views from labelled rows and the pool's marks. Every fourth labelled row by key is held out."""
    held = key % 4 == 0
    if any(len(set(y[part])) < 2 for part in (held, ~held)):
        return None
    models = {name: fit(x[~held], y[~held], x[held], y[held]) for name, x in labelled.items()}
    for _ in range(rounds):
        weights = {name: m.weights for name, m in models.items()}
        for _ in range(steps):
            curves = marked_curves(pool, models, weights, sure)
            for name, x in labelled.items():
                w, c = weights[name], curves[name]
                own = Curve.of(models[name].standard(x[~held]), y[~held], w)
                share = min(1.0, own.rows / max(c.rows, 1.0))
                penalty = np.r_[np.ones(len(w) - 1), 1e-6]
                weights[name] = w - np.linalg.solve(own.bend + share * c.bend + np.diag(penalty), own.slope + share * c.slope + penalty * w)
        models = {name: m.calibrated(weights[name], labelled[name][held], y[held]) for name, m in models.items()}
    a, b = models["text"].odds(labelled["text"][held]), models["meta"].odds(labelled["meta"][held])
    out = Model(models["text"], models["meta"], newton(np.c_[a, b], y[held], 1e-2), 0.0)
    p = np.sort(out.score(labelled["text"][held], labelled["meta"][held])[2][y[held] == 1])
    out.least = float(min(0.5, p[int((1 - keep_good) * len(p))]))
    return out


def viewed(docs: DataFrame, labels: DataFrame, id_col: str, text: str, meta: list[str], label: str) -> DataFrame:
    """(key, y, text, meta): both views of every row; y is null without a label, -1 with one that cannot be used."""

    def view(batch: pa.RecordBatch) -> pa.RecordBatch:
        views = [[r.tobytes() for r in v.astype("<f4")] for v in (text_view(batch.column(1)), meta_view(batch.columns[2:]))]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.binary()) for v in views)], ["id", "text", "meta"])

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).cast("string").alias("text"), *meta)
    rows = staged(own.mapInArrow(per_batch(view), "id string, text binary, meta binary"), "views")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.coalesce(F.min((F.col(label) > 0).cast("int")), F.lit(-1)).alias("y"))
    return rows.join(known, "id", "left").select(F.crc32(F.coalesce("id", F.lit("None")).cast("binary")).alias("key"), "y", "text", "meta")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text: str, meta: list[str], label: str, labelled: int, rounds: int, steps: int, sure: float, keep_good: float) -> Model | None:
    rows = staged(viewed(docs, labels, id_col, text, meta, label), "labelled-views")
    known = rows.where("y >= 0").withColumn("h", F.shiftrightunsigned(F.xxhash64("key", "text", "meta"), 2))
    n = known.count()
    if n > labelled:  # few more than wanted reach the ordered limit, whatever the table's size
        known = known.where(F.col("h") < int(1.1 * labelled / n * 2**62))
    some = known.orderBy("h", "key", "text", "meta").limit(labelled).collect()
    if not some:
        return None
    views = {name: np.stack([np.frombuffer(r[name], "<f4").astype(np.float64) for r in some]) for name in ("text", "meta")}
    y, key = np.array([r["y"] for r in some]), np.array([r["key"] for r in some])
    return co_train(views, y, key, rows.where("y IS NULL"), rounds, steps, sure, keep_good)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("lang", "source", "n_chars"), label: str = "quality",
    labelled: int = 12_000, rounds: int = 3, steps: int = 2, sure: float = 0.98, keep_good: float = 0.998,
) -> DataFrame:
    """All rows and columns, with p_text, p_meta, probability (of good quality) and kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text, list(meta), label, labelled, rounds, steps, sure, keep_good))
    base = docs.drop(*RESULTS)
    names = base.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, n = model.value, batch.num_rows
        if found is None:
            results = [np.ones(n)] * 3
            least = 0.0
        else:
            results = found.score(text_view(batch.column(text)), meta_view([batch.column(c) for c in meta]))
            least = found.least
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(r) for r in results), pa.array(results[2] >= least)], [*names, *RESULTS])

    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return base.mapInArrow(per_batch(run), f"{schema}, p_text double, p_meta double, probability double, kept boolean")
