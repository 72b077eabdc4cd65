"""Language of texts by Bayesian fusion of four kinds of evidence.

Text: a multinomial model over hashed letter trigrams, counted over all declared rows. Declared language of the
markup, address suffix and host: how often each goes with a language is counted over all rows by grouped sums of what
the text alone says. A host's prior is smoothed towards its suffix's, which is smoothed towards the table's;
the chances of a declared language and of a suffix given the language are smoothed likewise. The log terms add up; text
evidence is tempered, as trigrams of one text are not independent. Hosts and suffixes are tables joined by key, never
broadcast by force.

A row is rejected if its text has fewer than `least` known trigrams, or if no language reaches `sure`.

Languages are all codes of two or three letters that any row declares, however few; a row carries a number for each of
them, and a model holds as many as languages x letter buckets. Null and
empty texts have no evidence: they get the other evidence's language and are rejected. Null or unknown declared values,
addresses and hosts say nothing of their own. Repeated rows and null ids are judged each. Columns named like the
results are replaced, all others pass unchanged. Without any declared row the language is null and all are rejected.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.llm.common import per_batch, staged
from quaycheck.llm.words import LOWER, mix, slices, text_bytes

RESULTS = ("language", "probability", "text_language", "kept")
BUCKETS = 1 << 15
#: Text bytes whose trigrams a worker holds at once; they take many times their size.
SLICE = 1 << 18
#: Signs in letters: ASCII letters and all bytes of multi-byte signs.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[0x80:] = True
_THREE = np.uint64(0x9E3779B97F4A7C15)


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-case letters and word edges, and how many come before each text (n + 1 values)."""
    parts, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for lo, hi in slices(col):
        raw, at = text_bytes(col.slice(lo, hi - lo))
        raw = LOWER[raw]
        letter = _LETTER[raw]
        sign = np.where(letter, raw, 32).astype(np.int64)
        if len(raw) < 3:
            sizes.append(np.zeros(hi - lo, np.int64))
            continue
        code = sign[:-2] << 16 | sign[1:-1] << 8 | sign[2:]
        use = letter[1:-1].copy()  # the middle is a letter, the sides may be word edges
        edges = at[1:-1]
        for back in (1, 2):  # not across two texts
            i = edges - back
            use[i[(i >= 0) & (i < len(use))]] = False
        place = np.flatnonzero(use)
        parts.append(((code[place].astype(np.uint64) * _THREE) >> np.uint64(49)).astype(np.int64))
        before = np.searchsorted(place, at)
        sizes.append(np.diff(before))
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def text_model(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log chances of every trigram bucket by language, from all declared rows."""
    place = {x: i for i, x in enumerate(languages)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            text, declared = batch.columns
            who = np.array([place.get(d, -1) for d in declared.to_pylist()])
            for lo, hi in slices(text, SLICE):
                g, at = trigrams(text.slice(lo, hi - lo))
                own = np.repeat(who[lo:hi], np.diff(at))
                for i in np.unique(own[own >= 0]).tolist():
                    total[i] = total.get(i, 0) + np.bincount(g[own == i], minlength=BUCKETS)
        for i, row in total.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "n": pa.array([row.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        row = np.zeros(BUCKETS, np.int64)
        for n in group["n"].to_pylist():
            row += np.frombuffer(n, np.int64)
        return pa.table({"i": group["i"].slice(0, 1), "n": pa.array([row.tobytes()], pa.binary())})

    sums = rows.select("text", "declared").mapInArrow(count, "i int, n binary").groupBy("i").applyInArrow(add, "i int, n binary")
    out = np.full((len(languages), BUCKETS), 0.5, np.float32)
    for r in sums.collect():  # a row of fixed size for each language
        out[r[0]] += np.frombuffer(r[1], np.int64)
    return np.log(out / out.sum(1, keepdims=True, dtype=np.float64))


def host_of(address: Column) -> Column:
    """Lower-case host of a web address, null if there is none."""
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    """Last label of a host, null for numbers and single names."""
    label = F.regexp_extract(host, r"\.([a-z][a-z0-9\-]*)\.?$", 1)
    return F.when(label != "", label)


def with_text_evidence(rows: DataFrame, model: np.ndarray, text: str, temper: float, keep: list[str]) -> DataFrame:
    """The kept columns, with each language's tempered log likelihood and the number of known trigrams."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = dict(rows.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        logs = shared.value
        n_lang, n = len(logs), batch.num_rows
        sums, known = np.zeros((n, n_lang)), np.zeros(n, np.int64)
        col = batch.column(batch.schema.names.index("__text"))
        for lo, hi in slices(col, SLICE):
            g, at = trigrams(col.slice(lo, hi - lo))
            total = np.zeros((len(g) + 1, n_lang))
            for i in range(n_lang):
                np.cumsum(logs[i][g], out=total[1:, i])
            sums[lo:hi] = total[at[1:]] - total[at[:-1]]
            known[lo:hi] = np.diff(at)
        scale = np.where(known > 0, np.minimum(1.0, temper / np.maximum(1.0, np.sqrt(known))), 0.0)
        sums = (sums - sums.max(1, keepdims=True)) * scale[:, None] if n_lang else sums
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n_lang, dtype=np.int32)), pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat, pa.array(known)], [*keep, "__logs", "__known"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    own = rows.withColumn("__text", F.col(text).cast("string")).select(*dict.fromkeys([*keep, "__text"]))
    return own.mapInArrow(per_batch(run), f"{schema}, __logs array<double>, __known long")


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    each = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.transform(each, lambda x: x / total)


def _sums(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Summed chances by key, as an array."""
    sums = [F.sum(F.col("__p")[i]).alias(f"s{i}") for i in range(n)]
    got = rows.groupBy(*keys) if keys else rows.groupBy(F.lit(0).alias("all"))
    return got.agg(*sums).select(*keys, F.array(*[f"s{i}" for i in range(n)]).alias("sums"))


def _smoothed(sums: Column, prior: Column, weight: float) -> Column:
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(sums, prior, lambda s, p: (s + F.lit(weight) * p) / (total + F.lit(weight)))


def identify(
    rows: DataFrame, text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, carry: list[str] | None = None,
    temper: float = 12.0, weight: float = 20.0, least: int = 1, sure: float = 0.5,
) -> DataFrame:
    """Rows with language, probability, text_language and kept; `carry` names the columns that come along (default: all).

    `weight` is how many rows a parent's prior counts for; `temper` bounds how much a long text outweighs the rest.
    """
    none = F.lit(None).cast("string")
    columns = [c for c in (carry if carry is not None else rows.columns) if c not in RESULTS]
    code = lambda c: F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    full = rows.withColumns({"__declared": none if declared is None else code(declared), "__host": none if host is None else host, "__suffix": none if suffix is None else suffix})
    languages = sorted(r[0] for r in full.where("__declared <> ''").select("__declared").distinct().collect())
    if not languages:
        return rows.drop(*RESULTS).select(*columns).withColumns({"language": none, "probability": F.lit(0.0), "text_language": none, "kept": F.lit(False)})
    n = len(languages)
    model = text_model(full.select(F.col(text).cast("string").alias("text"), F.col("__declared").alias("declared")).where(F.col("declared").isin(languages)), languages)

    names = F.array(*[F.lit(x) for x in languages])
    known = F.when(F.col("__declared").isin(languages), F.col("__declared"))
    keys = ["__declared", "__host", "__suffix"]
    small = with_text_evidence(full.withColumn("__declared", known), model, text, temper, keys)
    said = staged(small.where(F.col("__known") > 0).select(*keys, softmax(F.col("__logs")).alias("__p")).groupBy(*keys).agg(*[F.sum(F.col("__p")[i]).alias(f"p{i}") for i in range(n)]), "evidence")
    said = said.select(*keys, F.array(*[f"p{i}" for i in range(n)]).alias("__p"))
    every = _sums(said, n).first()
    base = np.array(every[0] if every and every[0][0] is not None else np.zeros(n), float) + 1.0
    prior = base / base.sum()
    flat = F.array(*[F.lit(float(p)) for p in prior])

    def likelihood(key: str) -> DataFrame:
        """log P(key | language) by key; a key unknown to all languages says nothing."""
        sums = _sums(said.where(F.col(key).isNotNull()), n, key)
        # a key's share in each language, against its share in the table
        return sums.select(key, F.transform(F.zip_with(_smoothed(F.col("sums"), flat, weight), flat, lambda a, b: a / b), lambda x: F.log(x)).alias(f"{key}_logs"))

    by_suffix = _sums(said.where(F.col("__suffix").isNotNull()), n, "__suffix").select("__suffix", _smoothed(F.col("sums"), flat, weight).alias("parent"))
    hosted = said.where(F.col("__host").isNotNull())
    suffixes = hosted.groupBy("__host").agg(F.max("__suffix").alias("__suffix"))  # one, unless the caller gives a host several
    hosts = _sums(hosted, n, "__host").join(suffixes, "__host").join(by_suffix, "__suffix", "left")
    hosts = staged(hosts.select("__host", F.transform(_smoothed(F.col("sums"), F.coalesce("parent", flat), weight), lambda x: F.log(x)).alias("__host_logs")), "hosts")
    declared_logs, suffix_logs = staged(likelihood("__declared"), "declared"), staged(likelihood("__suffix"), "suffixes")

    out = with_text_evidence(full.withColumn("__declared", known), model, text, temper, [*columns, *keys])
    out = out.join(declared_logs, "__declared", "left").join(suffix_logs, "__suffix", "left").join(hosts, "__host", "left")
    zero = F.array(*[F.lit(0.0)] * n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = F.col("__logs")
    for part in ("__declared_logs", "__suffix_logs"):
        logs = add(logs, F.coalesce(part, zero))
    logs = add(logs, F.coalesce("__host_logs", F.transform(flat, lambda x: F.log(x))))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    out = out.withColumn("__p", softmax(logs)).withColumns({"language": best(F.col("__p")), "probability": F.array_max("__p"), "text_language": F.when(F.col("__known") > 0, best(F.col("__logs")))})
    out = out.withColumn("kept", (F.col("__known") >= least) & (F.col("probability") >= sure))
    return out.select(*columns, *RESULTS)


def visible(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags; enough for letter counts."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->|<[^>]*+>", " ")
    return F.regexp_replace(plain, r"&[#A-Za-z0-9]{1,32};", " ")


def markup_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3}(?:[-_][A-Za-z0-9]+)*)", 1)
