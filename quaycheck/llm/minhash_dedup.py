"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

Sets. A text's set is its distinct five-word shingles as 64-bit hashes. Texts with equal sets form a class; one of
them stands for all, so copies are never compared.

Candidates. Signatures of `bands` x `rows` minima; representatives with an equal band share a bucket. A bucket is
never expanded into its pairs. Its members are paired with its leader, found by aggregation; links join them to
components. Where a bucket still spans several components, the members outside the largest one are paired with a leader
of that one. What is left after that is compared in full, members outside the largest component against all of other
components, block by block within tasks: no candidate pair between two components is left out, and none becomes a row.

Verification. The pair's signatures are compared in batches. With a uniform prior, after m agreements in n minima the
similarity follows Beta(m + 1, n - m + 1); a pair is given up as soon as the chance that its similarity reaches the
threshold is below `miss`. Of each minimum only the lowest byte is stored: unequal minima agree in 1 of 256 cases,
which can only keep a pair longer. Survivors are decided by the exact sizes of the intersection and union of their full sets.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^rows)^bands, 1.3e-6 at the defaults (50 bands of 5).

Null texts and texts without words have empty sets and link with nothing. Fewer words than a shingle make one shingle
of all words. Null ids, and rows of one id, are classes by their texts like any other; a component is named by the
smallest id in it that is not null. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaycheck.llm.common import per_batch, staged
from quaycheck.llm.components import components, grown
from quaycheck.llm.words import mix, runs, slices, word_hashes

_TEXT = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, one text after another, and where each starts (n + 1 values)."""
    parts, sizes = [], [np.zeros(1, np.int64)]
    for lo, hi in slices(col):
        h, words = word_hashes(col.slice(lo, hi - lo))
        n = np.diff(words)
        text = np.repeat(np.arange(hi - lo), n)
        grams = runs(h, width)
        inside = text[: len(grams)] == text[width - 1 :] if len(grams) else np.zeros(0, bool)
        keys, owner = grams[inside], text[: len(grams)][inside]
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            keys = np.r_[keys, [mix(runs(h[words[i] : words[i + 1]], int(n[i])) + np.uint64(n[i]))[0] for i in short]].astype(np.uint64)
            owner = np.r_[owner, short]
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[new], owner[new]
        parts.append(keys)
        sizes.append(np.bincount(owner, minlength=hi - lo))
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.cumsum(np.concatenate(sizes))


def names(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits that name each set: a mixed sum over its shingles."""
    total = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(mix(keys * _TEXT), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]])


@cache
def _seeds(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Minima of n hash functions over each set (none of them empty), as unsigned 32-bit numbers."""
    out = np.empty((len(at) - 1, n), np.uint32)
    block = 1 << 15
    for i, seed in enumerate(_seeds(n)):
        for lo in range(0, len(at) - 1, block):
            hi = min(lo + block, len(at) - 1)
            own = keys[at[lo] : at[hi]]
            out[lo:hi, i] = np.minimum.reduceat(((own ^ (own >> np.uint64(29))) * seed) >> np.uint64(32), at[lo:hi] - at[lo])
    return out


def sketches(docs: DataFrame, id_col: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, node, signature, bands) of every text; the last two only where a task first meets the set."""

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            col = batch.column(1)
            for lo, hi in slices(col):
                keys, at = shingle_sets(col.slice(lo, hi - lo), width)
                node, n = names(keys, at).view(np.int64), np.diff(at)
                first = np.zeros(hi - lo, bool)
                first[np.unique(node, return_index=True)[1]] = True
                first &= n > 0
                first[first] = [x not in met for x in node[first].tolist()]
                met.update(node[first].tolist())
                if len(met) > 1_000_000:
                    met.clear()
                some = np.flatnonzero(first)
                held = np.repeat(first, n)
                sig = signatures(keys[held], np.r_[0, np.cumsum(n[some])], bands * rows) if len(some) else np.zeros((0, bands * rows), np.uint32)
                band = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    band = mix(band + sig[:, r::rows].astype(np.uint64) + np.arange(bands, dtype=np.uint64)[None, :] * _TEXT)
                place = np.cumsum(first) - 1
                low = sig.astype(np.uint8)
                packed = [low[i].tobytes() if f else None for i, f in zip(place.tolist(), first.tolist(), strict=True)]
                lists = [band[i].view(np.int64) if f else None for i, f in zip(place.tolist(), first.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(node), pa.array(packed, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["id", "n_shingles", "node", "signature", "bands"]
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, n_shingles long, node long, signature binary, bands array<long>")


@cache
def least_agreements(batch: int, batches: int, threshold: float, miss: float) -> tuple[int, ...]:
    """Fewest agreements after each batch of minima with which the similarity may still reach the threshold.

    P(similarity >= threshold | m of n) is the upper tail of Beta(m + 1, n - m + 1), that is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for i in range(1, batches + 1):
        n = i * batch + 1
        logs = np.cumsum(np.r_[0.0, np.log((n - np.arange(n)) / np.arange(1, n + 1))]) + np.arange(n + 1) * np.log(threshold) + (n - np.arange(n + 1)) * np.log1p(-threshold)
        out.append(int(np.searchsorted(np.cumsum(np.exp(logs)), miss, "left")))
    return tuple(out)


def plausible(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float, batch_size: int) -> DataFrame:
    """Candidate pairs (a, b) that no batch of minima gave up."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        n = batch.num_rows
        if not n:
            return None
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in ("sa", "sb"))
        least = least_agreements(batch_size, a.shape[1] // batch_size, threshold, miss)
        live, agreed = np.arange(n), np.zeros(n, np.int64)
        for i, m in enumerate(least):
            part = slice(i * batch_size, (i + 1) * batch_size)
            agreed = agreed + (a[live, part] == b[live, part]).sum(1)
            live, agreed = live[agreed >= m], agreed[agreed >= m]
        return pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(live)), batch.column("b").take(pa.array(live))], ["a", "b"])

    left = sigs.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(per_batch(run), "a long, b long")


def full_sets(docs: DataFrame, firsts: DataFrame, wanted: DataFrame, repeated: bool, id_col: str, text: str, width: int, few: int = 1_000_000) -> DataFrame:
    """(node, keys): the full sets of the wanted nodes, packed; up to `few` ids are broadcast to the scan, more are joined."""

    def sets(batches):
        for batch in batches:
            col = batch.column(1)
            for lo, hi in slices(col):
                keys, at = shingle_sets(col.slice(lo, hi - lo), width)
                yield pa.RecordBatch.from_arrays([pa.array(names(keys, at).view(np.int64)), pa.array([keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "keys"])

    ids = firsts.join(wanted, "node", "left_semi").select("first").distinct()
    if ids.count() <= few:
        ids = F.broadcast(ids)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = own.join(ids, own["id"].eqNullSafe(ids["first"]), "left_semi").select("id", "text").mapInArrow(sets, "node long, keys binary")
    return found.dropDuplicates(["node"]) if repeated else found


def verified(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs with whole * intersection >= part * union on their full sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            ok.append(whole * both >= part * (len(x) + len(y) - both))
        keep = pa.array(ok, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("keys").alias("ka")), sets.select(F.col("node").alias("b"), F.col("keys").alias("kb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ka", "kb").mapInArrow(per_batch(run), "a long, b long")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def outside_main(members: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
    """Members (key, band, node, label) of buckets that span several components, with the label and a leader of the largest one."""
    own = members.join(labels, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("label"))
    parts = own.groupBy("key", "label").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(salt))).alias("leader"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "label", "leader")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("main.label").alias("main"), F.col("main.leader").alias("leader"))
    return staged(own.join(main, "key"), "open")


def compared_in_blocks(members: DataFrame, payload: DataFrame, threshold: tuple[int, int], miss: float, batch_size: int, rows: int = 512, shingles: int = 400_000) -> DataFrame:
    """Links between members outside a bucket's largest component and its members of other components.

    A bucket's members are cut into blocks and each pair of blocks is compared within one task: pairs are formed in
    arrays, never as rows, and only links come out, one per member and component. A pair that shares several
    buckets is compared in that of the first band.
    """
    part, whole = threshold
    # blocks are laid out on narrow rows; sets and signatures join last and are shuffled by block once
    thin = members.join(payload.select("node", "n"), "node")
    outside = F.when(F.col("label") != F.col("main"), 1)
    most = lambda n, size: F.ceil(F.greatest(n / rows, size / shingles)).cast("int")
    sizes = thin.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("s"), F.count(outside).alias("nu"), F.sum(F.col("n") * outside).alias("su"))
    sizes = sizes.select("key", most(F.col("rows"), F.col("s")).alias("ms"), most(F.col("nu"), F.col("su")).alias("us"))
    placed = thin.join(sizes, "key")
    cut = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["key", "band", "node", "label"]
    all_ = placed.select(*columns, F.lit(False).alias("out"), cut(F.col("ms")).alias("m"), every("us").alias("u"))
    out = placed.where("label <> main").select(*columns, F.lit(True).alias("out"), every("ms").alias("m"), cut(F.col("us")).alias("u"))
    laid = staged(all_.unionByName(out), "blocks").join(payload, "node")
    laid = laid.select(*columns, "out", "m", "u", "keys", "signature", F.slice("bands", F.lit(1), F.col("band")).alias("bands"))

    def compare(group: pa.Table) -> pa.Table:
        band = group["band"][0].as_py()
        sides = {}
        for flag in (True, False):
            g = group.filter(pa.compute.equal(group["out"], flag))
            n = g.num_rows
            flat = np.array(g["bands"].to_pylist(), np.int64).reshape(n, band)
            sig = np.frombuffer(b"".join(g["signature"].to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, batch_size), np.uint8)
            sides[flag] = g["node"].to_numpy(), g["label"].to_numpy(), flat, sig, [np.frombuffer(k, np.uint64) for k in g["keys"].to_pylist()]
        (nu, lu, bu, su, ku), (nm, lm, bm, sm, km) = sides[True], sides[False]
        open_ = lu[:, None] != lm[None, :]
        for i in range(band):
            open_ &= bu[:, i, None] != bm[None, :, i]
        iu, im = np.nonzero(open_)
        agreed = np.zeros(len(iu), np.int64)
        for i, least in enumerate(least_agreements(batch_size, su.shape[1] // batch_size, part / whole, miss)):
            cols = slice(i * batch_size, (i + 1) * batch_size)
            for lo in range(0, len(iu), 1 << 18):
                some = slice(lo, lo + (1 << 18))
                agreed[some] += (su[iu[some], cols] == sm[im[some], cols]).sum(1)
            ok = agreed >= least
            iu, im, agreed = iu[ok], im[ok], agreed[ok]
        met, a, b = set(), [], []
        for i, j in zip(iu.tolist(), im.tolist(), strict=True):
            if (i, lm[j]) in met:
                continue
            both = len(np.intersect1d(ku[i], km[j], assume_unique=True))
            if whole * both >= part * (len(ku[i]) + len(km[j]) - both):
                met.add((i, lm[j]))
                a.append(int(nu[i]))
                b.append(int(nm[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return laid.groupBy("key", "m", "u").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, threshold: tuple[int, int] = (75, 100), bands: int = 50, rows: int = 5, miss: float = 1e-6, batch: int = 25,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; kept marks the row that names its component."""
    part, whole = threshold
    sketched = staged(sketches(docs, id_col, text, width, bands, rows), "sketches")
    prints = sketched.select("id", "n_shingles", "node")
    classes = prints.where("n_shingles > 0").groupBy("node", "id").agg(F.count("*").alias("n")).groupBy("node").agg(F.min("id").alias("first"), F.max("n").alias("n"))
    classes = staged(classes, "classes")
    firsts = classes.select("node", "first")
    repeated = bool((classes.agg(F.max("n")).first()[0] or 0) > 1) or prints.where("id is null").limit(1).count() > 0
    sigs = staged(sketched.where("signature is not null").select("node", "signature", "bands").dropDuplicates(["node"]), "signatures")

    keyed = sigs.select("node", F.posexplode("bands").alias("band", "key"))
    leaders = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node")).alias("leader")).where("n > 1").select("key", "leader")
    members = staged(keyed.join(leaders, "key"), "members")
    sets = staged(full_sets(docs, firsts, members.select("node").distinct(), repeated, id_col, text, width), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        return staged(verified(plausible(pairs, sigs.select("node", "signature"), part / whole, miss, batch), sets, part, whole), "verified")

    # every bucket's leader with its members; then, where components still meet, a leader of the largest one with those outside it
    tried = staged(members.where("node <> leader").select(*_ordered("node", "leader")).distinct(), "tried")
    labels = staged(components(linked(tried)), "labels")
    open_ = outside_main(members.drop("leader"), labels, 1)
    more = staged(open_.where("label <> main").select(*_ordered("node", "leader")).distinct().join(tried, ["a", "b"], "left_anti"), "more")
    if more.limit(1).count():
        labels = staged(grown(labels, linked(more)), "labels")
    # what is left is compared in full, block by block
    if open_.limit(1).count():
        open_ = outside_main(open_.select("key", "band", "node"), labels, 2).drop("leader")
        payload = sets.join(sigs, "node").join(open_.select("node").distinct(), "node", "left_semi").select("node", "keys", "signature", "bands", (F.length("keys") / 8).cast("long").alias("n"))
        last = staged(compared_in_blocks(open_, staged(payload, "payload"), threshold, miss, batch), "last")
        labels = staged(grown(labels, last), "labels")

    named = classes.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    found = staged(named.join(smallest, "component").select("node", "component_id"), "named")
    some, none = prints.where("n_shingles > 0").join(found, "node"), prints.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    rows_ = some.select("id", "n_shingles", "component_id").unionByName(none.select("id", "n_shingles", "component_id"))
    return rows_.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
