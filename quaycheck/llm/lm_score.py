"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting. Texts are numbered in a written table and read in stretches of some MB. A stretch's distinct tokens and token
pairs go out as sorted hashes with their counts, cut by ranges of hashes into one message a bucket; the number of buckets
follows the table's size, so a bucket stays small and a frequent pair arrives there once per stretch. N-grams of
held-out rows go along with a count of nothing. A bucket turns its counts into a segment of the filter: an n-gram of count
c is entered as the events (n-gram, 1) to (n-gram, q) with q = 1 + floor(log_base(c)). A probe asks for j = 1, 2, ...
until an event is missing; the mean of the counts with that q is the answer. Every event sets a few bits of one 64-bit word.

Scoring. What a stretch counted is what its texts ask for: the bucket probes its segment for the n-grams it was sent and
answers every message with a byte for each n-gram, and for tokens the exact count, in the order they came. The
answers meet the texts again by stretch. No task holds more of the filter than one segment, and nothing that grows with the
n-grams is broadcast or sent to the driver. Probabilities are p(w|h) = (c(h,w) + K p(w)) / (c(h) + K) with
p(w) = (c(w) + 1) / (N + V + 1), K the one of a grid with the best leave-one-out likelihood over all training rows: the
pass that scores a text does so for every K of the grid, and the sums over the training rows then choose.
A pair's count is taken as no larger than its parts', which corrects most false hits. The base score takes the exact counts.

Null text counts as empty; an empty text is one end token. A null id trains. Repeated rows are scored each. Other
columns are left out. An empty table gives no rows. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.llm.common import bucket_edges, planes, scan_tasks, small, staged, summed, unplanes, unsmall
from quaycheck.llm.words import SLICE, mix, slices, text_bytes, word_hashes

END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_PAIR, _EVENT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def sequences(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows, each row closed by an end, the token before each, and where rows start (n + 1)."""
    h, words = word_hashes(col)
    at = words + np.arange(len(words))
    tokens = np.insert(h, words[1:], END)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = BEGIN
    return tokens, before, at


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + tokens)


class Levels:
    """Quantisation of counts: level of a count, and the mean count of a level."""

    def __init__(self, base: float, top: int = 200):
        self.low = np.unique(np.ceil(base ** np.arange(top) - 1e-9).clip(max=2.0**62).astype(np.int64))
        self.mean = np.r_[0.0, (self.low[:-1] + self.low[1:] - 1) / 2, float(self.low[-1])]

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, counts, "right")


class LogFrequencyFilter:
    """Segments by hash range; each is an array of 64-bit words sized by its events."""

    def __init__(self, edges: np.ndarray, starts: np.ndarray, words: np.ndarray, levels: Levels, bits: int):
        self.edges, self.starts, self.words, self.levels, self.bits = edges, starts, words, levels, bits

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Probes event after event until one is missing."""
        seg = np.searchsorted(self.edges, keys, "right") - 1
        start, size = self.starts[seg], (self.starts[seg + 1] - self.starts[seg]).astype(np.uint64)
        out = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(size > 0)
        step = 0
        while len(live):
            step += 1
            slot, mask = event(keys[live], step, size[live], self.bits)
            live = live[(self.words[start[live] + slot] & mask) == mask]
            out[live] = step
        return np.minimum(out, len(self.levels.mean) - 1)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return self.levels.mean[self.level(keys)]


def event(keys: np.ndarray, step: int | np.ndarray, size: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit mask of the event (n-gram, step) in a segment of `size` words."""
    h = mix(keys + _EVENT * np.asarray(step, np.uint64))
    slot = ((h >> np.uint64(32)) * size) >> np.uint64(32)
    g, mask = mix(h + _EVENT), np.zeros(len(keys), np.uint64)
    for i in range(bits):
        mask |= np.uint64(1) << ((g >> np.uint64(6 * i)) & np.uint64(63))
    return slot.astype(np.int64), mask


def segment(keys: np.ndarray, counts: np.ndarray, levels: Levels, bits_per_event: int, bits: int) -> np.ndarray:
    """The words of one segment holding these counts."""
    top = levels.of(counts)
    size = int(top.sum()) * bits_per_event // 64 + 1
    words = np.zeros(size, np.uint64)
    step = 1
    while len(keys):
        slot, mask = event(keys, step, np.full(len(keys), size, np.uint64), bits)
        np.bitwise_or.at(words, slot, mask)
        step += 1
        keep = top >= step
        keys, top = keys[keep], top[keep]
    return words


def stretches(rows: np.ndarray, col: pa.Array):
    """Slices of a batch whose row numbers follow each other."""
    for lo, hi in slices(col):
        cut = [lo, *(lo + 1 + np.flatnonzero(np.diff(rows[lo:hi]) != 1)).tolist(), hi]
        yield from zip(cut[:-1], cut[1:], strict=True)


def ngram_counts(texts: DataFrame, buckets: int, hold: int = 8 * SLICE) -> DataFrame:
    """(at, bucket, tokens, token_counts, pairs, pair_counts): the distinct n-grams of each stretch of rows, cut by ranges of
    hashes, with their counts in training rows. A stretch begins with row number `at`, has rows without a gap, and ends
    once it has `hold` bytes of text, so a worker holds no more."""
    edges = bucket_edges(buckets)

    def count(batches):
        held: tuple[list, list] = ([], [])
        first, last, size = 0, None, 0

        def flush():
            cuts, sums = [], []
            for parts in held:
                k, c = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                parts.clear()
                cuts.append(np.r_[np.searchsorted(k, edges), len(k)])
                sums.append((k, c))
            full = np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0))
            for lo in range(0, len(full), 64):
                some = full[lo : lo + 64]
                columns = {"at": pa.array([first] * len(some), pa.int64()), "bucket": pa.array(some, pa.int32())}
                for name, (k, c), cut in zip(("token", "pair"), sums, cuts, strict=True):
                    # sorted hashes as what each adds to the one before: the upper bytes are mostly zeros
                    columns[f"{name}s"] = pa.array([planes(np.diff(k[cut[b] : cut[b + 1]], prepend=edges[b])) for b in some], pa.binary())
                    columns[f"{name}_counts"] = pa.array([small(c[cut[b] : cut[b + 1]]) for b in some], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            col, rows = batch.column("text"), batch.column("row").to_numpy()
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in stretches(rows, col):
                if last is not None and (size >= hold or rows[lo] != last + 1):
                    yield from flush()
                    last = None
                if last is None:
                    first, size = int(rows[lo]), 0
                part = col.slice(lo, hi - lo)
                tokens, before, at = sequences(part)
                own = train[lo:hi].astype(np.int64)
                each = np.repeat(own, np.diff(at))
                held[0].append(summed(np.r_[tokens, np.full(hi - lo, BEGIN)], np.r_[each, own]))
                held[1].append(summed(pair_keys(before, tokens), each))
                last, size = int(rows[hi - 1]), size + len(text_bytes(part)[0])
        if last is not None:
            yield from flush()

    return texts.select("row", "text", "held_out").mapInArrow(count, "at long, bucket int, tokens binary, token_counts binary, pairs binary, pair_counts binary")


def probed(counts: DataFrame, buckets: int, base: float, bits_per_event: int, bits: int) -> DataFrame:
    """(at, bucket, token_levels, token_counts, pair_levels, tokens, distinct): the answer to each message of a bucket, from the
    segment of the filter that all its messages give; tokens and distinct count a bucket's training tokens in its first row."""
    edges = bucket_edges(buckets)

    def build(group: pa.Table) -> pa.Table:
        levels, b = Levels(base), group["bucket"][0].as_py()
        found = []
        for name in ("token", "pair"):
            k = [np.cumsum(unplanes(x)) + edges[b] for x in group[f"{name}s"].to_pylist()]
            c = [unsmall(x) for x in group[f"{name}_counts"].to_pylist()]
            at = np.cumsum([0, *map(len, k)])
            keys, place = np.unique(np.concatenate(k), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, place, np.concatenate(c))
            found.append((keys, total, place, at))
        (k1, c1, *_), (k2, c2, *_) = found
        k, c = np.r_[k1, k2], np.r_[c1, c2]
        words = segment(k[c > 0], c[c > 0], levels, bits_per_event, bits)
        probe = LogFrequencyFilter(bucket_edges(1), np.array([0, len(words)]), words, levels, bits)
        real = (k1 != BEGIN) & (c1 > 0)
        answers = [[values[place[i:j]] for i, j in zip(at[:-1], at[1:], strict=True)] for (_, _, place, at), values in ((found[0], probe.level(k1)), (found[0], np.where(real, c1, 0)), (found[1], probe.level(k2)))]
        once = lambda x: pa.array([int(x)] + [0] * (len(group) - 1), pa.int64())
        return pa.table(
            {"at": group["at"], "bucket": group["bucket"], "token_levels": pa.array(map(small, answers[0]), pa.binary()), "token_counts": pa.array([planes(x.astype(np.uint64)) for x in answers[1]], pa.binary()), "pair_levels": pa.array(map(small, answers[2]), pa.binary()), "tokens": once(c1[real].sum()), "distinct": once(real.sum())}
        )

    return counts.groupBy("bucket").applyInArrow(build, "at long, bucket int, token_levels binary, token_counts binary, pair_levels binary, tokens long, distinct long")


#: Smoothing weights to choose from.
GRID = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0, float(1 << 20))


class Model:
    """What scoring needs: totals, smoothing, and quantised counts."""

    def __init__(self, n: int, v: int, k: float):
        self.n, self.v, self.k = n, v, k

    def logs(self, before, tokens, pair, spare: float = 0.0) -> np.ndarray:
        """log10 p of each token from quantised counts; spare is taken off counts of rows that were trained on."""
        c1, c0 = np.maximum(tokens - spare, 0), np.maximum(before - spare, 0)
        c2 = np.maximum(np.minimum(pair, np.minimum(tokens, before)) - spare, 0)
        p = (c1 + 1) / (self.n + self.v + 1)
        return np.log10((c2 + self.k * p) / (c0 + self.k))


def sums_by_weight(levels: np.ndarray, mean: np.ndarray, prev: np.ndarray, first: np.ndarray, pair: np.ndarray, at: np.ndarray, n: int, v: int, spare: float = 0.0) -> np.ndarray:
    """Summed log10 p of every row (columns) under every weight of the grid (rows). Logarithms are taken once for each
    distinct triple of levels."""
    top = int(levels.max()) + 1
    a, b, c = levels[prev], levels[first], levels[pair]
    triples, place = np.unique((a * top + b) * top + np.minimum(c, np.minimum(a, b)), return_inverse=True)
    a, b, c = mean[triples // (top * top)], mean[triples // top % top], mean[triples % top]
    return np.stack([np.add.reduceat(Model(n, v, k).logs(a, b, c, spare)[place], at[:-1]) for k in GRID])


def chosen(rows: DataFrame) -> int:
    """Place in the grid of the weight with the best leave-one-out likelihood on all trained rows, summed exactly; the middle one without any."""
    sums = rows.where(~F.col("held_out")).agg(*[F.sum(F.col("fits")[i].cast("decimal(38,6)")) for i in range(len(GRID))]).first()
    return len(GRID) // 2 if sums[0] is None else max(range(len(GRID)), key=lambda i: (sums[i], -i))


def score(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_out: Column | None = None, base: float = 1.5, bits_per_event: int = 12, bits: int = 5,
    frequent: int = 1 << 17, broadcast_bytes: int = 256 << 20,
) -> DataFrame:
    """Scores every row after learning from those that `held_out` does not mark.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score, smoothing. Counts and smoothing weight come
    from all training rows. `frequent` and `broadcast_bytes` bounded broadcasts that are no longer made; they change nothing.
    """
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), held_out.alias("held_out"))
    buckets = 4 * scan_tasks(docs)
    texts = staged(docs.withColumn("row", F.monotonically_increasing_id()), "lm-texts")
    answers = staged(probed(ngram_counts(texts, buckets), buckets, base, bits_per_event, bits), "lm-answers")
    n, v = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("distinct")).first())

    # each row's stretch is the last that begins at it or before, in the file that numbers it; a number for every 8 MB of text
    starts = answers.groupBy(F.shiftright("at", 33).alias("file")).agg(F.collect_set("at").alias("starts"))
    placed = texts.withColumn("file", F.shiftright("row", 33)).join(F.broadcast(starts), "file")
    placed = placed.select("id", "text", "held_out", F.array_max(F.filter("starts", lambda x: x <= F.col("row"))).alias("at"))
    asked = answers.select("at", "bucket", "token_levels", "token_counts", "pair_levels")
    rows = staged(placed.groupBy("at").cogroup(asked.groupBy("at")).applyInArrow(_scorer(n, v, base), _ROWS), "lm-rows")
    best = chosen(rows)
    return rows.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), F.col("scores")[best].alias("score"), F.lit(GRID[best]).alias("smoothing"),
    )


_ROWS = "id long, held_out boolean, n_tokens long, n_known long, base double, scores array<double>, fits array<double>"


def _lists(sums: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """The columns as lists, null where marked."""
    some = sums if missing is None else sums[:, ~missing]
    sizes = np.full(sums.shape[1], len(sums)) if missing is None else np.where(missing, 0, len(sums))
    mask = None if missing is None else pa.array(missing)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(some.T.ravel()), mask=mask)


def _scorer(n: int, v: int, base_: float):
    """The texts of a stretch, in any order, and the answers to its messages, to rows of scores."""
    mean = Levels(base_).mean

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, answers = texts.combine_chunks(), answers.sort_by("bucket")
        col = texts["text"].chunk(0)
        parts, tokens, pairs = [], [np.array([BEGIN])], []
        for lo, hi in slices(col):
            own, before, at = sequences(col.slice(lo, hi - lo))
            parts.append((lo, hi, at))
            tokens.append(own)
            pairs.append(pair_keys(before, own))
        # sorted as they were sent
        k1, first = np.unique(np.concatenate(tokens), return_inverse=True)
        k2, pair = np.unique(np.concatenate(pairs), return_inverse=True)
        del tokens, pairs
        one, two = (np.concatenate([unsmall(x) for x in answers[f"{name}_levels"].to_pylist()]) for name in ("token", "pair"))
        if (len(one), len(two)) != (len(k1), len(k2)):
            raise ValueError("a stretch of texts was read otherwise than when it was counted")
        levels = np.r_[one, two]
        counts = np.concatenate([unplanes(x) for x in answers["token_counts"].to_pylist()])
        logs, begin, first = np.log10(counts + 1.0), first[0], first[1:]
        out, done = [], 0
        for lo, hi, at in parts:
            own, both = first[done : done + at[-1]], pair[done : done + at[-1]] + len(k1)
            done += at[-1]
            prev = np.empty(len(own), np.int64)
            prev[1:] = own[:-1]
            prev[at[:-1]] = begin
            held = texts["held_out"].chunk(0).slice(lo, hi - lo)
            scores = sums_by_weight(levels, mean, prev, own, both, at, n, v)
            fits = sums_by_weight(levels, mean, prev, own, both, at, n, v, 1.0)
            known = np.add.reduceat((counts[own] > 0).astype(np.int64), at[:-1])
            out.append(
                pa.RecordBatch.from_arrays(
                    [texts["id"].chunk(0).slice(lo, hi - lo), held, pa.array(np.diff(at)), pa.array(known), pa.array(np.add.reduceat(logs[own], at[:-1])), _lists(scores), _lists(fits, held.to_numpy(zero_copy_only=False).astype(bool))],
                    ["id", "held_out", "n_tokens", "n_known", "base", "scores", "fits"],
                )
            )
        return pa.Table.from_batches(out)

    return run
