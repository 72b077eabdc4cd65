"""Packs documents into as few sequences of `size` tokens as it can, by exact complements and then best fit.

Tokens are made once per distinct piece of a task and cut into lengths; a written table keeps one row per piece of a
document. Planning sees only the histogram of lengths, at most `size` numbers whatever the table's size: for each
length from the largest on, an index of single lengths, of sums of two and of sums of three says which combination
fills the gap exactly; as many sequences are made of a combination as the counts allow. What no combination fills is
packed best fit. Rows are numbered by length within their task and the tasks' counts summed, so that each row finds
its place in the plan without a window over a common length.

Null text is empty: one closing token. A null id and repeated rows are packed as rows of their own. An empty table
gives no rows. Other columns are left out. No token is dropped; only documents longer than `size` are cut, and
the first of their pieces may be shorter.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaycheck.llm.common import staged
from quaycheck.llm.pieces import MARK, cut, distinct_bytes
from quaycheck.llm.words import slices

#: Distinct pieces, and bytes of them, a worker remembers before it starts anew: what bounds its memory.
MEMORY, HELD = 500_000, 32 << 20


def grown(a: np.ndarray, size: int) -> np.ndarray:
    return a if size <= len(a) else np.concatenate([a, np.zeros(max(size - len(a), len(a)), a.dtype)])


class Pieces:
    """Token ids of texts by a tokenizer file; the ids of a piece are found once and remembered.

    A file with another cut than byte-level runs is used as it is, text by text.
    """

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        read = json.loads(config)
        cuts = read.get("pre_tokenizer") or {}
        added = read.get("added_tokens") or []
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        self.by_piece = read.get("normalizer") is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space") and plain
        self.special = tuple(sorted((t["content"] for t in added), key=len, reverse=True))
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.remembered = 0
        self.ids, self.at, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text starts (n + 1 values)."""
        if not self.by_piece:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)
        joined, begin, end, kind, first = cut(texts, self.special, True)
        pieces, back = distinct_bytes(joined, begin, end, kind)
        if len(self.place) > MEMORY or self.remembered > HELD:
            self.forget()
        new = [p for p in pieces if p not in self.place]
        if new:
            words = [p.removeprefix(MARK).decode("utf-8", "replace") for p in new]
            found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids, stops = np.array(found.ids, np.uint32), np.searchsorted(np.array(found.word_ids), np.arange(len(words)), "right")
            held = self.at[self.n]
            self.ids = grown(self.ids, held + len(ids))
            self.ids[held : held + len(ids)] = ids
            self.at = grown(self.at, self.n + len(new) + 1)
            self.at[self.n + 1 : self.n + len(new) + 1] = held + stops
            self.place.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.remembered += sum(map(len, new))
            self.n += len(new)
        index = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))[back]
        start, length = self.at[index], self.at[index + 1] - self.at[index]
        stops = np.r_[0, np.cumsum(length)]
        flat = self.ids[np.repeat(start - stops[:-1], length) + np.arange(stops[-1])]
        return flat, stops[first]


_made: dict[int, Pieces] = {}


def tokenizer_of(config: str) -> Pieces:
    """One per worker process and file, kept between tasks."""
    key = zlib.crc32(config.encode())
    if key not in _made:
        _made.clear()
        _made[key] = Pieces(config)
    return _made[key]


def cut_pieces(docs: DataFrame, tokenizer_json: str, size: int, end_id: int, id_col: str, text: str, keep_ids: bool) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, (ids,) task, and rank among the task's pieces of this length."""
    config = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    fields = f"{id_col} long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * keep_ids + "task int, rank long"

    def run(batches):
        made, seen, task = tokenizer_of(config.value), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            col = batch.column(1)
            for lo, hi in slices(col):
                rows = {k: [] for k in ("id", "piece", "start", "length", "crc", "ids", "rank")}
                flat, at = made.ids_of([t or "" for t in col.slice(lo, hi - lo).to_pylist()])
                for i, key in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    ids = np.r_[flat[at[i] : at[i + 1]], np.uint32(end_id)].astype("<u4")
                    start, stop = 0, len(ids) % size or size
                    for piece in range(-(-len(ids) // size)):
                        part = ids[start:stop]
                        for k, v in (("id", key), ("piece", piece), ("start", start), ("length", len(part)), ("crc", zlib.crc32(part.tobytes())), ("rank", int(seen[len(part)]))):
                            rows[k].append(v)
                        if keep_ids:
                            rows["ids"].append(part.astype(np.int32))
                        seen[len(part)] += 1
                        start, stop = stop, stop + size
                arrays = [pa.array(rows["id"], pa.int64()), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc"))]
                arrays += [pa.array(rows["ids"], pa.list_(pa.int32()))] * keep_ids + [pa.array([task] * len(rows["id"]), pa.int32()), pa.array(rows["rank"], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in fields.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, fields)


class Complements:
    """Available lengths with their counts, and combinations of up to three with a wanted sum."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.known: dict[int, int] = {}

    def has(self, *lengths: int) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, more: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Two available lengths of this sum, the larger one as large as can be; remembered while it lasts."""
        y = self.known.get(total)
        if y is None or (y and not self.has(y, total - y)):
            ys = np.arange((total + 1) // 2, total)
            ok = ys[(self.counts[ys] > 0) & (self.counts[total - ys] > 0)]
            ok = ok[(ok * 2 != total) | (self.counts[ok] > 1)]
            y = self.known[total] = int(ok[-1]) if len(ok) else 0
        return (y, total - y) if y and self.has(*more, y, total - y) else None

    def fill(self, gap: int, first: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside `first` exactly."""
        if self.has(first, gap):
            return (gap,)
        if found := self.pair(gap, (first,)):
            return found
        for z in np.flatnonzero(self.counts[1 : gap - 1])[::-1] + 1:
            if found := self.pair(gap - int(z), (first, int(z))):
                return (int(z), *found)
        return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up the histogram.

    Lengths over half the size take exact complements first; those without one are filled best fit before the shorter
    lengths are combined exactly among themselves; what is left then is packed best fit. Each step uses up at least one
    length, or all but too few of it, so there are at most a few times `size` steps.
    """
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    rest, steps = np.zeros(size + 1, np.int64), []
    index = Complements(counts)

    def take(pool: np.ndarray, pattern: tuple[int, ...]) -> None:
        times = min(int(pool[x]) // pattern.count(x) for x in set(pattern))
        for x in set(pattern):
            pool[x] -= times * pattern.count(x)
        steps.append((pattern, times))

    def exact(lengths: range) -> None:
        for length in lengths:
            while counts[length]:
                more = () if length == size else index.fill(size - length, length)
                if more is None:
                    rest[length] += counts[length]
                    counts[length] = 0
                else:
                    take(counts, (length, *more))

    def best_fit(pool: np.ndarray, first: int) -> tuple[int, ...]:
        pattern, gap, left = [first], size - first, pool.copy()
        left[first] -= 1
        while len(fits := np.flatnonzero(left[: gap + 1])):
            x = int(fits[-1])
            n = min(gap // x, int(left[x]))
            pattern += [x] * n
            left[x] -= n
            gap -= n * x
        return tuple(pattern)

    half = size // 2
    exact(range(size, half, -1))
    for length in range(size, half, -1):
        while rest[length]:
            counts[length] = rest[length]
            take(counts, best_fit(counts, length))
            rest[length], counts[length] = counts[length], 0
    exact(range(half, 0, -1))
    while rest.any():
        take(rest, best_fit(rest, int(np.flatnonzero(rest)[-1])))
    return steps


def places(steps: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: key = length and first rank, first sequence, offset in it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in steps:
        offset = 0
        for x in pattern:
            rows.append((x << 44 | used.get(x, 0), used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    rows.sort()
    out = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("key", "first", "sequence", "offset"), out.T, strict=True))


def pack(docs: DataFrame, tokenizer_json: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and place there; `keep_ids` adds the token ids."""
    pieces = staged(cut_pieces(docs, tokenizer_json, size, end_id, id_col, text, keep_ids), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, size)))
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def put(batches):
        at = where.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(at["key"], length << 44 | rank, "right") - 1
            out = [batch.column(c) for c in columns] + [pa.array(at["sequence"][i] + rank - at["first"][i]), pa.array(at["offset"][i])]
            yield pa.RecordBatch.from_arrays(out, [*columns, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    return ranked.select(*columns, "rank").mapInArrow(put, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long")
