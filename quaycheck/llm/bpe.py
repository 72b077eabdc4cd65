"""Byte-pair encoding and decoding with word ends, by contiguous arrays of ranks.

A word's part boundaries and the ranks of its adjacent parts lie in two short arrays. The smallest rank (leftmost of
equal ones) is found by a scan, the boundary behind it deleted, and the ranks left and right of it refreshed, until no
pair is in the merge list. Distinct words of one length are handled together, a row each, so a scan is one array
operation. Words longer than `SHORT` bytes use a heap of pairs over linked parts instead, as scans would be quadratic.

Each distinct word of a task is encoded once and its ids and decoded form remembered. The vocabulary's own rules
come first: special tokens stand for themselves, the text around them is composed (NFC), lower-cased sign by sign and
cut into words, single number signs and other runs, white space dropped.

Null text counts as empty and gives no ids. Repeated rows and null ids are kept as they are; an empty table gives
no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaycheck.llm.pieces import MARK, cut, distinct_bytes
from quaycheck.llm.words import slices

SHORT = 48
NONE = np.int64(1 << 40)
#: Distinct words, and bytes of them, a worker remembers before it starts anew.
MEMORY, HELD = 500_000, 32 << 20
#: Fixed value: the only cut of words this module knows; a file with another one is refused.
WORD_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a tokenizer file, as arrays."""

    def __init__(self, config: str):
        read = json.loads(config)
        model, added = read["model"], read.get("added_tokens") or []
        steps = [n["type"] for n in (read.get("normalizer") or {}).get("normalizers", [])]
        cuts = (read.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = steps == ["NFC", "Replace", "Lowercase"] and cuts and cuts[0].get("pattern", {}).get("Regex") == WORD_CUT
        if not known or model["type"] != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("the tokenizer file has rules other than NFC, lower case and the known cut of words")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in added}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + end] for s in signs], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def alike(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, a row of bytes each: (which rows, their parts) as they are finished."""
        rows = np.arange(len(words))
        parts = np.concatenate([self.inner[words[:, :-1]], self.last[words[:, -1:]]], 1)
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while len(rows):
            width = parts.shape[1]
            if width == 1:
                yield rows, parts
                return
            at = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), at]
            over = low == NONE
            if over.any():
                yield rows[over], parts[over]
                go = ~over
                rows, parts, ranks, at, low = rows[go], parts[go], ranks[go], at[go], low[go]
                if not len(rows):
                    return
            i = np.arange(len(rows))
            parts[i, at] = self.made[low]
            column = np.arange(width - 1)
            parts = np.take_along_axis(parts, column + (column > at[:, None]), 1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            if width > 2:
                left, right = at > 0, at < width - 2
                ranks[i[left], at[left] - 1] = self.rank(parts[i[left], at[left] - 1], parts[i[left], at[left]])
                ranks[i[right], at[right]] = self.rank(parts[i[right], at[right]], parts[i[right], at[right] + 1])

    def long(self, word: bytes) -> list[int]:
        """A word of any length: pairs in a heap by rank and place, parts linked to their neighbours."""
        raw = np.frombuffer(word, np.uint8)
        first = np.r_[self.inner[raw[:-1]], self.last[raw[-1:]]]
        parts, n = first.tolist(), len(raw)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.rank(first[:-1], first[1:])
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(ranks.tolist()) if r < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    r = int(self.rank(np.array([parts[x]]), np.array([parts[y]]))[0])
                    if r < NONE:
                        heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; no word may be empty."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            some = order[lo:hi]
            size = int(lengths[some[0]])
            if size > SHORT:
                for i in some.tolist():
                    out[i] = self.long(words[i])
                continue
            block = np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8).reshape(-1, size)
            for rows, parts in self.alike(block):
                for i, ids in zip(some[rows].tolist(), parts.tolist(), strict=True):
                    out[i] = ids
        return out


class WordMemory:
    """For each distinct word: number of ids, ids as decimal text, and decoded text."""

    def __init__(self, config: str):
        self.merges = Merges(config)
        self.special = tuple(sorted(self.merges.special, key=len, reverse=True))
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.size: list[int] = []
        self.ids: list[bytes] = []
        self.text: list[bytes] = []

    def normal(self, text: str) -> str:
        """Composed and in lower case, but for special tokens. White space is dropped later and so left alone."""

        def plain(t: str) -> str:
            if t.isascii():
                return t.lower()
            return unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()  # a final sigma is not told apart

        if not any(s in text for s in self.special):
            return plain(text)
        out, rest = [], text
        while rest:
            found = [(rest.find(s), s) for s in self.special if s in rest]
            at, s = min(found, default=(len(rest), ""))
            out += [plain(rest[:at]), s]
            rest = rest[at + len(s) :]
        return "".join(out)

    def texts(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Places in memory of the words of all texts, and where each text starts (n + 1 values)."""
        if len(self.place) > MEMORY or self.held > HELD:
            self.forget()
        joined, begin, end, kind, first = cut([self.normal(t) for t in texts], self.special, False)
        words, back = distinct_bytes(joined, begin, end, kind)
        new = [w for w in words if w not in self.place]
        if new:
            ids = self.merges.encode([w if w[:1] != MARK else b"x" for w in new])
            for j, w in enumerate(new):
                if w[:1] == MARK:
                    ids[j] = [self.merges.special[w[1:].decode()]]
            token = self.merges.token
            self.place.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self.held += sum(map(len, new))
            self.size += map(len, ids)
            self.ids += [" ".join(map(str, x)).encode() for x in ids]
            self.text += [" ".join([token[i] for i in x]).encode() for x in ids]
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[back].tolist(), first


_made: dict[int, WordMemory] = {}


def memory_of(config: str) -> WordMemory:
    """One per worker process and file, kept between tasks."""
    key = zlib.crc32(config.encode())
    if key not in _made:
        _made.clear()
        _made[key] = WordMemory(config)
    return _made[key]


def encode_decode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Each text's ids and what they decode to: (id, n_tokens, ids array<int>, decoded), or with `digests` their SHA-256
    instead, of the decimal ids joined by one space and of the decoded text."""
    config = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kinds = ("string", "string") if digests else ("array<int>", "string")
    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(batches):
        memory = memory_of(config.value)
        for batch in batches:
            col = batch.column(1)
            for lo, hi in slices(col):
                places, first = memory.texts([t or "" for t in col.slice(lo, hi - lo).to_pylist()])
                n, ids, decoded = [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = places[a:b]
                    n.append(sum([memory.size[i] for i in own]))
                    x, y = b" ".join([memory.ids[i] for i in own]), b" ".join([memory.text[i] for i in own])
                    ids.append(hashlib.sha256(x).hexdigest() if digests else [int(i) for i in x.split()])
                    decoded.append(hashlib.sha256(y).hexdigest() if digests else y.decode())
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"{id_col} long, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}")
