"""Encoding and decoding with merge-type SentencePiece vocabularies, by a score-ordered agenda of adjacent symbol pairs.

A text's signs are symbols. The agenda holds each pair of neighbours that is a piece of the vocabulary, highest score
first, leftmost of equal ones. The top is taken; if both its symbols are still what they were, they become one, and the
pairs it forms with its neighbours are entered. What is left when the agenda is empty are the pieces; a sign without a
piece is spelled by its bytes.

Between two signs that stand side by side in no piece nothing is ever merged, so texts are cut there first, many texts in
one array operation; a part's pieces do not depend on what surrounds it. Distinct parts are encoded once per worker and
looked up by the part itself.

Each slice of an Arrow batch is checked against the sentencepiece library: it must give the same ids for every part
that the slice was the first to have, and decode all ids to the same texts, or the job fails and names what differs. As no
merge crosses a cut, that covers whole texts; tests compare those as well. `check=False` leaves the check out.

Null and empty texts have no ids but begin and end. Repeated rows and null ids are kept as they are; an empty table
gives no rows; other columns are left out. A model with other rules than byte fallback over unchanged text (its own
normalisation, user-defined or unused pieces, white space trimmed) is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaycheck.llm.words import slices

SPACE = "▁"
#: Signs a worker's memory of distinct parts holds before it starts anew; each part counts for SLOT more.
MEMORY, SLOT = 48_000_000, 40
#: Bits of an agenda entry that hold the place: short parts have small numbers, a text has at most 2^31 bytes.
SHORT, LONG = (1 << 14) - 1, (1 << 32) - 1
#: One of these signs has to stand in no piece but alone; it parts what is checked together.
APART = "\n\x00\ue000"
#: Kinds of pieces, the merge type, and fields of the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, SPACE_LAST = 3, 35, 24
CHARSMAP, DUMMY_PREFIX, TRIM, ESCAPE = 2, 3, 4, 5


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 2: -1, 5: 4}[wire]
        size = varint() if size < 0 else size
        yield key >> 3, message[at : at + size]
        at += size


class Parts(dict):
    """Ids of the parts met so far; a new one is encoded when it is asked for, and stays in `fresh` until it has been
    checked. `size` is what they hold, in signs."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.size = encode, 0
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> bytes:
        self[part] = ids = self.encode(part)
        self.size += SLOT + len(part)
        self.fresh.append(part)
        return ids


class Vocabulary:
    """Pieces, scores and rules of a model file; encodes and decodes single texts."""

    def __init__(self, model: bytes):
        read = list(fields(model))
        trainer, rules = ({k: v for f, m in read if f == part for k, v in fields(m)} for part in (TRAINER, NORMALIZER))
        if trainer.get(MODEL_TYPE, 1) != MERGES or not trainer.get(BYTE_FALLBACK) or trainer.get(SPACE_LAST) or rules.get(CHARSMAP) or rules.get(TRIM, 1) or not rules.get(ESCAPE, 1):
            raise ValueError("the model has rules other than merges with byte fallback over unchanged text")
        self.prefix = SPACE if rules.get(DUMMY_PREFIX, 1) else ""
        self.pieces, self.kinds, scores = [], [], []
        for f, m in read:
            if f == PIECES:
                piece = dict(fields(m))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has user-defined or unused pieces")
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.id = {self.pieces[i]: i for i in normal}
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.rank = {place: {self.pieces[i]: order[scores[i]] * (place + 1) for i in normal} for place in (SHORT, LONG)}
        self.byte_value = {i: int(self.pieces[i][1:-1], 16) for i, k in enumerate(self.kinds) if k == BYTE}
        self.byte_id = {b: i for i, b in self.byte_value.items()}
        control = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == CONTROL}
        self.begin, self.end = control["<s>"], control["</s>"]
        self.written = {p: np.array([i], "<u4").tobytes() for p, i in self.id.items()}
        self.spelling = [bytes([self.byte_value[i]]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b"" for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        signs = sorted({c for p in pairs for c in p})
        self.sign = np.zeros(0x110000, np.uint16)  # 0: stands in no piece but alone
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.beside = np.zeros((len(signs) + 1, len(signs) + 1), bool)
        for p in pairs:
            self.beside[self.sign[ord(p[0])], self.sign[ord(p[1])]] = True
        self.apart = next(c for c in APART if not self.sign[ord(c)])
        self.forget()

    def forget(self) -> None:
        """Starts the memory of parts anew: what was found in it is kept by no one else."""
        self.ids = Parts(self.part)

    def merged(self, part: str) -> list[str]:
        """Symbols left of a text when no two neighbours form a piece.

        An entry of the agenda is a number, rank of the score before place of the left symbol. `due` holds the one entry
        of each place that is still true; others are passed over when they come up.
        """
        n = len(part)
        place = SHORT if n <= SHORT else LONG
        get, push, pop = self.rank[place].get, heapq.heappush, heapq.heappop
        due, agenda = [-1] * n, []
        for i in range(n - 1):
            e = get(part[i : i + 2])
            if e is not None:
                due[i] = e = e + i
                agenda.append(e)
        heapq.heapify(agenda)
        symbols, before, after = list(part), list(range(-1, n - 1)), [*range(1, n), -1]
        while agenda:
            entry = pop(agenda)
            i = entry & place
            if due[i] != entry:
                continue
            j, h = after[i], before[i]
            k = after[i] = after[j]
            symbols[i] = new = symbols[i] + symbols[j]
            symbols[j] = ""
            due[i] = due[j] = -1
            if k >= 0:
                before[k] = i
                e = get(new + symbols[k])
                if e is not None:
                    due[i] = e = e + i
                    push(agenda, e)
            if h >= 0:
                due[h] = -1
                e = get(symbols[h] + new)
                if e is not None:
                    due[h] = e = e + h
                    push(agenda, e)
        return [s for s in symbols if s]

    def part(self, part: str) -> bytes:
        """Ids of a part as little-endian 32-bit integers."""
        written = self.written
        return b"".join([written.get(s) or self.by_bytes(s) for s in (self.merged(part) if len(part) > 1 else part)])

    def by_bytes(self, sign: str) -> bytes:
        return np.array([self.byte_id[b] for b in sign.encode()], "<u4").tobytes()

    def cut(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Parts of all texts, and the parts before each text (n + 1 values)."""
        marked = [self.prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(marked)
        at = np.r_[0, np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))].astype(np.int64)
        sign = self.sign[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        begins = np.ones(len(joined), bool)
        begins[1:] = ~self.beside[sign[:-1], sign[1:]]
        begins[at[at < len(joined)]] = True
        starts = np.flatnonzero(begins)
        ends = [*starts.tolist(), len(joined)]
        return [joined[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], np.searchsorted(starts, at).tolist()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without begin and end, as little-endian 32-bit integers."""
        if self.ids.size > MEMORY:
            self.forget()
        parts, first = self.cut(texts)
        found = list(map(self.ids.__getitem__, parts))
        return [b"".join(found[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]

    def spelled(self, ids: bytes) -> str:
        """Text of the ids of a text: as `decode` where all bytes are whole signs, which they are in what was encoded."""
        text = b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()
        return text[1:] if self.prefix and text[:1] == " " else text

    def decode(self, ids: Iterable[int]) -> str:
        """Text of any ids: begin and end say nothing, an unknown id is a marked question, of the first piece the leading
        space is dropped, bytes that are no UTF-8 become replacement signs, one each."""
        out: list[str] = []
        held = bytearray()
        fresh, dropped = True, False

        def flush() -> None:
            while held:
                try:
                    out.append(held.decode())
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[: e.start].decode() + "�")
                    del held[: e.start + 1]

        for i in ids:
            if i in self.byte_value:
                held.append(self.byte_value[i])
                continue
            flush()
            fresh = fresh and not dropped and not any(out)
            dropped = False
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] == NORMAL:
                piece = self.pieces[i]
                if fresh and self.prefix and piece.startswith(SPACE):
                    piece, dropped = piece[1:], True
                out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)


_made: dict[int, tuple] = {}


def tools_of(model: bytes) -> tuple:
    """Vocabulary and library processor, one pair per worker process and model, kept between tasks."""
    key = zlib.crc32(model)
    if key not in _made:
        import sentencepiece

        _made.clear()
        _made[key] = Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    return _made[key]


def checked(vocabulary: Vocabulary, library, ids: list[bytes], decoded: list[str]) -> None:
    """Fails unless the library gives the same ids for each part encoded since the last check, all of them in one text,
    parted by a sign that nothing is merged with, and decodes all ids to the same texts."""
    parts, vocabulary.ids.fresh = vocabulary.ids.fresh, []
    whole = "".join([vocabulary.apart + p for p in parts]).replace(SPACE, " ")
    (ours,) = vocabulary.encode([whole])
    if library.encode([whole], out_type=int, num_threads=1)[0] != np.frombuffer(ours, "<u4").tolist():
        alone = [p for p in parts if library.encode(vocabulary.apart + p.replace(SPACE, " ")) != np.frombuffer(vocabulary.encode([vocabulary.apart + p])[0], "<u4").tolist()]
        raise ValueError(f"the sentencepiece library gives other ids for {alone[:3]}")
    said = library.decode([np.frombuffer(i, "<u4").tolist() for i in ids], num_threads=1)
    for row, (x, y) in enumerate(zip(said, decoded, strict=True)):
        if x != y:
            raise ValueError(f"the sentencepiece library decodes row {row} of a slice to another text")


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text", digests: bool = False, check: bool = True) -> DataFrame:
    """Each text's ids with begin and end, and what they decode to: (id, n_tokens, ids array<int>, decoded), or with `digests`
    their SHA-256 instead, of the ids as little-endian 32-bit integers and of the decoded text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ("string", "string") if digests else ("array<int>", "string")
    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(batches):
        vocabulary, library = tools_of(held.value)
        begin, end = (np.array([i], "<u4").tobytes() for i in (vocabulary.begin, vocabulary.end))
        for batch in batches:
            col = batch.column(1)
            for lo, hi in slices(col):
                texts = [t or "" for t in col.slice(lo, hi - lo).to_pylist()]
                ids = [begin + i + end for i in vocabulary.encode(texts)]
                decoded = [vocabulary.spelled(i) for i in ids]
                if check:
                    checked(vocabulary, library, ids, decoded)
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                if digests:
                    out = [pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
                else:
                    out = [pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n, *out], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"{id_col} long, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}")


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of arrays of ids as the library decodes them: (id, decoded). A null array has a null text; an id outside
    the vocabulary fails the job."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vocabulary, _ = tools_of(held.value)
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return rows.select(F.col(id_col).cast("long"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"{id_col} long, decoded string")
