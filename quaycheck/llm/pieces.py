"""Pre-tokenisation of many texts at once: runs of letters, numbers, other signs and white space as array operations.

Two cuts are known, both with the contractions 's 't 're 've 'm 'll 'd as pieces of their own:
`spaced`: a run with one space before it; white space but for its last sign is a piece, numbers stay whole.
`words`: runs without white space; every number sign is a piece.
Special tokens stand alone and end the text before them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

from quaycheck.llm.words import equal, hashes

SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
#: Stands before the bytes of a special token; no text holds this byte.
MARK = b"\xff"
#: Code points of the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pieces start. `first` marks the first sign of each text and special token, and the sign after a special token."""
    n = len(points)
    run = np.ones(n, bool)
    run[1:] = (kinds[1:] != kinds[:-1]) | first[1:]
    out = run.copy()
    if spaced:
        at = np.flatnonzero(run[1:] & ~first[1:] & (kinds[1:] != SPACE) & (kinds[:-1] == SPACE)) + 1
        out[at - 1] = True
        out[at[points[at - 1] == 0x20]] = False
    else:
        out |= kinds == NUMBER
    q = np.flatnonzero(out[:-1] & (points[:-1] == 0x27) & (kinds[:-1] == OTHER) & (kinds[1:] == LETTER) & ~first[1:]) if n > 1 else np.zeros(0, np.int64)
    if len(q):
        padded, joined = np.r_[points, 0, 0, 0], np.r_[~first, False, False, False]
        a, b = padded[q + 1], np.where(joined[q + 2], padded[q + 2], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (b == ord("e")) & np.isin(a, [ord("r"), ord("v")]) | (a == ord("l")) & (b == ord("l"))
        for hit, long in ((one, 2), (two & ~one, 3)):
            at = q[hit]
            out[at + 1] = False
            after = at + long
            out[after[after < n]] = True
    return out


def cut(texts: list[str], special: tuple[str, ...], spaced: bool) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts; starts and ends of pieces in it (code points); their classes; pieces before each text (n + 1 values)."""
    joined = "".join(texts)
    points = code_points(joined)
    n = len(points)
    kinds = classes()[points]
    at = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))].astype(np.int64)
    first = np.zeros(n + 1, bool)
    first[at] = True
    if special and any(s in joined for s in special):
        pattern = re.compile("|".join(map(re.escape, special)))
        for i, text in enumerate(texts):
            for m in pattern.finditer(text):
                lo, hi = at[i] + m.start(), at[i] + m.end()
                kinds[lo:hi] = SPECIAL
                first[[lo, hi]] = True
    first = first[:n]
    begin = np.flatnonzero(starts(points, kinds, first, spaced)) if n else np.zeros(0, np.int64)
    end = np.r_[begin[1:], n].astype(np.int64) if len(begin) else begin
    kind = kinds[np.maximum(end - 1, 0)] if n else np.zeros(0, np.uint8)
    if not spaced:
        keep = kind != SPACE
        begin, end, kind = begin[keep], end[keep], kind[keep]
    return joined, begin, end, kind, np.searchsorted(begin, at)


def byte_spans(joined: str, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the joined texts, and the pieces' starts and ends in bytes."""
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) == len(joined):
        return raw, begin, end
    offsets = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]
    return raw, offsets[begin], offsets[end]


def distinct_bytes(joined: str, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces as UTF-8 bytes, those of special tokens behind a mark, and where each piece is among them.

    Pieces are brought together by hash and then compared; should two differ under one hash, they are told apart by
    their bytes instead.
    """
    raw, lo, hi = byte_spans(joined, begin, end)
    data, special = raw.tobytes(), kind == SPECIAL
    _, where, back = np.unique(hashes(raw, lo, hi) ^ special, return_index=True, return_inverse=True)
    bytes_of = lambda at: [data[a:b] if not s else MARK + data[a:b] for a, b, s in zip(lo[at].tolist(), hi[at].tolist(), special[at].tolist(), strict=True)]
    first = where[back]
    if (special == special[first]).all() and equal(raw, lo, hi, first):
        return bytes_of(where), back
    place: dict[bytes, int] = {}
    back = np.array([place.setdefault(w, len(place)) for w in bytes_of(np.arange(len(lo)))], np.int64)
    return list(place), back
