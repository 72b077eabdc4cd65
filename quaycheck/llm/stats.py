"""Rule statistics of whole texts, many at once: counts of words, signs, repeated lines and repeated word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quaycheck.llm.words import GAP, hashes, mix, runs, slices, spans, text_bytes

#: The signs counted as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_letters", "n_stops", "n_marks", "n_same_words")


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _STOP, _MARK = _table(SYMBOLS), _table(b".,;:"), _table(b"!?")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]))
_HEAD = ~_table(bytes(range(0x80, 0xC0)))


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _later(keys: np.ndarray) -> np.ndarray:
    """Marks every value but the first of its kind, in order."""
    _, first = np.unique(keys, return_index=True)
    out = np.ones(len(keys), bool)
    out[first] = False
    return out


def _own(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(text.astype(np.uint64) + np.uint64(1)))


def _repeated(h: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """Words that lie in a window of so many words found twice or more in their text."""
    n = len(h)
    if n < window:
        return np.zeros(n, bool)
    text = np.repeat(np.arange(len(words) - 1), np.diff(words))
    inside = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    keys = _own(runs(h, window)[inside], text[inside])
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    hit = inside[count[back] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeated lines and lines with a word in each text."""
    breaks = np.flatnonzero(raw == 0x0A)
    starts, ends = np.sort(np.r_[at[:-1], breaks + 1], kind="stable"), np.sort(np.r_[breaks, at[1:]], kind="stable")
    filled = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~GAP[raw], out=filled[1:])
    has = filled[ends] > filled[starts]
    starts, ends = starts[has], ends[has]
    text = np.searchsorted(at, starts, "right") - 1
    again = _later(_own(hashes(raw, starts, ends), text))
    return np.bincount(text[again], minlength=len(at) - 1), np.bincount(text, minlength=len(at) - 1)


def counts(col: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every value; null is empty. n_same_words counts words equal to an earlier word of the text beside it."""
    parts = []
    for lo, hi in slices(col):
        raw, at = text_bytes(col.slice(lo, hi - lo))
        starts, ends, words = spans(raw, at)
        h = hashes(raw, starts, ends)
        chars = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_HEAD[raw], out=chars[1:])
        per_word = np.r_[0, np.cumsum(chars[ends] - chars[starts])]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[words[:-1][words[:-1] < len(h)]] = False
        dup, lines = _lines(raw, at)
        parts.append(
            (np.diff(words), np.diff(per_word[words]), _per_text(_SYMBOL[raw], at), dup, _per_text(_repeated(h, words, 8), words), lines, _per_text(_HEAD[raw], at), _per_text(_UPPER[raw], at), _per_text(_LETTER[raw], at), _per_text(_STOP[raw], at), _per_text(_MARK[raw], at), _per_text(same, words))
        )
    return {k: np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]).astype(np.int64) for i, k in enumerate(COUNTS)}


RATIOS = ("word_length", "symbols", "dup_lines", "repeats", "upper", "stops", "marks", "same_words", "letters")


def ratios(c: dict[str, np.ndarray]) -> np.ndarray:
    """The RATIOS of each text, which do not depend on its length."""
    words, chars, letters = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_letters"))
    return np.stack(
        [c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_upper"] / letters, c["n_stops"] / words, c["n_marks"] / words, c["n_same_words"] / words, c["n_letters"] / chars], 1
    )
