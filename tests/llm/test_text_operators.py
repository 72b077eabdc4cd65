"""Scoring, packing, rules, encoding and near-duplicates against plain Python, with odd rows and empty tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quaycheck.llm import bpe, lm_score, minhash_dedup, packing, pieces, quality_rules, stats
from quaycheck.llm import words as words_of
from quaycheck.llm.common import planes, unplanes
from tests.llm.conftest import ODD, sentence

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (Path(public_tokenizers.path(n)).read_text() for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- scoring


def test_scores_base_and_held_out(spark, odd_docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = lm_score.score(odd_docs, held_out=held).collect()
    tokens = lambda t: words((t or "").translate(LOWER)) + [None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in ODD if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, *_ in ODD)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_routed_probes_give_the_broadcast_scores(spark):
    docs = spark.createDataFrame([(i, sentence(i % 9, 30 + i)) for i in range(40)], "doc_id long, text string")
    held = F.col("doc_id") % 5 == 0
    a = lm_score.score(docs, held_out=held).orderBy("doc_id").collect()
    assert a == lm_score.score(docs, held_out=held, broadcast_bytes=0).orderBy("doc_id").collect()
    assert sum(r.score for r in a if r.held_out) > sum(r.base_score for r in a if r.held_out)


def test_smoothing_is_chosen_on_all_of_all_training_rows(spark):
    rng = random.Random(4)
    texts = ["the same few words " * 432 + " ".join(f"w{rng.randrange(50)}" for _ in range(2500)) for _ in range(3)]
    levels = lm_score.Levels(1.5)

    def best(own):
        seen = [[None, *words(t), ""] for t in own]
        all_ = [[None, *words(t), ""] for t in texts]
        one, two = Counter(w for t in all_ for w in t), Counter(p for t in all_ for p in zip(t, t[1:], strict=False))
        n, v = sum(map(len, all_)) - len(texts), len(one) - 1
        at = lambda c: levels.mean[levels.of(np.array(c))]
        pairs = [p for t in seen for p in zip(t, t[1:], strict=False)]
        args = at([one[a] for a, _ in pairs]), at([one[b] for _, b in pairs]), at([two[p] for p in pairs]), 1.0
        return max(lm_score.GRID, key=lambda k: lm_score.Model(n, v, k).logs(*args).sum())

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert best(texts) != best([t[:8192] for t in texts])
    assert {r.smoothing for r in lm_score.score(docs).collect()} == {best(texts)}


def test_filter_answers_levels_of_all_counts():
    levels = lm_score.Levels(1.5)
    keys = np.arange(1, 3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.random.default_rng(1).integers(1, 500, 3000)
    words_ = lm_score.segment(keys, counts, levels, 12, 5)
    f = lm_score.LogFrequencyFilter(lm_score.bucket_edges(1), np.array([0, len(words_)]), words_, levels, 5)
    assert (f.level(keys) >= levels.of(counts)).all()  # never less than entered
    assert (f.level(keys) == levels.of(counts)).mean() > 0.97
    assert (f.level(keys + np.uint64(1)) > 0).mean() < 0.04  # false hits


def test_filter_stays_in_its_segments(spark, monkeypatch):
    sent = []
    keep = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or keep(self, value))
    docs = spark.createDataFrame([(i, sentence(i % 9, 30 + i)) for i in range(40)], "doc_id long, text string")
    assert len(lm_score.score(docs).collect()) == 40 and not sent


def test_stretches_of_any_size_give_the_same_scores(spark, monkeypatch):
    rows = [(i, sentence(i % 9, 30 + i)) for i in range(60)] + [(3, None), (3, ""), (None, "one two"), (3, None)] + [(70, "same words here")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 5 == 0
    plain = lambda: sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9), r.smoothing) for r in lm_score.score(docs, held_out=held).collect())
    large, counts, seen = plain(), lm_score.ngram_counts, []
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def short(texts, buckets):
        seen.append(counts(texts, buckets, hold=300))
        return seen[-1]

    monkeypatch.setattr(lm_score, "ngram_counts", short)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        assert len(large) == len(rows) and plain() == large
        sent = seen[0].collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len({r.at for r in sent}) > 10 and len({(r.at, r.bucket) for r in sent}) == len(sent)
    assert [*lm_score.stretches(np.array([1, 2, 5, 6, 7]), pa.array(["a"] * 5))] == [(0, 2), (2, 5)]


def test_numbers_come_back_from_planes():
    a = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert (unplanes(planes(a)) == a).all() and not len(unplanes(planes(a[:0])))


def test_scores_of_empty_table(no_docs):
    assert lm_score.score(no_docs).collect() == []


# ---- packing


def unpacked(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return by


@pytest.mark.parametrize("size", [2048, 16])
def test_packs_every_token_once(odd_docs, size):
    rows = packing.pack(odd_docs, BYTE, size=size, keep_ids=True).collect()
    by = unpacked(rows, size)
    t = Tokenizer.from_str(BYTE)
    want = Counter()
    for i, text, *_ in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at, stop, piece = 0, len(ids) % size or size, 0
        while at < len(ids):
            part = ids[at:stop]
            want[(i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
            at, stop, piece = stop, stop + size, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == want
    assert len(by) <= 1.1 * -(-sum(r.length for r in rows) // size) + 1


def test_plan_uses_exact_complements():
    steps = packing.plan({9: 2, 1: 1, 6: 3, 4: 1, 3: 2, 2: 1, 10: 2}, 10)
    assert sum(sum(p) * n for p, n in steps) == 18 + 1 + 18 + 4 + 6 + 2 + 20
    assert sum(n for p, n in steps if sum(p) == 10) >= 4
    used = Counter()
    for p, n in steps:
        for x in p:
            used[x] += n
    assert used == Counter({9: 2, 1: 1, 6: 3, 4: 1, 3: 2, 2: 1, 10: 2})


def first_fit_decreasing(lengths, size):
    room = []
    for x in sorted(lengths, reverse=True):
        for i, r in enumerate(room):
            if r >= x:
                room[i] -= x
                break
        else:
            room.append(size - x)
    return len(room)


def test_plan_is_about_as_good_as_first_fit_decreasing():
    rng = random.Random(3)
    for _ in range(5):
        lengths = [rng.randint(1, 64) for _ in range(1500)]
        steps = packing.plan(dict(Counter(lengths)), 64)
        assert all(sum(p) <= 64 for p, _ in steps) and sum(n for _, n in steps) <= 1.01 * first_fit_decreasing(lengths, 64) + 1


def test_pack_empty_table(no_docs):
    assert packing.pack(no_docs, BYTE).collect() == []


PARTS = ["a", "B", "é", "'", "'s", "'ll", "'re", "'x", " ", "  ", "\n", "\t", " \n", "5", "½", "!", "<|endoftext|>", "<|startoftext|>", "日", "́", " ", "\x1c", "don't", "I'VE", "😀", "''s", "Σ", "İ", "th" * 40, "ABCDEFGHIJ" * 7]


def test_pieces_equal_the_tokenizer():
    rng, t, mine = random.Random(5), Tokenizer.from_str(BYTE), packing.Pieces(BYTE)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    flat, at = mine.ids_of(texts)
    for i, text in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


# ---- encoding


def test_rank_arrays_equal_the_tokenizer(spark):
    rng, t = random.Random(6), Tokenizer.from_str(WORD)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(1200)] + [x[1] for x in ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = {r.doc_id: r for r in bpe.encode_decode(docs, WORD).collect()}
    digests = {r.doc_id: r for r in bpe.encode_decode(docs, WORD, digests=True).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (full[i].ids, full[i].decoded, full[i].n_tokens) == (ids, decoded, len(ids)), repr(text)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_short_and_long_words_merge_alike():
    m = bpe.Merges(WORD)
    some = [w.encode() for w in ("thermometer", "aaaaaaaaaaaa", "x", "internationalisation", "ﬁ", "zzzzzzzzzzzzzzzzz")]
    assert m.encode(some) == [m.long(w) for w in some]


def test_unknown_rules_are_refused():
    other = json.loads(WORD)
    other["normalizer"] = None
    with pytest.raises(ValueError):
        bpe.Merges(json.dumps(other))


def test_encode_empty_table(no_docs):
    assert bpe.encode_decode(no_docs, WORD).collect() == []


# ---- quality rules


def brute_rules(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_rule_statistics(spark, odd_docs, labels):
    extra = ["a b\na b\n\n \n \na b ", "x " * 9, "x " * 8 + "y " + "x " * 8, "#*$ %&|<> é#\n#", "w\n" * 40]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = [x[1] for x in ODD] + extra
    rows = quality_rules.judge(docs, labels).collect()
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter(map(brute_rules, texts))
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_forest_finds_the_odd_one():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (500, 3)), [[9, -9, 9]]]
    f = quality_rules.Forest(x, 64, 128, 1)
    s = f.score(x)
    assert s.argmax() == 500 and s[500] > np.quantile(s[:500], 0.99)


def test_threshold_keeps_good_rows():
    good, bad = np.array([90, 9, 1, 0]), np.array([0, 5, 5, 10])
    assert quality_rules.threshold(good, bad, 0.99) == 0.5
    assert quality_rules.threshold(good, bad * 0, 0.99) == np.inf


def test_rules_of_empty_table(no_docs, labels):
    assert quality_rules.judge(no_docs, labels).collect() == []


def test_counts_are_of_each_text():

    c = stats.counts(pa.array(["A b", None, "b!", "b b"]))
    assert c["n_upper"].tolist() == [1, 0, 0, 0] and c["n_same_words"].tolist() == [0, 0, 0, 1] and c["n_marks"].tolist() == [0, 0, 1, 0]


# ---- near-duplicates


def brute_components(rows):
    sets = []
    for _, text, *_ in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    names = {k: min((r[0] for r, x in zip(rows, label, strict=True) if x == k and r[0] is not None), default=None) for k in set(label)}
    return sorted((-1 if r[0] is None else r[0], len(s), -1 if names[x] is None else names[x]) for r, s, x in zip(rows, sets, label, strict=True))


def near_copies():
    base = sentence(50, 90).split()
    rows = [(1000 + i, " ".join(w if (j * 31 + i * 17) % 101 > i % 9 else f"new{i}x{j}" for j, w in enumerate(base))) for i in range(120)]
    rows += [(2000 + i, sentence(60 + i % 3, 50) + " tail" + str(i % 2)) for i in range(12)]
    return rows + [(3000, "Four words ARE here"), (3001, "four words are here"), (3002, "four words here"), (3003, "x"), (3004, "X")]


def test_components_equal_brute_force(spark, odd_docs):
    for rows, docs in ((near_copies(), None), ([x for x in ODD], odd_docs)):
        docs = docs if docs is not None else spark.createDataFrame(rows, "doc_id long, text string")
        got = minhash_dedup.near_duplicates(docs).collect()
        mine = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got)
        assert mine == brute_components(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_pruning_follows_the_posterior():
    least = minhash_dedup.least_agreements(25, 10, 0.75, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.75 * 250
    # P(Binomial(251, 0.75) <= m - 1) is below the miss probability, and not at m
    tail = lambda m, n: sum(math.comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(m + 1))
    assert tail(least[-1] - 1, 251) < 1e-6 <= tail(least[-1], 251)


def test_near_duplicates_of_empty_table(no_docs):
    assert minhash_dedup.near_duplicates(no_docs).collect() == []


# ---- words that sums of powers cannot tell apart


def thue_morse(n: int, flip: bool) -> str:
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


TWINS = [(2 * k + flip, " ".join(["calm harbour", thue_morse(n, flip), "grey gulls over", sentence(5, 30)])) for k, n in enumerate((512, 1024, 2048, 4096, 8192)) for flip in (False, True)]


@pytest.fixture(scope="module")
def twins(spark):
    return spark.createDataFrame(TWINS, "doc_id long, text string")


def test_hashes_tell_twins_apart():
    texts = pa.array([t for _, t in TWINS])
    h, at = words_of.word_hashes(texts)
    assert len({int(h[a + 2]) for a in at[:-1]}) == len(TWINS)
    rng = random.Random(3)
    some = list({"".join(rng.choice("abc") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(20_000)})
    h, _ = words_of.word_hashes(pa.array([" ".join(some)]))
    assert len(set(h.tolist())) == len(some) == len(h)
    again, _ = words_of.word_hashes(pa.array(["x " * 37 + " ".join(reversed(some))]))
    assert again[37:].tolist()[::-1] == h.tolist()  # wherever a word stands


def test_twins_keep_their_own_ids(spark, twins):
    tok = Tokenizer.from_str(WORD)
    tok.no_truncation()
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_decode(twins, WORD).collect()}
    assert got == {i: (ids := tok.encode(t, add_special_tokens=False).ids, tok.decode(ids, skip_special_tokens=False)) for i, t in TWINS}
    tok = Tokenizer.from_str(BYTE)
    rows = packing.pack(twins, BYTE, keep_ids=True).collect()
    for i, t in TWINS:
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece) for x in r.ids]
        assert ids == [*tok.encode(t, add_special_tokens=False).ids, 0]


def test_twins_are_other_words_lines_and_shingles(spark, twins):
    got = {r.doc_id: r for r in lm_score.score(twins, held_out=F.col("doc_id") % 2 == 1).collect()}
    for i, t in TWINS:  # the odd twin's long word was never seen
        assert got[i].n_tokens - got[i].n_known == (1 if i % 2 else 0)
    lines = pa.array([a + "\n" + b for (_, a), (_, b) in zip(TWINS[::2], TWINS[1::2], strict=True)])
    assert stats.counts(lines)["n_dup_lines"].tolist() == [0] * 5
    short = spark.createDataFrame([(i, "one two " + t.split()[2] + " four five") for i, t in TWINS], "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in minhash_dedup.near_duplicates(short).collect())


def test_pieces_under_one_hash_are_told_apart(monkeypatch):
    text = "one two three two one <|endoftext|> " + "x" * 100 + " " + "x" * 99 + "y"
    found, back = pieces.distinct_bytes(*pieces.cut([text], ("<|endoftext|>",), True)[:4])
    whole = [found[i] for i in back]
    monkeypatch.setattr(pieces, "hashes", lambda raw, lo, hi: np.zeros(len(lo), np.uint64))
    found, back = pieces.distinct_bytes(*pieces.cut([text], ("<|endoftext|>",), True)[:4])
    assert [found[i] for i in back] == whole and len(found) == len(set(whole))
    assert b"".join(whole).replace(pieces.MARK, b"").decode() == text
