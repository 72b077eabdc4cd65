"""Pieces against the sentencepiece library; clusters and whitened components against plain Python and numpy."""

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest

from quaycheck.llm import centroids, contour, sentence_pieces, whitening
from tests.llm.conftest import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return sentence_pieces.Vocabulary(MODEL)


# ---- pieces


def test_pieces_of_odd_texts(spark, library, odd_docs):
    got = sentence_pieces.encode_decode(odd_docs, MODEL).collect()
    want = []
    for i, t, *_ in ODD:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i or -1, len(ids), ids, library.decode(ids)))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids, r.decoded) for r in got) == sorted(want)
    digests = sentence_pieces.encode_decode(odd_docs, MODEL, digests=True).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted((i, n, sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for i, n, ids, t in want)


def test_pieces_of_random_texts(vocabulary, library):
    random.seed(11)
    signs = "aabth   ▁▁\n\t\x00é日本語😀<s>İß​﻿�中文字"
    for n in [0, 1, 2, 3, 5, 30, 400] * 60:
        text = "".join(random.choice(signs) for _ in range(n))
        (ids,) = vocabulary.encode([text])
        want = library.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert vocabulary.spelled(ids) == library.decode(want) == vocabulary.decode([vocabulary.begin, *want, vocabulary.end])


def test_long_parts_are_whole(vocabulary, library):
    for text in ("a" * 60_000, " " * 4_001, "日本" * 9_000, "xy" * 300 + "࿿" + "z" * 900):
        assert np.frombuffer(vocabulary.encode([text])[0], "<u4").tolist() == library.encode(text)


def test_a_full_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MEMORY", 3)
    small = sentence_pieces.Vocabulary(MODEL)
    for text in ("one two three four five", "five four three two one", "one"):
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == library.encode(text)
    assert len(small.ids) <= 8


def test_decoding_of_any_ids(spark, vocabulary, library):
    random.seed(12)
    some = lambda: random.choice([0, 1, 2, random.randrange(3, 259), random.randrange(195, 259), 259, 260, random.randrange(32_000)])
    rows = [(k, [some() for _ in range(random.choice([0, 1, 2, 4, 9]))]) for k in range(800)] + [(None, None)]
    got = sentence_pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), MODEL).collect()
    assert {r.doc_id: r.decoded for r in got} == {k: None if ids is None else library.decode(ids) for k, ids in rows}


def test_the_library_check_fails_on_other_ids_or_texts(library):
    own = sentence_pieces.Vocabulary(MODEL)
    texts = ["some text,  \n with ▁ odd 日本 signs\x00", "", "some more"]
    ids = own.encode(texts)
    assert own.ids.fresh
    sentence_pieces.checked(own, library, ids, [own.spelled(i) for i in ids])
    assert set(own.ids.fresh) <= {sentence_pieces.SPACE, own.apart}  # only what the check itself put in front
    with pytest.raises(ValueError, match="decodes row 1"):
        sentence_pieces.checked(own, library, ids, [own.spelled(ids[0]), " ", own.spelled(ids[2])])
    own.ids["▁new"] = own.ids["▁text"]
    own.ids.fresh.append("▁new")
    with pytest.raises(ValueError, match="▁new"):
        sentence_pieces.checked(own, library, [], [])


def test_other_models_are_refused():
    unigram = bytes([0x12, 0x02, 0x18, 0x01])  # a trainer specification of type 1
    with pytest.raises(ValueError, match="rules other"):
        sentence_pieces.Vocabulary(unigram)


def test_pieces_of_empty_table(no_docs):
    assert sentence_pieces.encode_decode(no_docs, MODEL).collect() == []


# ---- clusters

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance int, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "mine") for i, v in rows], VECTORS)


def odd_vectors(dims, n, seed):
    rng = np.random.default_rng(seed)
    hubs = rng.standard_normal((5, dims))
    rows = [(i, (hubs[i % 5] + 0.3 * rng.standard_normal(dims)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (3, rows[7][1]), (None, rows[8][1]), (None, rows[8][1]), (902, [0.0] * dims), (903, [-0.0] * dims)]
    bad = [(950, None), (951, []), (952, rows[0][1][:-1]), (953, [None, *rows[0][1][1:]]), (954, [math.nan, *rows[0][1][1:]]), (955, [math.inf, *rows[0][1][1:]]), (956, [-math.inf, *rows[0][1][1:]])]
    return rows, bad


def brute_clusters(rows, k=8, rounds=10, dims=64):
    x = [(i, [math.floor(1024 * np.float64(np.float32(c))) for c in v]) for i, v in rows]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(x, key=key)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in x:
            groups[near(v)[1]].append(v)
        centres = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    out = [(i, *near(v)) for i, v in x]
    sums = {j: sum(d for _, d, c in out if c == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i or -1, j, d, sums[j], sum(sums.values()), sha[j], centres[j]) for i, d, j in out)


def clustered(df, **kw):
    return sorted((r.vec_id or -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256, r.centroid) for r in centroids.cluster(df, **kw).collect())


@pytest.mark.parametrize("n", [150, 12])
def test_clusters_of_odd_vectors(spark, n):
    rows, bad = odd_vectors(64, n, 1)
    assert clustered(table(spark, rows + bad).repartition(3)) == brute_clusters(rows)


def test_few_and_no_vectors(spark):
    rows, bad = odd_vectors(64, 9, 2)
    assert clustered(table(spark, rows[:2])) == brute_clusters(rows[:2])
    assert clustered(table(spark, bad)) == [] == clustered(table(spark, []))
    assert centroids.cluster(table(spark, bad)).columns == centroids.cluster(table(spark, rows)).columns


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [0.5] * 64) for i in range(20)] + [(100 + i, [0.25] * 64) for i in range(20)]
    got = clustered(table(spark, rows))
    assert got == brute_clusters(rows)
    assert len({r[1] for r in got}) == 2 and all(r[2] == 0 for r in got)


def test_blocks_do_not_change_clusters(spark, monkeypatch):
    rows, _ = odd_vectors(64, 90, 3)
    whole = clustered(table(spark, rows))
    monkeypatch.setattr(centroids, "BLOCK", 7)
    assert clustered(table(spark, rows).repartition(5)) == whole


def test_large_components_fail(spark):
    with pytest.raises(Exception, match="too large"):
        clustered(table(spark, [(1, [1e9] * 64)]))


# ---- eigenpairs


def spectrum(values, seed=5):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    v = (q * values) @ q.T
    return (v + v.T) / 2


def test_counts_by_inertia():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 40):
        for _ in range(10):
            v = rng.standard_normal((n, n))
            v, s = v + v.T, rng.standard_normal()
            assert contour.above(v, s) == (np.linalg.eigvalsh(v) > s).sum()
    assert contour.above(np.zeros((3, 3)), 0.0) == 0
    assert contour.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 30), np.ones(30), np.r_[5, 5, 5, 5, 5, 1, np.full(24, 0.1)], np.r_[1e8, 1, 0.9, 0.8, 0.7, np.full(25, 0.1)], np.r_[4, 3, 2, 1, 1, 1, 1, np.ones(23)],
    np.linspace(1, 1.001, 30), 1e-9 * np.linspace(1, 3, 30), np.r_[2, 1.00000001, 1, 1, 0.99999999, np.full(25, 0.9)], np.r_[3.0], np.r_[3, 2, 1],
])
def test_largest_eigenpairs(values):
    v = spectrum(values)
    e, u = contour.largest(v, 4)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert len(e) == len(want)
    assert np.allclose(e, want, rtol=0, atol=1e-13 * want[0])
    assert np.abs(v @ u - u * e).max() < 1e-13 * want[0]
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-11


def test_rank_bounds_the_components():
    assert len(contour.largest(spectrum(np.r_[3, 2, np.zeros(20)]), 4)[0]) == 2
    assert len(contour.largest(np.zeros((4, 4)), 4)[0]) == 0


# ---- whitening


def brute_whitened(rows):
    x = np.array([[math.floor(256 * np.float64(np.float32(c))) for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_whitening_of_odd_vectors(spark):
    rows, bad = odd_vectors(6, 120, 6)
    n, deviation, white, explained = brute_whitened(rows)
    got = whitening.whiten(table(spark, rows + bad).repartition(3)).collect()
    assert len(got) == 4 * len(rows)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1
    assert all(r.deviation == r.deviation_wide for r in got)
    want = sorted((i or -1, k + 1, d, round(abs(w[k]), 8), round(explained[k], 10)) for (i, _), d, w in zip(rows, deviation.tolist(), white, strict=True) for k in range(4))
    assert sorted((r.vec_id or -1, r.component, r.deviation, round(abs(r.whitened), 8), round(r.explained, 10)) for r in got) == want
    for k in range(4):  # one sign for all rows
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1 and r.vec_id is not None and r.vec_id != 3}
        signs = {np.sign(mine[i] * w[k]) for (i, _), w in zip(rows, white, strict=True) if i in mine and abs(w[k]) > 1e-6}
        assert len(signs) == 1


def test_whitening_without_variance(spark):
    same = [(i, [0.5, 0.25, 1.0]) for i in range(9)]
    assert whitening.whiten(table(spark, same)).collect() == []
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and max(abs(r.explained - 1) for r in line) < 1e-12
    assert whitening.whiten(table(spark, [])).collect() == [] == whitening.whiten(table(spark, [(1, None), (2, [])])).collect()


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(1e9 * math.sin(i + d))) for d in range(3)]) for i in range(40)]
    n, _, white, _ = brute_whitened(rows)
    x = [[math.floor(256 * np.float64(np.float32(c))) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    far = {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}
    got = whitening.whiten(table(spark, rows)).collect()
    assert all(r.deviation_wide == far[r.vec_id] and r.deviation == (far[r.vec_id] if far[r.vec_id] < 2**63 else None) for r in got)
    assert max(abs(abs(r.whitened) - abs(white[r.vec_id][r.component - 1])) for r in got) < 1e-8


def test_deviations_by_halves():
    p = whitening.Projection(1000, [12_345_678_901, -5], np.ones(1), np.ones((2, 1)))
    x = np.array([[2**38, -(2**38)], [7, 9]])
    assert p.deviations(x) == [sum((1000 * a - b) ** 2 for a, b in zip(r, p.sums, strict=True)) for r in x.tolist()]


def test_products_are_exact_in_every_range():
    rng = np.random.default_rng(8)
    for top in (100, 1 << 22, 1 << 25, 1 << 40):
        y = rng.integers(-top, top, (300, 3))
        want = y.astype(object).T @ y.astype(object)
        assert (whitening.products(y) == want).all()
    assert whitening.exact_sum(np.full((4, 1), 2**61)) == [2**63]


def test_packed_rows_come_back():
    x = np.array([[1, -2], [300, 0], [-(2**40), 5], [70_000, -1], [127, -127], [0, 0]])
    assert (whitening.unpacked(whitening.packed(x), 2) == x).all()
