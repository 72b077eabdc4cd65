"""Language, vectors, classifier, archives, extraction and the pipeline against plain Python, with odd rows and empty tables."""

import hashlib
import io
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from quaycheck.llm import components as stars
from quaycheck.llm import cover_tree, html_extract, language_id, packing, quality_classifier, warc
from quaycheck.llm.components import components, grown
from tests.llm.conftest import DOCS, sentence
from tests.llm.test_text_operators import BYTE, brute_components, unpacked

# ---- language


def speech(code, i, n=30):
    parts = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "schule", "nicht"], "fr": ["les", "une", "avec", "eaux"]}[code]
    return " ".join(parts[(i * 7 + j * j) % 4] for j in range(n))


def test_language_by_all_evidence(spark):
    rows = [(i, speech(c, i), c, f"https://www.{c}{i % 3}.example.{ {'en': 'com', 'de': 'de', 'fr': 'fr'}[c] }/x") for i, c in enumerate(["en", "de", "fr"] * 40)]
    rows += [(900, None, "de", None), (901, "", None, "https://a.example.fr/"), (902, "12 !!", "en", "no address"), (903, speech("de", 1), None, None), (None, speech("fr", 2), "qq", "https://fr0.example.fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string").withColumn("kept", F.lit("mine"))
    host = language_id.host_of(F.col("url"))
    got = {r.doc_id: r for r in language_id.identify(docs, declared=F.col("lang"), host=host, suffix=language_id.suffix_of(host)).collect()}
    assert all(got[i].language == c and got[i].kept is True for i, _, c, _ in rows[:120])
    assert not any(got[i].kept for i in (900, 901, 902)) and got[901].language == "fr"
    assert got[903].language == "de" and got[None].language == "fr" and len(got) == len(rows)


def test_a_language_of_one_row_in_ten_thousand_is_found(spark):
    rows = [(i, speech("en", i), "en") for i in range(9_998)] + [(20_000, "kaixo mundua etxeko txakurra zuriekin", "eu"), (20_001, "etxeko txakurra zuriekin mundua kaixo", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), declared=F.col("lang")).where("doc_id >= 9990").collect()}
    assert got[20_000].language == "eu" and got[20_001].text_language == "eu" and got[9_990].language == "en"


def test_language_against_plain_numbers(spark):
    """Text, declared, suffix and host evidence added up in plain Python for every row."""
    rows = [(i, speech(("en", "de", "fr")[i % 3], i, 2 + i % 9), (None, "en", "de", "fr", "DE-at")[i % 5], ("h1", "h2", None, "h3")[i % 4], ("uk", "de", None, None)[i % 4]) for i in range(150)] + [(999, None, "fr", "h1", "uk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, suffix string")
    got = {r.doc_id: r for r in language_id.identify(docs, declared=F.col("lang"), host=F.col("host"), suffix=F.col("suffix")).collect()}
    names, weight, temper, buckets = ["de", "en", "fr"], 20.0, 12.0, language_id.BUCKETS
    code = lambda c: c and c[:2].lower()
    grams = {}
    for i, t, *_ in rows:
        g, at = language_id.trigrams(pa.array([t], pa.string()))
        grams[i] = g
    counts = {x: np.full(buckets, 0.5) for x in names}
    for i, _, d, *_ in rows:
        if d:
            np.add.at(counts[code(d)], grams[i], 1)
    logs = np.log(np.stack([counts[x] / counts[x].sum() for x in names]))
    soft = lambda a: np.exp(a - a.max()) / np.exp(a - a.max()).sum()
    said = {}
    for i, *_ in rows:
        n = len(grams[i])
        sums = logs[:, grams[i]].sum(1)
        said[i] = (sums - sums.max()) * (min(1.0, temper / max(1.0, math.sqrt(n))) if n else 0.0)
    seen = [r for r in rows if len(grams[r[0]])]
    base = sum(soft(said[r[0]]) for r in seen) + 1.0
    flat = base / base.sum()
    total = lambda use: sum((soft(said[r[0]]) for r in seen if use(r)), np.zeros(3))
    smooth = lambda s, prior: (s + weight * prior) / (s.sum() + weight)
    for i, _, d, h, x in rows:
        score = said[i].copy()
        if d:
            score += np.log(smooth(total(lambda r: code(r[2]) == code(d)), flat) / flat)  # noqa: B023
        if x:
            score += np.log(smooth(total(lambda r: r[4] == x), flat) / flat)  # noqa: B023
        if h:
            parent = smooth(total(lambda r: r[4] == x), flat) if x else flat  # noqa: B023
            score += np.log(smooth(total(lambda r: r[3] == h), parent))  # noqa: B023
        else:
            score += np.log(flat)
        p = soft(score)
        assert got[i].language == names[int(p.argmax())] and abs(got[i].probability - p.max()) < 1e-5, i
        assert got[i].kept == (len(grams[i]) >= 1 and p.max() >= 0.5)


def test_language_without_evidence(spark, no_docs, odd_docs):
    assert language_id.identify(no_docs, declared=F.col("lang")).collect() == []
    got = language_id.identify(odd_docs).collect()
    assert len(got) == odd_docs.count() and not any(r.kept for r in got) and set(odd_docs.columns) < set(got[0].asDict())


def test_page_evidence(spark):
    html = '<!DOCTYPE html><HTML data-x=1 lang="fr-CA"><script>var the=1</script><!-- the --><p>une&nbsp;fois</p>'
    row = spark.range(1).select(language_id.markup_language(F.lit(html)), language_id.visible(F.lit(html)), language_id.host_of(F.lit("HTTPS://u@A.B.example.ORG:8/x")), language_id.suffix_of(F.lit("a.example.org"))).first()
    assert row[0] == "fr-CA" and row[1].split() == ["une", "fois"] and row[2] == "a.b.example.org" and row[3] == "org"


# ---- vectors


def brute_links(rows, least=0.9):
    ok = [v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, comp = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j]:
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    n[i] += 1
                    n[j] += 1
                    old, new = comp[i], comp[j]
                    comp = [new if c == old else c for c in comp]
    name = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in set(comp)}
    return sorted((r[0], k, name[c], r[0] == name[c]) for r, k, c in zip(rows, n, comp, strict=True))


@pytest.mark.parametrize("block", [16, 4096])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(9)] + [(300 + i, [1.0 + i * 1e-3, 2.0, 3.0, 4.0]) for i in range(30)]
    rows += [(400, None), (401, [0.0] * 4), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan"), 1.0, 0.0, 0.0]), (404, [float("inf"), 1.0, 0.0, 0.0]), (405, [1.0, 2.0]), (406, []), (407, [1e-30, 2e-30, 3e-30, 4e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit("mine"))
    got = cover_tree.link_vectors(df, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows)


def test_links_of_empty_table(spark):
    assert cover_tree.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_blocks_meet_without_a_row_for_each_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(150)] + [(200 + i, [1.0 + i * 1e-3, 2.0, 3.0, 4.0]) for i in range(40)]
    keep, plans = cover_tree.staged, []

    def staged(df, name):
        if name == "vector-links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(cover_tree, "staged", staged)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(cover_tree.link_vectors(df, block=16).collect())
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Generate" not in plans[0]
    assert sorted(cover_tree.link_vectors(df, block=16, share_bytes=4000).collect()) == whole and len(plans) > 4
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in whole] == brute_links(rows)


@pytest.mark.parametrize("total", [1, 2, 5, 6])
def test_one_of_two_blocks_compares_them(total):
    found = [{i, j} for i in range(total) for j in range(total) if cover_tree.first_of(i, j, total)]
    assert sorted(map(sorted, found)) == sorted(sorted({i, j}) for i in range(total) for j in range(i, total))


def test_shares_are_bounded_and_whole():
    assert cover_tree.shares([(5, 3), (0, 4), (1, 4), (3, 9), (4, 2)], 8) == [(0, 1), (3, 3), (4, 5)]
    assert cover_tree.shares([], 8) == []


def test_sample_without_rows_has_a_centre(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "bounded_sample", lambda df, *_: df.limit(0))
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.component_id) for r in cover_tree.link_vectors(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_packed_tree_is_the_same():
    tree = cover_tree.Tree(cover_tree.unit(np.random.default_rng(2).normal(size=(90, 3))))
    back = cover_tree.Tree.unpack(tree.pack())
    for k in ("centres", "node", "radius", "parent"):
        assert all(np.array_equal(a, b) for a, b in zip(getattr(tree, k), getattr(back, k), strict=True))


def test_tree_levels_cover_and_nest():
    x = cover_tree.unit(np.random.default_rng(2).normal(size=(200, 3)))
    tree = cover_tree.Tree(x)
    far = cover_tree.distances(x, x)
    for level, r in enumerate(cover_tree.LEVELS):
        c, node = tree.centres[level], tree.node[level]
        assert (far[np.arange(200), c[node]] <= tree.radius[level][node] + 1e-7).all() and tree.radius[level].max() <= r + 1e-6
        assert set(c) <= set(tree.centres[level + 1])


@pytest.mark.parametrize("dim", [2, 64, 768])
def test_pairs_within_reach_equal_double_precision(dim):
    rng = np.random.default_rng(dim)
    a = cover_tree.unit(rng.normal(size=(300, dim)))
    b = cover_tree.unit(np.r_[a[:200] + rng.normal(size=(200, dim)) * 0.3 / np.sqrt(dim), rng.normal(size=(100, dim))])
    ra, rb = rng.choice([0.4, 0.5], 300), rng.choice([0.0, 0.1], 300)
    i, j, dot = cover_tree.within(a, b, ra, rb)
    want = np.argwhere(cover_tree.distances(a, b) <= ra[:, None] + rb[None, :])
    assert set(map(tuple, want.tolist())) <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert np.allclose(dot, (a @ b.T)[i, j], rtol=0, atol=1e-12)
    assert (np.sqrt(np.maximum(2 - 2 * dot, 0)) <= (ra[i] + rb[j]) + 1e-3 + 1e-4 * dim).all()
    odd = np.arange(300) % 2 == 1
    assert (cover_tree.within(a, b, ra, rb, lambda rows: np.broadcast_to(odd[rows, None], (len(odd[rows]), 300)))[0] % 2 == 1).all()


def test_stars_take_no_round(spark, monkeypatch):
    names = []
    keep = stars.staged
    monkeypatch.setattr(stars, "staged", lambda df, name: names.append(name) or keep(df, name))
    links = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 30)}, 50: 50, 51: 50} and names == ["links"]


def test_components_grow_by_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60, 120)) for _ in range(40)]
    more = [(rng.randrange(140), rng.randrange(140)) for _ in range(25)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    want = {r.node: r.component for r in components(table(links + more)).collect()}
    got = [(r.node, r.component) for r in grown(components(table(links)), table(more)).collect()]
    assert len(got) == len(dict(got))
    assert {k: v for k, v in got if k in want} == want and all(k == v for k, v in got if k not in want)
    assert sorted(grown(components(table(links)), table([])).collect()) == sorted(components(table(links)).collect())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 150)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- classifier


def test_classifier_on_held_out_rows(spark, labels):
    rows = [(i, sentence(i, 40) if i % 4 else "### $$$ " * 20 + "BUY NOW!! " * 9, "en", f"s{i % 5}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("mine"))
    known = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 1) if i % 3], "doc_id long, quality int")
    got = quality_classifier.classify(docs, known).collect()
    assert len(got) == 400 and sum(r.kept == (r.doc_id % 4 > 0) for r in got if r.doc_id % 3 == 0) >= 0.98 * sum(r.doc_id % 3 == 0 for r in got)
    assert set(DOCS.names) < set(got[0].asDict())


def test_classifier_without_both_classes_keeps_all(spark, odd_docs, no_docs, labels):
    got = quality_classifier.classify(odd_docs, labels.where("quality = 1")).collect()
    assert len(got) == odd_docs.count() and all(r.kept is True for r in got) and got[0].key is None
    assert len(quality_classifier.classify(odd_docs, labels).collect()) == odd_docs.count()
    assert quality_classifier.classify(no_docs, labels).collect() == []


def test_marks_cover_all_rows_and_equal_plain_sums(spark):
    """Co-training against the same steps on one matrix of all rows: no row without a label is left out."""
    rng = np.random.default_rng(3)
    rows = [(i, sentence(i, 30) if rng.random() < 0.6 else "### $$$ " * 9 + sentence(i, 6), "en", f"s{i % 4}", int(rng.integers(5, 900))) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    labels = spark.createDataFrame([(i, int("#" not in t)) for i, t, *_ in rows if i % 3 == 0] + [(1, None), (None, 1)], "doc_id long, quality int")
    meta = ["lang", "source", "n_chars"]
    q = quality_classifier
    table = q.viewed(docs, labels, "doc_id", "text", meta, "quality").toPandas()
    assert len(table) == 900 and (table.y >= 0).sum() == 300 and (table.y == -1).sum() == 1
    view = {n: np.stack([np.frombuffer(b, "<f4").astype(float) for b in table[n]]) for n in ("text", "meta")}
    y, held, pool = table.y.to_numpy(), (table.key % 4 == 0).to_numpy(), table.y.isna().to_numpy()
    seed, test = (y >= 0) & ~held, (y >= 0) & held
    models = {n: q.fit(x[seed], y[seed], x[test], y[test]) for n, x in view.items()}
    used = 0
    for _ in range(3):
        told = q.marks(models, {n: x[pool] for n, x in view.items()}, 0.9)
        new = {}
        for n, x in view.items():
            use, w = told[n] >= 0, models[n].weights
            used += use.sum()
            for _ in range(2):
                z, zp = (np.c_[models[n].standard(v), np.ones(len(v))] for v in (x[seed], x[pool][use]))
                p, pp = (1 / (1 + np.exp(-np.clip(v @ w, -30, 30))) for v in (z, zp))
                share, ridge = min(1, len(z) / max(1, len(zp))), np.r_[np.ones(len(w) - 1), 1e-6]
                bend = (z * (p * (1 - p))[:, None]).T @ z + share * (zp * (pp * (1 - pp))[:, None]).T @ zp + np.diag(ridge)
                w = w - np.linalg.solve(bend, z.T @ (p - y[seed]) + share * zp.T @ (pp - told[n][use]) + ridge * w)
            new[n] = models[n].calibrated(w, x[test], y[test])
        models = new
    assert used > 1000
    model = q.train(docs, labels, "doc_id", "text", meta, "quality", 10_000, 3, 2, 0.9, 0.998)
    for n in view:
        assert np.allclose(getattr(model, n).odds(view[n]), models[n].odds(view[n]), atol=1e-6)
    got = {r.doc_id: r for r in q.classify(docs, labels, sure=0.9).collect()}
    assert np.mean([got[i].kept == ("#" not in t) for i, t, *_ in rows]) > 0.98


def test_a_labelled_id_that_repeats_is_bounded(spark):
    docs = spark.range(60_000).selectExpr("IF(id < 50000, 7, id) AS doc_id", "IF(id % 2 = 0, 'fine words in a row', '# $ # $') AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    labels = spark.createDataFrame([(7, 1), *((i, i % 2) for i in range(50_000, 50_400))], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels, "doc_id", "text", ["lang", "source", "n_chars"], "quality", 500, 1, 1, 0.98, 0.998)
    assert model is None or np.isfinite(model.weights).all()
    assert quality_classifier.classify(docs, labels, labelled=500).count() == 60_000


# ---- archives

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
LONG = "<p>" + "long page é " * 20


def test_archives_round_trip(spark):
    rows = [(3, "http://a/\r\nX: y", LONG), (1, None, LONG), (1, None, LONG), (2, "u", LONG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", LONG), (8, "u", "big " * 300_000)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)), keep_payload=True).collect()
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        copy = t == LONG and i != 1
        want.append((i or -1, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if copy else "response", 1 if copy else None, b"" if copy else raw))
    assert sorted(map(str, ((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got))) == sorted(map(str, want))


def test_archives_of_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_broken_archives_are_refused():
    import zstandard

    good = warc.record(1, "http://a", b"body", hashlib.sha256(b"body").hexdigest(), None)
    assert warc.parse(good)[:2] == (1, 4)
    for bad in (good[:-1], good + b"x", good.replace(b"body", b"bodi"), good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Date", b"WARC-Type"), good.replace(b"sha256:", b"sha999:")):
        with pytest.raises(warc.Broken):
            warc.parse(bad)
    packed = zstandard.ZstdCompressor().compress(good)
    assert list(warc.frames(io.BytesIO(warc.dictionary_frame(b"") + packed + packed), chunk=7)) == [good, good]
    for bad in (packed, warc.dictionary_frame(b"") + packed[:-3], warc.SKIPPABLE + b"\x09\x00\x00\x00x"):
        with pytest.raises(warc.Broken):
            list(warc.frames(io.BytesIO(bad)))
    words = zstandard.ZstdCompressor().compress(b"dictionary")
    assert warc.read_dictionary(io.BytesIO(warc.dictionary_frame(words))) == b"dictionary"


# ---- extraction

ARTICLE = "<h1>Title &amp; more</h1><p>First  <b>bold</b>\n text &eacute;&#33;<br>after<p>Short.<ul><li>one</li><li>two</li></ul><blockquote>said</blockquote>"
WANT = "Title & more\nFirst bold text é! after\nShort.\none\ntwo\nsaid"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>menu</a></nav><article>{ARTICLE}</article><footer>foot</footer></body></html>",
        f"<body><header>top</header><aside>side</aside><div class='cookie-notice'>We use cookies</div><main>{ARTICLE}</main><section id='comments'><article class='comment'><p>reader</p></article></section>",
        f"<body><div class='sidebar'><p>side</p></div><div class='post'>{ARTICLE}<form><input><label>mail</label></form><script>x='<p>'</script><div class='ad'>buy</div></div><footer>f",
        f"<body><div role='navigation'>menu</div><article>{ARTICLE}<!-- note --><div hidden>no</div></article><div class='footer'>foot</div><div cla",
    ],
)
def test_main_text_of_layouts(html):
    assert html_extract.main_text(html, html_extract.gaussian(1.0)) == WANT


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain words"), (4, "u", "<nav>only</nav>"), (None, "u", "<p>x"), (5, "u", "<p>" + "y " * 50_000), (6, "u", "a < b & c<!-- open")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("mine"))).collect()}
    assert [got[i].text for i in (1, 2, 3, 4, None)] == ["", "", "plain words", "", "x"] and got[5].n_chars == 99_999 and got[6].text.startswith("a < b & c")
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


# ---- pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    good = [(i, sentence(i, 60), "en", f"s{i % 4}", 1) for i in range(120)]
    copies = [(200 + i, sentence(i, 60) + " end", "en", "s1", 1) for i in range(20)] + [(0, sentence(0, 60), "en", "s0", 1), (None, sentence(1, 60), None, None, None), (None, sentence(1, 60), None, None, None)]
    junk = [(400 + i, "### $$$ " * 20 + f"BUY NOW{i}!! " * 9, "en", "s2", 1) for i in range(60)]
    empty = [(500, None, "en", "s1", 0), (501, "", None, None, None)]
    spark.createDataFrame(good + copies + junk + empty, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400)) for i, *_ in good + junk], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs.collect())
    assert [list(s[0].asDict()) for s in seen[:3]] == [DOCS.names] * 3
    kept = {r.doc_id for r in seen[0]}
    assert not kept & {i for i, *_ in junk} and {i for i, *_ in good} <= kept
    assert all(r.text for r in seen[1]) and {i for i, *_ in good} <= {r.doc_id for r in seen[1]}
    groups = brute_components([(k, r.text) for k, r in enumerate(seen[1])])
    assert len(seen[2]) == len({c for _, _, c in groups})
    unpacked(seen[3], 2048)
    assert {r.doc_id for r in seen[3]} == {r.doc_id for r in seen[2]}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, ((r.doc_id, r.piece, r.ids_crc32) for r in whole))) == sorted(map(str, ((r.doc_id, r.piece, r.ids_crc32) for r in seen[3])))


def test_pipeline_of_empty_tables(spark, tmp_path, no_docs, labels):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pack_keeps_further_columns_out(odd_docs):
    assert "kept" not in packing.pack(odd_docs, BYTE).columns


def test_stages_leave_columns_named_like_results(spark, tmp_path):
    rows = [(i, speech("en", i, 40) + f" {i}", "en", "s", 10) for i in range(30)] + [(3, speech("en", 3, 40) + " 3", "en", "s", 10), (None, speech("en", 77, 40), "en", "s", 10)]
    own = {"kept": "mine", "language": "own", "probability": "p", "text_language": "t", "p_text": "a", "p_meta": "b", "__row0": "r", "__row": "q"}
    docs = spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in own.items()})
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[k] == v for r in got for k, v in own.items()), name
    assert len(got) == 31  # the repeated row went, one of each stays
