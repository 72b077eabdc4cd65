"""Queries of the training-data operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaycheck.llm import bpe, centroids, cover_tree, html_extract, language_id, lm_score, minhash_dedup, packing, quality_classifier, quality_rules, sentence_pieces, warc, whitening
from quaycheck.llm.common import table
from quaycheck.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_json(name: str) -> str:
    """Text of a public tokenizer file, read once on the driver and sent to the tasks; a few MB of fixed size."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def tokenizer_model(name: str) -> bytes:
    """A public tokenizer's model file, half a MB of fixed size."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ship_package(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id leaves no 2 when divided by 7."""
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, held_out=F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens, each closed by id 0."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_json("byte_bpe_50k.json"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document (declared in its column, its source as host) and of every page (markup, address)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix")
    )
    html, host = F.col("html"), language_id.host_of(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", language_id.visible(html).alias("text"), language_id.markup_language(html).alias("declared"), host.alias("host"), language_id.suffix_of(host).alias("suffix")
    )
    return language_id.identify(docs.unionByName(pages), declared=F.col("declared"), host=F.col("host"), suffix=F.col("suffix"), carry=["doc_id", "page_id"])


@query
def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more between all vectors, and their components."""
    return cover_tree.link_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: five words, similarity of 0.75 or more."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_json("word_bpe_49k.json"), digests=True)


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views."""
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *quality_classifier.RESULTS)


SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents with begin and end, and what they decode to, as digests; checked against the library."""
    return sentence_pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_model("piece_bpe_32k.model"), digests=True)


def _rounds(n: int) -> str:
    """Common table expressions of n rounds: nearest centroid of every vector, then centroids of the next round."""
    out = []
    for i in range(n + 1):
        out.append(f"""d{i} AS (SELECT rid, min({{d: list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), k: k}}) AS best FROM kept, c{i} GROUP BY rid),
 a{i} AS MATERIALIZED (SELECT rid, vec_id, x, best.k AS k, CAST(best.d AS BIGINT) AS distance FROM d{i} JOIN kept USING (rid))""")
        if i < n:
            out.append(f"""s{i} AS (SELECT k, dim, sum(v) AS s, count(*) AS n FROM (SELECT k, unnest(x)::BIGINT AS v, unnest(range(64)) AS dim FROM a{i}) GROUP BY k, dim),
 m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY dim) AS c FROM s{i} GROUP BY k),
 c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    return ",\n ".join(out)


SQL["op12_centroids"] = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: coalesce(isfinite(e), false))) = 64),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x AS c FROM kept QUALIFY k < 8),
 {_rounds(10)},
 i AS (SELECT k, sum(distance)::BIGINT AS cluster_inertia FROM a10 GROUP BY k),
 h AS (SELECT k, sha256(list_aggregate(list_transform(c, lambda e: e::BIGINT::VARCHAR), 'string_agg', ',')) AS centroid_sha256 FROM c10)
SELECT vec_id, k::INTEGER AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a10) AS inertia, centroid_sha256 FROM a10 JOIN i USING (k) JOIN h USING (k)
"""


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components after ten rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of all vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("deviation_wide")
