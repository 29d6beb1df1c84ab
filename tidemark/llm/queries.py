"""Thin queries over the shared tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, neardup, pii, quality, simhash, substrings, tokencount, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"), outputs=("n_words", "n_removed", "kept_sha256"))


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, pii.session_key(spark)).withColumn("n_entities", F.size("entities").cast("long"))


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.document_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), eod=50256)


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nn_descent": op1_nn_descent,
    "op2_suffix_trees": op2_suffix_trees,
    "op3_bradley_terry": op3_bradley_terry,
    "op4_pivot_topk": op4_pivot_topk,
    "op5_bpe_trie": op5_bpe_trie,
    "op6_surrogates": op6_surrogates,
    "op7_separator_scan": op7_separator_scan,
    "op8_arc_to_warc": op8_arc_to_warc,
    "op9_pfair_mix": op9_pfair_mix,
    "op10_simhash_pivot": op10_simhash_pivot,
}

ORACLE_SQL: dict[str, str] = {
    "op1_nn_descent": """
        WITH RECURSIVE ok AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), v AS (
            SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM ok
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
        ), reach AS (
            SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN l ON l.a = r.node
        ), c AS (
            SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id
        ), d AS (
            SELECT a, count(*) AS n_links FROM l GROUP BY a
        )
        SELECT c.vec_id, CAST(coalesce(d.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN d ON d.a = c.vec_id
    """,
    "op2_suffix_trees": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (
            SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d
        ), s AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p
        ), o AS (
            SELECT g, min(doc_id) AS owner FROM s GROUP BY g
        ), gone AS (
            SELECT DISTINCT s.doc_id, s.i + k.k AS i
            FROM s JOIN o ON s.g = o.g AND o.owner < s.doc_id, (SELECT unnest(range(13)) AS k) k
        ), words AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
            FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
               CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op4_pivot_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
