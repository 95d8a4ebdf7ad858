"""Queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.llm import codec, licenses, lines, media, minhash, packing, quality, token_counts, topk, url_filters
from cytoquill.llm.common import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, similarity_at_least=Fraction(85, 100))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(read_table(spark, sf_dir, "pages"), url_filters.page_outcomes(read_table(spark, sf_dir, "labels")))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    items = media.resolve(media.interleave(media.text_pages(docs), kinds=("media",)), media.media_features(media.text_media(docs)))
    return items.select(
        F.col("id").alias("doc_id"),
        F.col("bytes").alias("n_bytes"),
        F.col("media_payload_bytes").alias("payload_bytes"),
        F.col("media_payload_sha256").alias("payload_sha256"),
        F.col("media_tail_crc32").alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.col("media_feature").alias("feature"),
        "position",
        "caption",
    )


def media_page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page of ``pages`` as a sequence: how many items it has, and the digest of its texts in order."""
    texts = F.filter("items", lambda x: x["kind"] == "text")
    return media.interleave(read_table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"),
        F.size("items").cast("long").alias("n_items"),
        F.size(texts).cast("long").alias("n_texts"),
        F.sha2(F.concat_ws("\n", F.transform(texts, lambda x: x["text"])).cast("binary"), 256).alias("text_sha256"),
    )


#: Share of a window's tokens for the source that holds more than a third of the documents; the others divide the rest by what they hold.
MIXTURE = {"src0": 0.3}


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), target=MIXTURE)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(licenses.scan_licenses(read_table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.codec_digests(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_media_columns": op3_media_columns,
    "media_page_sequences": media_page_sequences,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_exact_topk": op5_exact_topk,
    "op6_license_scan": op6_license_scan,
    "op7_token_counts": op7_token_counts,
    "op8_quality_gam": op8_quality_gam,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE: dict[str, str] = {
    "op1_minhash_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a),
        c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op2_url_filters": url_filters.oracle_sql(),
    "op5_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
}
