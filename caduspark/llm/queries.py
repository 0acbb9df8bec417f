"""Registered queries of this subpackage, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caduspark.llm.labels import fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caduspark.llm.substring_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caduspark.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caduspark.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), quality.FOLDS) == quality.HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caduspark.llm.html_mincut import extract_text

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, "html", "text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from caduspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caduspark.llm.hilbert_shard import shard

    return shard(table(spark, sf_dir, "documents")).drop("curve")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caduspark.llm.topk_vafile import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caduspark.llm.embed_neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from caduspark.llm import sp_codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = sp_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    docs = sp_codec.digest(sp_codec.decode(docs, path))
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_crc32",
        F.xxhash64("decoded").alias("decoded_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caduspark.llm.minhash_neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_TOPK = """
WITH v AS (SELECT vec_id AS id, min(list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.id AS query_id, b.id AS vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    """SQL for op1; hashing, models, tokenizers, html and CRC-32 are beyond it, so tests hold the others against brute force."""
    return {"op1_exact_topk": _TOPK}
