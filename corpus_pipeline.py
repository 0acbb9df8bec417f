"""The corpus pipeline: toxicity, quality, MinHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs.  All but the last return the columns of documents.  The classifiers are fitted on a bounded
sample of the labelled rows of sf_dir/labels among the stage's own documents.  Documents with a null text
or a null id are scored like empty texts, never match a duplicate, and go on.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caduspark.llm import minhash_neardup, packing, quality, shared, substring_dedup, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOXIC_FROM, QUALITY_FROM = 0.5, 0.7


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model, name="__score").where(F.col("__score") < TOXIC_FROM).drop("__score")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is QUALITY_FROM or more."""
    model = quality.train(docs, _labels(spark, sf_dir))
    return quality.score(docs, model, name="__score").where(F.col("__score") >= QUALITY_FROM).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_neardup.drop_duplicates(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that also stand elsewhere; untouched documents keep their text as it was."""
    found = substring_dedup.remove_repeats(docs)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    out = {c: F.col(f"`{at}`").alias(c) for c, at in zip(docs.columns, found.columns)}  # a clashing column stands there under another name
    out["text"] = text.alias("text")
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return shared.reads(found.select(*out.values()), *found._reads)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]

#: No SQL: models, hashing and tokenizers are not expressible there; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written as Parquet and read again; a stage's table goes when the next one stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        written = shared.write_table(out, name)
        shared.release(out)
        shared.drop_table(docs)
        docs = written
    return shared.reads(STAGES[-1][1](spark, docs, sf_dir), docs)
