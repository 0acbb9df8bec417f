"""Shares of known terms against a vocabulary that is a table, for vocabularies too large to stand in a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary_share(df: DataFrame, key: str, text: str, pattern: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """df plus the share of the text's tokens that vocabulary (term) knows; -1 without tokens; the twin of signals.vocabulary_share.

    key is unique.  A row counts its own repeats first; a token of very many rows is left to AQE, which splits the rows' side
    of an outer join, and the vocabulary is broadcast only where its size allows.
    """
    terms = vocabulary.select(F.lower("term").alias("__term")).where("__term is not null").distinct()
    tokens = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit("(?U)" + pattern), 1)).alias("__token"))
    counted = tokens.groupBy(key, F.lower("__token").alias("__token")).agg(F.count("*").alias("__n"))
    known = counted.join(terms, F.col("__token") == F.col("__term"), "left")
    shares = known.groupBy(F.col(key).alias("__key")).agg((F.sum(F.when(F.col("__term").isNotNull(), F.col("__n")).otherwise(0)) / F.sum("__n")).alias(name))
    return df.join(shares, df[key] == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(-1.0)))
