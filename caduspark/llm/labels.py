"""Held-out folds and bounded training samples for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(__y double, __text) of at most `limit` labelled documents outside the held-out fold.

    The sample is the `limit` smallest hashes of the key: the same rows whatever the partitions, and a
    broadcast of at most `limit` keys.  Rows without label, key or fold take no part.
    """
    known = labels.where(F.col(target).isNotNull() & (fold_of(F.col(key), folds) != held)).select(
        F.col(key).alias("__key"), F.col(target).cast("double").alias("__y")
    )
    known = known.groupBy("__key").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__key"), "__key").limit(limit)
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(known), "__key").select("__key", "__y", "__text")
