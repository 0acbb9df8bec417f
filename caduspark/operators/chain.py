"""The event chain: canonical form, hashes, signatures; emission per session, verification by window.

Canonical form: JSON of the event's fields in alphabetical order, nulls included, then the previous hash.
Event hash: SHA-256 of the canonical form; signature: its HMAC-SHA256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from caduspark.functions.hashing import hmac_sha256

FIELDS = ["agent_id", "confidence_score", "event_id", "event_type", "input_hash", "risk_tier", "sequence_number", "session_id", "ts_us"]


def body(fields: list[str] | None = None) -> Column:
    """The event without its links, as JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(fields or FIELDS)), {"ignoreNullFields": "false"})


def event_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def emit(events: DataFrame, key: bytes, order: str = "sequence_number") -> DataFrame:
    """Link and sign the events of each session, numbered from 1 in `order`.

    Each hash needs the one before, so a session's rows pass one task in order; the task holds one hash and one Arrow batch,
    however long the session is.  Events without a session form a session of their own.  The window's shuffle serves the
    links as well: what follows it is narrow.
    """
    w = Window.partitionBy("session_id").orderBy(order, "event_id")
    rows = events.withColumn("sequence_number", F.row_number().over(w).cast("long"))
    bodies = rows.withColumn("__body", body()).sortWithinPartitions("session_id", "sequence_number")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, prev = object(), ""
        for batch in batches:
            before, after = [], []
            for s, text in zip(batch.column("session_id").to_pylist(), batch.column("__body").to_pylist()):
                if s != session:
                    session, prev = s, ""
                before.append(prev)
                prev = hashlib.sha256((text + prev).encode()).hexdigest()
                after.append(prev)
            out = batch.drop_columns(["__body"])
            yield out.append_column("prev_event_hash", pa.array(before, pa.string())).append_column("event_hash", pa.array(after, pa.string()))

    schema = StructType([*rows.schema.fields, StructField("prev_event_hash", StringType()), StructField("event_hash", StringType())])
    return bodies.mapInArrow(link, schema).withColumn("signature", hmac_sha256(F.concat(body(), F.col("prev_event_hash")), key))


def verify(chain: DataFrame, key: bytes | None, heads: DataFrame | None = None) -> DataFrame:
    """(session_id, ok, error): the first break of each session by sequence, as one window and one aggregate.

    heads (session_id, n, head), where known, also shows a cut-off tail.
    """
    w = Window.partitionBy("session_id").orderBy("sequence_number", "event_id")
    canonical = F.concat(body(), F.col("prev_event_hash"))
    rows = chain.withColumn("__hash", event_hash(canonical)).withColumn("__i", F.row_number().over(w))
    rows = rows.withColumn("__prev", F.coalesce(F.lag("__hash").over(w), F.lit("")))
    unsigned = (hmac_sha256(canonical, key) != F.col("signature")) | F.col("signature").isNull() if key is not None else F.lit(False)
    error = (
        F.when(
            F.col("sequence_number") != F.col("__i"),
            F.concat(F.lit("event "), F.col("event_id"), F.lit(" has sequence_number "), F.col("sequence_number").cast("string"), F.lit(", expected "), F.col("__i").cast("string"), F.lit(" (gap or reorder)")),
        )
        .when(
            ~F.col("__prev").eqNullSafe(F.col("prev_event_hash")),
            F.concat(F.lit("event "), F.col("event_id"), F.lit(" (#"), F.col("sequence_number").cast("string"), F.lit(") has prev_event_hash mismatch at index "), (F.col("__i") - 1).cast("string")),
        )
        .when(unsigned, F.concat(F.lit("event "), F.col("event_id"), F.lit(" signature invalid")))
    )
    found = rows.withColumn("__error", error).groupBy("session_id").agg(
        F.min(F.when(F.col("__error").isNotNull(), F.struct("__i", "__error"))).alias("e"), F.count("*").alias("n"), F.max_by("__hash", "__i").alias("head")
    )
    broken = F.col("e.__error")
    if heads is not None:
        known = heads.select("session_id", F.col("n").alias("__n"), F.col("head").alias("__head"))
        found = found.join(known, "session_id", "left")
        broken = (
            F.when(broken.isNotNull(), broken)
            .when(F.col("__n") != F.col("n"), F.concat(F.lit("chain truncated: backend holds "), F.col("n").cast("string"), F.lit(" events, "), F.col("__n").cast("string"), F.lit(" were emitted")))
            .when(F.col("__head") != F.col("head"), F.lit("chain head mismatch: stored tail differs from emitted tail"))
        )
    return found.select("session_id", broken.isNull().alias("ok"), broken.alias("error"))


def heads(chain: DataFrame) -> DataFrame:
    """(session_id, n, head) to hold a stored chain against later."""
    return chain.groupBy("session_id").agg(F.count("*").alias("n"), F.max_by("event_hash", "sequence_number").alias("head"))
