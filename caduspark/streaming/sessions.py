"""Online sessions: chain, change limit, token replay, rates, rolling p95, session ends.

Each takes a streaming DataFrame; run_available() drives it over what is there now.  State is one small
record a session: (sequence, last hash), the changes of one hour, or the last samples.
"""

from __future__ import annotations

import hashlib
import hmac
import uuid
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caduspark.operators.chain import body


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; in local mode, where the session names none, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="caduspark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available, with checkpoint and output in the shared folder; the rows it wrote."""
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def chain_stream(events: DataFrame, key: bytes) -> DataFrame:
    """Link and sign arriving events; batch twin: operators.chain.emit.  Events of a batch are taken in order of ts_us, event_id.

    The sequence number is part of the canonical form, so the body is built around it: head + number + tail.
    """
    mark = -987654321
    rows = events.withColumn("sequence_number", F.lit(mark).cast("long")).withColumn("body", body())

    def step(session: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, prev = state.get if state.exists else (0, "")
        out = []
        for e in pd.concat(list(frames)).sort_values(["ts_us", "event_id"]).itertuples():
            number += 1
            canonical = (e.body.replace(f":{mark}", f":{number}", 1) + prev).encode()
            out.append((session[0], e.event_id, number, prev, hashlib.sha256(canonical).hexdigest(), hmac.new(key, canonical, hashlib.sha256).hexdigest()))
            prev = out[-1][4]
        state.update((number, prev))
        yield pd.DataFrame(out, columns=["session_id", "event_id", "sequence_number", "prev_event_hash", "event_hash", "signature"])

    return (
        rows.select("session_id", "event_id", "ts_us", "body")
        .groupBy("session_id")
        .applyInPandasWithState(
            step,
            "session_id string, event_id string, sequence_number long, prev_event_hash string, event_hash string, signature string",
            "number long, prev string",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def rate_limit_stream(changes: DataFrame, limit: int) -> DataFrame:
    """Arriving changes (session_id, event_id, ts_us) with the changes of the hour up to each; state: one hour's times."""

    def step(session: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = deque(state.get[0] if state.exists else [])
        out = []
        for e in pd.concat(list(frames)).sort_values(["ts_us", "event_id"]).itertuples():
            while times and times[0] < e.ts_us - 3_600_000_000:
                times.popleft()
            times.append(e.ts_us)
            out.append((session[0], e.event_id, len(times), len(times) <= limit))
        state.update((list(times),))
        yield pd.DataFrame(out, columns=["session_id", "event_id", "changes_in_hour", "within_limit"])

    schema = "session_id string, event_id long, changes_in_hour long, within_limit boolean"
    return changes.groupBy("session_id").applyInPandasWithState(step, schema, "times array<long>", "append", GroupStateTimeout.NoTimeout)


def rolling_p95_stream(samples: DataFrame, size: int = 1024) -> DataFrame:
    """Arriving samples (session_id, event_id, ts_us, value) with the p95 of the last `size`."""

    def step(session: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else [])
        ranked = sorted(held)
        out = []
        for e in pd.concat(list(frames)).sort_values(["ts_us", "event_id"]).itertuples():
            if len(held) == size:
                del ranked[bisect_left(ranked, held.popleft())]
            held.append(float(e.value))
            insort(ranked, held[-1])
            out.append((session[0], e.event_id, ranked[(len(held) - 1) * 95 // 100]))
        state.update((list(held),))
        yield pd.DataFrame(out, columns=["session_id", "event_id", "p95"])

    return samples.groupBy("session_id").applyInPandasWithState(step, "session_id string, event_id long, p95 double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def consistency_stream(vectors: DataFrame, keep: int = 8) -> DataFrame:
    """Arriving vectors (session_id, event_id, vector) with the mean cosine to the last `keep` ones; -1 for the first."""

    def step(session: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        held = [np.array(v) for v in state.get[0]] if state.exists else []
        out = []
        for e in pd.concat(list(frames)).sort_values("event_id").itertuples():
            v = np.array(e.vector, float)
            cos = [0.0 if len(u) != len(v) or not u.any() or not v.any() else float(u @ v / np.sqrt(u @ u) / np.sqrt(v @ v)) for u in held]
            out.append((session[0], e.event_id, sum(cos) / len(cos) if cos else -1.0))
            held = (held + [v])[-keep:]
        state.update(([v.tolist() for v in held],))
        yield pd.DataFrame(out, columns=["session_id", "event_id", "consistency"])

    return vectors.groupBy("session_id").applyInPandasWithState(step, "session_id string, event_id long, consistency double", "held array<array<double>>", "append", GroupStateTimeout.NoTimeout)


def token_dedup_stream(tokens: DataFrame, issued: str = "issued_at", age: str = "120 seconds") -> DataFrame:
    """Tokens whose (session_id, nonce) is new within the watermark; older replays are expired anyway."""
    return tokens.withWatermark(issued, age).dropDuplicatesWithinWatermark(["session_id", "nonce"])


def rates_stream(events: DataFrame, ts: str, width: str, by: list[str], late: str = "0 seconds") -> DataFrame:
    """Events in tumbling windows; rows later than the watermark are dropped (our policy)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("window_us"), *by, "n")


def close_sessions_stream(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """Sessions that an explicit end or idle time has closed: (session_id, last_ts, ended); ended is false where no end came.

    events (session_id, ts timestamp, event_type) with a watermark on ts set by the caller or here.
    """
    rows = events.withWatermark("ts", "10 minutes")
    grouped = rows.groupBy("session_id", F.session_window("ts", idle)).agg(F.max("ts").alias("last_ts"), F.max((F.col("event_type") == "session_end").cast("int")).alias("e"))
    return grouped.select("session_id", "last_ts", (F.col("e") == 1).alias("ended"))


def session_ends(closed: DataFrame) -> DataFrame:
    """A made-up session_end event for each session that close_sessions_stream closed without one; its id is fixed, so replays make the same one."""
    rest = closed.where("not ended")
    return rest.select(
        "session_id",
        F.concat_ws("-", "session_id", F.unix_micros("last_ts").cast("string"), F.lit("end")).alias("event_id"),
        F.lit("session_end").alias("event_type"),
        F.lit("unknown").alias("agent_id"),
        F.unix_micros("last_ts").alias("ts_us"),
    )


def overdue_stream(queue: DataFrame, now: str, sla: str = "4 hours") -> DataFrame:
    """Pending reviews whose deadline the watermark has passed, each once, without a timer of our own.

    queue (event_id, `now` timestamp, status): enqueued reviews, and later rows with another status that resolve them.
    """
    rows = queue.withWatermark(now, "0 seconds")
    waits = rows.groupBy("event_id", F.session_window(now, sla)).agg(F.count_if(F.col("status") != "pending").alias("done"), F.min(now).alias("enqueued"))
    return waits.where("done = 0").select("event_id", "enqueued")


_STORE_BUCKETS = 64


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(_STORE_BUCKETS)).cast("int")


def append_batches(stream: DataFrame, path: str, checkpoint: str, schema: str, within: str | None = None) -> None:
    """Append arriving events to a Parquet store so that a replayed batch, or a repeated event id, adds nothing.

    within names a column in which equal event ids agree, such as the session: the store is then partitioned by a hash of it,
    and a batch reads ids only from the partitions that it touches.  Read such a store with read_appended().
    """
    from caduspark.sources.store import idempotent_append

    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
        if within is None:
            known = spark.read.schema(schema).parquet(path) if there else batch.limit(0)
            idempotent_append(known, batch).write.mode("append").parquet(path)
            return
        batch = batch.withColumn("__bucket", _bucket(within))
        known = batch.limit(0)
        if there:
            touched = [r[0] for r in batch.select("__bucket").distinct().collect()]  # at most _STORE_BUCKETS
            known = spark.read.schema(f"{schema}, __bucket int").parquet(path).where(F.col("__bucket").isin(touched))
        idempotent_append(known, batch).repartition("__bucket").write.mode("append").partitionBy("__bucket").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of a store that append_batches() wrote, with or without partitions."""
    return spark.read.schema(f"{schema}, __bucket int").parquet(path).drop("__bucket")
