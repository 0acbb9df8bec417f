"""Event stores: schemas, readers by path, idempotent append, fan-out, chained reads, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caduspark.functions import fixed

EVENT = (
    "event_id string, session_id string, timestamp string, sequence_number long, event_type string, agent_id string, agent_framework string, "
    "input_hash string, output_hash string, redacted_input string, redacted_output string, phi_tags_detected array<string>, risk_tier string, "
    "confidence_score double, escalation_decision string, prev_event_hash string, signature string"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = EVENT, strict: bool = True) -> DataFrame:
    """JSON lines; a malformed line fails the read, or is skipped where strict is off."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def jdbc_url(path: str) -> str:
    """The JDBC URL of a SQLite file's path; other paths as they are."""
    return f"jdbc:sqlite:{path}" if path.endswith((".sqlite", ".sqlite3", ".db")) else path


def location(policy) -> str | None:
    """Where a policy keeps its events, as read_store takes it; None for the memory backend."""
    if policy.backend == "memory":
        return None
    if policy.backend not in ("jsonl", "parquet", "sqlite", "jdbc"):
        raise ValueError(f"unknown audit backend: {policy.backend}")
    return f"jdbc:sqlite:{policy.path}" if policy.backend == "sqlite" else policy.path


def spread(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """df over all cores where it would be read by fewer tasks (few, large row groups); for work that outweighs a shuffle.

    task_bytes bounds what the planner expects a task to read, so that tasks grow in number and not in length.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if task_bytes is not None:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        tasks = max(tasks, -(-size // task_bytes))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def read_store(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Reader by path: jdbc:..., SQLite files by their suffix, .parquet, else JSON lines."""
    path = jdbc_url(path)
    if path.startswith("jdbc:"):
        rows = spark.read.format("jdbc").option("url", path).option("dbtable", "audit_events").load()
        return rehydrate(rows, schema)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_jsonl(spark, path, schema)


def rehydrate(rows: DataFrame, schema: str = EVENT, payload: str = "payload") -> DataFrame:
    """Typed events from a JSON payload column, with the defaults of absent fields; an unknown event type or tier fails the read."""
    e = rows.select(F.from_json(payload, schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    for name, known in (("event_type", fixed.EVENT_TYPES), ("risk_tier", list(fixed.THRESHOLDS))):
        if name in e.columns:
            wrong = F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.col(name))).cast("string")
            e = e.withColumn(name, F.when(F.col(name).isNull() | F.col(name).isin(known), F.col(name)).otherwise(wrong))
    defaults = {"agent_id": "unknown", "agent_framework": "unknown", "input_hash": "", "output_hash": "", "prev_event_hash": "", "signature": "", "redacted_input": "{}", "redacted_output": "{}"}
    return e.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in e.columns})


def read_session(events: DataFrame, session_id: str) -> DataFrame:
    return events.where(F.col("session_id") == session_id).orderBy("sequence_number")


def list_sessions(events: DataFrame) -> DataFrame:
    return events.select("session_id").distinct().orderBy("session_id")


def sessions_of_files(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """Session ids from the names of one-file-a-session stores."""
    name = F.regexp_extract(F.col("_metadata.file_name"), f"^(.*)\\{suffix}$", 1)
    return spark.read.text(path).select(name.alias("session_id")).where("session_id <> ''").distinct()


def chained_read(stores: list[DataFrame]) -> DataFrame:
    """For each session, the rows of the first store that has any."""
    rows = None
    for place, store in enumerate(stores):
        one = store.withColumn("__place", F.lit(place))
        rows = one if rows is None else rows.unionByName(one)
    best = F.min("__place").over(Window.partitionBy("session_id"))
    return rows.withColumn("__best", best).where("__place = __best").drop("__place", "__best")


def chained_sessions(stores: list[DataFrame]) -> DataFrame:
    rows = stores[0].select("session_id")
    for store in stores[1:]:
        rows = rows.union(store.select("session_id"))
    return rows.distinct()


def idempotent_append(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch to append: one a new event id, none of a known one."""
    return batch.dropDuplicates(["event_id"]).join(existing.select("event_id"), "event_id", "left_anti")


def duplicates(events: DataFrame) -> DataFrame:
    """(session, sequence) pairs that occur more than once, which an append-only store must not hold."""
    return events.groupBy("session_id", "sequence_number").agg(F.count("*").alias("n")).where("n > 1")


def keep_last(events: DataFrame, limit: int, arrival: str) -> DataFrame:
    """The last `limit` events by arrival (a first-in-first-out store)."""
    return events.orderBy(F.desc(arrival)).limit(limit)


def fan_out(batch: DataFrame, sinks: list) -> None:
    """The same batch to all sinks in order; the first error surfaces."""
    batch.persist()
    try:
        for sink in sinks:
            sink(batch)
    finally:
        batch.unpersist()


def append_jsonl(batch: DataFrame, path: str) -> None:
    batch.write.mode("append").json(path)


def append_by_session(batch: DataFrame, path: str) -> None:
    """JSON lines in a folder a session, one file a batch and session; by all cores, since the work is files and not bytes."""
    tasks = 4 * batch.sparkSession.sparkContext.defaultParallelism  # a number of our own is not made fewer for want of bytes
    batch.repartition(tasks, "session_id").write.mode("append").partitionBy("session_id").json(path)


def span_attributes(events: DataFrame) -> DataFrame:
    """Attributes of one span an event: counts, never values."""
    return events.select("event_id", "session_id", "event_type", "agent_id", "sequence_number", "risk_tier", "confidence_score", F.size("phi_tags_detected").alias("phi_tags"))


def enqueue(decisions: DataFrame, at_us: Column, sla_hours: int = 4) -> DataFrame:
    """Pending reviews with their deadline."""
    at = at_us.cast("long")
    return decisions.withColumns({"enqueued_us": at, "deadline_us": at + sla_hours * 3_600_000_000, "status": F.lit("pending")})


def overdue(queue: DataFrame, now_us: int) -> DataFrame:
    return queue.where((F.col("status") == "pending") & (F.col("deadline_us") < now_us))


def resolve(queue: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Queue with the listed reviews (key, new_status) resolved."""
    done = resolved.select(F.col(key).alias("__k"), "new_status")
    return queue.join(done, queue[key] == F.col("__k"), "left").withColumn("status", F.coalesce("new_status", "status")).drop("__k", "new_status")
