"""Operational metrics: rolling p95, histograms, rates."""

from __future__ import annotations

import functools
import math
import time
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Upper bounds of the latency histogram, in seconds.
BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def rolling_p95(df: DataFrame, by: str, order: str, value: str, size: int = 1024, budget: float | None = None) -> DataFrame:
    """p95 of the last `size` samples: element int(0.95 * (n - 1)) of the sorted window; 0 without samples, nulls aside, NaN above all.

    A window function would sort the window anew for every row.  Here the rows of a key pass one task in order, and a sorted
    list takes one value in and one out: the state is `size` numbers whatever the key's rows.
    """
    rows = df.drop("p95").repartition(by).sortWithinPartitions(by, order)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ranked, nans = object(), deque(), [], 0
        for batch in batches:
            out = []
            for k, v in zip(batch.column(by).to_pylist(), batch.column(value).to_pylist()):
                if k != key:
                    key, held, ranked, nans = k, deque(), [], 0
                if len(held) == size:
                    gone = held.popleft()
                    if gone is not None and gone != gone:
                        nans -= 1
                    elif gone is not None:
                        del ranked[bisect_left(ranked, gone)]
                held.append(v)
                if v is not None and v != v:
                    nans += 1
                elif v is not None:
                    insort(ranked, v)
                at = (len(ranked) + nans - 1) * 95 // 100
                out.append(0.0 if at < 0 else float(ranked[at]) if at < len(ranked) else math.nan)
            yield batch.append_column("p95", pa.array(out, pa.float64()))

    out = rows.mapInArrow(roll, StructType([*rows.schema.fields, StructField("p95", DoubleType())]))
    return out if budget is None else out.withColumn("within_budget", F.col("p95") <= budget)


def histogram(df: DataFrame, by: list[str], value: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Samples by upper bound; the last bucket is open (null bound)."""
    bound = F.lit(None).cast("double")
    for b in reversed(buckets):
        bound = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(bound)
    return df.withColumn("le", bound).groupBy(*by, "le").agg(F.count("*").alias("n"))


def rate(df: DataFrame, ts_us: str, minutes: int, by: list[str]) -> DataFrame:
    """Events in tumbling windows of some minutes."""
    size = minutes * 60_000_000
    return df.withColumn("window_us", F.floor(F.col(ts_us) / size) * size).groupBy("window_us", *by).agg(F.count("*").alias("n"))


def latency_quantiles(df: DataFrame, ts_us: str, value: str, minutes: int = 5) -> DataFrame:
    """Exact p50, p95 and p99 in tumbling windows."""
    size = minutes * 60_000_000
    return df.withColumn("window_us", F.floor(F.col(ts_us) / size) * size).groupBy("window_us").agg(
        *[F.percentile(value, q).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)]
    )


def scan_cached(df: DataFrame, text: str, scan) -> DataFrame:
    """scan() once per distinct text, joined back by the text's SHA-256, so that texts cross one shuffle and no sort."""
    rows = df.withColumn("__text_hash", F.sha2(F.col(text), 256))
    once = scan(rows.groupBy("__text_hash").agg(F.first(text).alias(text))).drop(text)
    return rows.join(once, "__text_hash", "left").drop("__text_hash")


@dataclass
class Budget:
    """Latencies, in milliseconds, of the driver's own calls against a limit of their p95."""

    name: str
    limit_ms: float
    samples: list[float] = field(default_factory=list)

    def p95(self) -> float:
        """Element int(0.95 * (n - 1)) of the sorted samples; 0 without samples."""
        return sorted(self.samples)[int(0.95 * (len(self.samples) - 1))] if self.samples else 0.0

    def holds(self) -> bool:
        return self.p95() <= self.limit_ms


def timed(budget: Budget) -> Callable:
    """Decorator: the time of each call goes into the budget, failed calls included."""

    def wrap(call: Callable) -> Callable:
        @functools.wraps(call)
        def run(*args, **kwargs):
            begun = time.perf_counter()
            try:
                return call(*args, **kwargs)
            finally:
                budget.samples.append((time.perf_counter() - begun) * 1e3)

        return run

    return wrap
