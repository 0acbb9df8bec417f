"""Exact top-k search by inner product with vector-approximation files.

Vectors are integers: floor(scale * component).  The approximation file holds one byte a component and row: the number of
its cell between the vector's least and greatest component, with the cells' origin and width.  It is written
once; exact vectors stay behind.

1. Rows are dealt to lanes, queries to blocks; for each pair of a lane and a block one task scans the
   approximations, which give a lower and an upper bound of every score, and keeps what can still reach the
   lane's k-th best lower bound.
2. Per query, what cannot reach the k-th best lower bound of all lanes goes.
3. Only the rest is joined with exact vectors, which are read in order of their upper bounds until the k-th
   result is certain.

Equal vectors have equal scores, so of each vector only the k + 1 smallest ids can appear in any result; the others
(exact copies) leave before the scan and stay queries.  The scan runs in single precision, half as dear as the
exact product, with bounds widened by its rounding error; scores are exact integers (Python's, beyond 2**52).

Work is queries x rows on approximations, as exact search asks; a task holds at most LANE rows and
BLOCK queries, whatever the table.  Lanes and blocks are dealt by hash, so no key can grow hot.

Defined results: vectors that are null, or hold null or non-finite components, take no part; neither do rows with a null
id; an id that occurs more than once counts once, with its least vector; vectors are compared with
vectors of their own length only (an empty vector scores 0); a query with fewer candidates gets
them all; ties go to the smaller id; scores beyond 64 bits saturate; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caduspark.llm import shared

LANE, BLOCK, LEAST_LANE = 16_384, 8_192, 1_024
CELLS = 256
_ROUNDING = 2.0**-22


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1)


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, origin, width) of each row: a component x lies in origin + width * cell + [0, width)."""
    if not vectors.shape[1]:
        return np.zeros(vectors.shape, np.uint8), np.zeros(len(vectors)), np.ones(len(vectors))
    low, high = vectors.min(1).astype(float), vectors.max(1).astype(float)
    width = np.maximum(1.0, np.ceil((high - low + 1) / CELLS))
    cells = np.floor((vectors - low[:, None]) / width[:, None])
    return np.clip(cells, 0, CELLS - 1).astype(np.uint8), low, width


def bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of all scores, queries x rows."""
    q = queries.astype(float)
    product = (q.astype(np.float32) @ cells.T.astype(np.float32)).astype(float) * width
    base = q.sum(1)[:, None] * low + product
    size = np.abs(q).sum(1)[:, None]
    error = _ROUNDING * (q.shape[1] + 4) * size * (width * CELLS + np.abs(low)) + 1e-6
    error += size * np.where((np.abs(low) + width * CELLS) > 2.0**52, width, 0.0)  # components that doubles can't hold
    slack = width - 1
    return base + np.minimum(q, 0).sum(1)[:, None] * slack - error, base + np.maximum(q, 0).sum(1)[:, None] * slack + error


def scan(ids: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, vector id, lower, upper) of what can be among the k best of this lane, not counting the query's own id."""
    out = []
    for at in range(0, len(query_ids), 256):
        lower, upper = bounds(cells, low, width, queries[at : at + 256])
        own = query_ids[at : at + 256, None] == ids[None]
        lower[own], upper[own] = -np.inf, -np.inf
        sure = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(lower), -np.inf)
        i, j = np.nonzero((upper >= sure[:, None]) & (upper > -np.inf))
        out.append((query_ids[at + i], ids[j], lower[i, j], upper[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Exact inner products, row by row."""
    if vectors.shape[1] and float(np.abs(vectors.astype(float)).max()) * float(np.abs(queries.astype(float)).max()) * vectors.shape[1] < 2.0**62:
        return (queries * vectors).sum(1).tolist()
    return [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))) for q, v in zip(queries.tolist(), vectors.tolist())]


def _reader(k: int):
    """Rows in order of query and falling upper bound -> the k best of each query."""

    def run(batches):
        now, best = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([v for _, v in best], pa.int64()), pa.array([-s for s, _ in best], pa.int64())],
                names=["query_id", "rank", "vec_id", "score"],
            )

        for batch in batches:
            asked, ids, upper = (np.asarray(batch.column(i)) for i in range(3))
            heads = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])) if len(asked) else []
            for lo, hi in zip(heads, [*heads[1:], len(asked)]):
                if now is not None and now != asked[lo]:
                    yield done()
                    best = []
                now = int(asked[lo])
                for at in range(int(lo), int(hi), 32):
                    if len(best) == k and upper[at] < -best[-1][0]:
                        break  # no vector left can reach the k-th result
                    end = min(at + 32, int(hi))
                    found = scores_of(_matrix(batch.column(4).slice(at, end - at)), _matrix(batch.column(3).slice(at, end - at)))
                    best = sorted(best + [(-s, v) for s, v in zip(found, ids[at:end].tolist())])[:k]
        if now is not None:
            yield done()

    return run


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by `every`."""
    spark = vectors.sparkSession
    shared.tune(spark)
    raw = F.col(f"`{vector}`")
    whole = F.transform(raw, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fit = F.forall(raw, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(f"`{key}`").isNotNull() & raw.isNotNull() & fit)
    rows = rows.select(F.col(f"`{key}`").cast("long").alias("id"), whole.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = shared.write_table(rows.withColumn("dim", F.size("vector")), "vectors")
    n = rows.count()
    lanes = max(-(-n // LANE), min(64, -(-n // LEAST_LANE)), 1)
    blocks = max(1, -(-n // (every * BLOCK)))

    copies = Window.partitionBy("dim", "vector").orderBy("id")
    distinct = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)

    def cells_of(batches):
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                cells, low, width = approximate(_matrix(part.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(low), pa.array(width)], names=["id", "dim", "cells", "low", "width"]
                )

    file = distinct.select("id", "dim", "vector").mapInArrow(cells_of, "id long, dim int, cells binary, low double, width double")
    file = shared.write_table(file, "approximations")
    dealt = file.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))
    asked = rows.where(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        found = tuple(np.zeros(0) for _ in range(4))
        if len(left) and len(right):
            cells = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(len(left), -1)
            ids, low, width = (np.asarray(left.column(c)) for c in ("id", "low", "width"))
            found = scan(ids, cells, low, width, np.asarray(right.column("id")), _matrix(right.column("vector")), k)
        return pa.table({c: pa.array(x, kind) for (c, kind), x in zip((("query_id", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())), found)})

    grid = ("dim", "lane", "block")
    near = dealt.groupBy(*grid).cogroup(asked.groupBy(*grid)).applyInArrow(task, "query_id long, vec_id long, lower double, upper double")
    sure = F.nth_value("lower", k).over(Window.partitionBy("query_id").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = near.withColumn("sure", sure).where(F.col("sure").isNull() | (F.col("upper") >= F.col("sure"))).select("query_id", "vec_id", "upper")
    exact = rows.select(F.col("id").alias("vec_id"), "vector")
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    read = near.join(exact, "vec_id").join(queries, "query_id").select("query_id", "vec_id", "upper", "vector", "query")
    read = read.repartition("query_id").sortWithinPartitions("query_id", F.desc("upper"), "vec_id")
    return shared.reads(read.mapInArrow(_reader(k), "query_id long, rank int, vec_id long, score long"), rows, file)
