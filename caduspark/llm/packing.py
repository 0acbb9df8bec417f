"""Packing: documents into sequences of `window` tokens by non-negative least squares.

Each document is cut by itself: full windows, a body that is a multiple of window / 32 tokens (three quarters of the
documents, by hash, cut theirs once more, so that every length occurs whatever the documents), and a tail
shorter than that.  The histogram of lengths (at most window entries) is all the driver sees.  For the
bodies, every combination of two to four lengths that fills a window exactly is a column; non-negative
least squares solves how often each is repeated so that the histogram comes out; the repeats are rounded down.
What rounding leaves, and the tails, are packed greedily, largest first, on the histogram.  The outcome is a
short list of patterns with repeats; every piece finds its sequence and place by arithmetic from its rank
among the pieces of its length.

Defined results: null and empty texts hold the closing id only; every id lies in exactly one piece; equal texts and
repeated rows are packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caduspark.llm import shared
from caduspark.llm.bpe_ids import encode_array

WINDOW, PARTS, CLOSING = 2048, 32, 1
#: Columns of places.
PLACE = ("length", "first", "last", "take", "sequence", "base")


def cut(n: int, seed: int, window: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    unit = max(1, window // PARTS)
    full, rest = divmod(n, window)
    body, tail = divmod(rest, unit)
    pieces = [window] * full
    if body > 1 and seed & 3:
        first = 1 + (seed >> 2) % (body - 1)
        pieces += [first * unit, (body - first) * unit]
    elif body:
        pieces.append(body * unit)
    return pieces + [tail] * (tail > 0)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Lawson and Hanson's active set method: least |a x - b| with x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        if not n or w.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[int(w.argmax())] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if not active.any() or s[active].min() > 1e-12:
                break
            low = active & (s <= 1e-12)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
    return x


def greedy(left: Counter, window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fill windows from the largest length down; each pattern is repeated while its lengths last."""
    out = []
    left = Counter({k: v for k, v in left.items() if v > 0})
    while left:
        room, pattern = window, []
        for size in sorted(left, reverse=True):
            take = min(room // size, left[size])
            if take:
                pattern.append((size, take))
                room -= take * size
        times = min(left[size] // take for size, take in pattern)
        out.append((pattern, times))
        for size, take in pattern:
            left[size] -= take * times
            if not left[size]:
                del left[size]
    return out


def patterns(histogram: dict[int, int], window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(lengths with how many of each a sequence holds, how many sequences)]; uses every piece once."""
    left = Counter(histogram)
    unit = max(1, window // PARTS)
    out = []
    if left.get(window):
        out.append(([(window, 1)], left.pop(window)))
    have = [s for s in left if s % unit == 0]
    parts = [c for k in (2, 3, 4) for c in combinations_with_replacement(sorted(s // unit for s in have), k) if sum(c) * unit == window]
    if parts:
        row = {s: i for i, s in enumerate(sorted(have))}
        a = np.zeros((len(row), len(parts)))
        for j, c in enumerate(parts):
            for s in c:
                a[row[s * unit], j] += 1
        b = np.array([left[s] for s in sorted(have)], float)
        x = nnls(a, b / b.max()) * b.max()
        for j in np.argsort(-x, kind="stable"):
            need = Counter(s * unit for s in parts[j])
            times = min(int(x[j] + 1e-6), *(left[s] // k for s, k in need.items()))
            if times > 0:
                out.append((sorted(need.items(), reverse=True), times))
                for s, k in need.items():
                    left[s] -= k * times
    return out + greedy(left, window)


def places(found: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, a sequence's share, first sequence, first offset)."""
    used: Counter = Counter()
    sequence, rows = 0, []
    for pattern, times in found:
        offset = 0
        for size, take in pattern:
            rows.append((size, used[size], used[size] + take * times, take, sequence, offset))
            used[size] += take * times
            offset += size * take
        sequence += times
    return rows


def cut_documents(docs: DataFrame, path: str, key: str, text: str, window: int, closing: int, with_ids: bool) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens[, ids]) of all pieces."""

    def run(batches):
        for batch in batches:
            keys, seeds = batch.column(0), np.asarray(batch.column(1))
            for lo, hi, ids, counts in encode_array(path, batch.column(2)):
                rows, starts, lengths, crcs, totals, kept = [], [], [], [], [], []
                at = 0
                for i, n in enumerate(counts.tolist()):
                    whole = np.append(ids[at : at + n], np.uint32(closing)).astype("<u4")
                    at += n
                    raw, start = whole.tobytes(), 0
                    for size in cut(n + 1, int(seeds[lo + i]) & 0x7FFFFFFF, window):
                        rows.append(lo + i)
                        starts.append(start)
                        lengths.append(size)
                        crcs.append(zlib.crc32(raw[4 * start : 4 * (start + size)]))
                        totals.append(n + 1)
                        if with_ids:
                            kept.append(whole[start : start + size].astype(np.int32))
                        start += size
                out = [keys.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
                names = ["doc_key", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{key}`")).alias("s"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    if window < 1:
        raise ValueError("window must be positive")
    spark = docs.sparkSession
    shared.tune(spark)
    pieces = shared.write_table(cut_documents(docs, path, key, text, window, closing, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    total = sum(histogram.values())
    found = np.array(places(patterns(histogram, window)), np.int64).reshape(-1, len(PLACE))
    where = spark.createDataFrame(pa.table(dict(zip(PLACE, found.T))))  # a few rows for each length; as Arrow it needs no Python workers
    buckets = max(64, total // 20_000)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_key", "start"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_key", "start", "ids_crc32")
    ranked = dealt.join(before.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    placed = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (ranked["rank"] >= where["first"]) & (ranked["rank"] < where["last"])).drop(where["length"])
    turn = F.col("rank") - F.col("first")
    names = [F.col("doc_key").alias(key), "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    return placed.select(
        *names,
        (F.col("sequence") + F.floor(turn / F.col("take"))).alias("sequence_id"),
        (F.col("base") + F.pmod(turn, F.col("take")) * F.col("length")).alias("offset"),
    )
