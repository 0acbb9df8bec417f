"""Substring dedup: remove every word of a window of `window` words that also starts anywhere else.

Method: seed and extend.  Each document is winnowed: of every run of window - seed + 1 consecutive seeds
(hashes of `seed` words) the smallest is an anchor, so two equal windows share an anchor at the same
place.  Each window belongs to one anchor; the consecutive windows of one anchor, with all the words they
span, are its *reach*: the seed extended both ways as far as this anchor answers for it.  Anchors are
joined across the corpus by their hash.  An anchor met once ends there.  Where all its occurrences have
the same reach, the whole reach repeats (an extension that never breaks).  Otherwise the reach breaks
somewhere and its windows are compared one by one, again by a count, never in pairs; runs of repeated
windows are the maximal repeats.

Shuffles: anchors (about 7 % of the words) twice, windows only at broken reaches, the text twice.  Anchors and windows
are counted with partial sums on the map side; rows meet the counts through shared.skew_join, so a passage
that stands in a third of all documents is never one task's load.  Equality is decided by 128 bits: two
64-bit hashes of the seed and the reach, or of the window.

Defined results: null, empty and blank texts have no words and nothing is removed from them; texts shorter than
the window are kept whole; a row that occurs twice (same id, same text) counts as two documents, so both
copies lose what they share; rows with one id and different texts, and rows with a null id, are documents of their own.
An empty table gives an empty table.  Other columns pass through; a column of the input with the name of an added one goes on
as <name>_in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caduspark.llm import shared, textnum

WINDOW, SEED = 35, 8
#: Columns that remove_repeats adds.
ADDED = ("n_words", "n_removed", "kept", "kept_sha256")


def anchors_of(words: textnum.Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, reach hash) of each anchor; first window counts within its text."""
    n = len(words.start)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty, empty
    at = np.arange(n - seed + 1)
    seeds = words.window(at, at + seed)
    width = window - seed + 1
    best, have = at, 1
    while have < width:  # leftmost smallest seed of ever wider runs
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(seeds[right] < seeds[left], right, left)
        have += step
    counts = np.diff(words.first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(best))
    start = start[text_of[: len(best)] == text_of[start + window - 1]]
    if not len(start):
        return empty, empty, empty, empty, empty
    text, chosen = text_of[start], best[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    number = np.diff(np.append(heads, len(start)))
    a = start[heads]
    reach = words.window(a, a + number + window - 1, 2) + number.astype(np.uint64)
    return text[heads], a - words.first[text[heads]], number, seeds[chosen[heads]].view(np.int64), reach.view(np.int64)


def _seeder(window: int, seed: int):
    """(key, tid, text) -> anchors."""

    def run(batches):
        for batch in batches:
            keys, tids = batch.column(0), batch.column(1)
            for lo, _, data, offsets in textnum.pieces(batch.column(2)):
                text, first, number, anchor, reach = anchors_of(textnum.Words(data, offsets), window, seed)
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(rows), tids.take(rows), pa.array(first, pa.int32()), pa.array(number, pa.int32()), pa.array(anchor), pa.array(reach)],
                    names=["key", "tid", "first", "number", "anchor", "reach"],
                )

    return run


def _windows(window: int):
    """(key, tid, text, broken reaches) -> two hashes of each window of the broken reaches."""

    def run(batches):
        for batch in batches:
            keys, tids, broken = batch.column(0), batch.column(1), batch.column(3)
            for lo, hi, data, offsets in textnum.pieces(batch.column(2)):
                words = textnum.Words(data, offsets)
                part = broken.slice(lo, hi - lo)
                flat, size = part.flatten(), np.asarray(part.value_lengths())
                first, number = (np.asarray(flat.field(c)).astype(np.int64) for c in ("first", "number"))
                text = np.repeat(np.repeat(np.arange(hi - lo), size), number)
                start = np.repeat(first, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                at = words.first[text] + start
                rows = pa.array(text + lo)
                h1, h2 = words.window(at, at + window, 3), words.window(at, at + window, 4)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(rows), tids.take(rows), pa.array(start, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    names=["key", "tid", "first", "h1", "h2"],
                )

    return run


def cut(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, first: np.ndarray, number: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words removed, bytes kept of each text, those bytes) of some texts and their runs (text, first window, windows).

    The kept words of a text are joined by one space each.
    """
    start, end, first_word = textnum.bounds(data, offsets)
    n = np.diff(first_word)
    change = np.zeros(len(start) + 1, np.int32)
    np.add.at(change, first_word[text] + first, 1)
    np.add.at(change, np.minimum(first_word[text] + first + number + window - 1, first_word[text + 1]), -1)
    gone = np.cumsum(change[:-1]) > 0
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first_word])
    of, start, end = np.repeat(np.arange(len(n)), n)[~gone], start[~gone], end[~gone]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    between = end[:-1][of[1:] == of[:-1]]  # white space after a kept word that is not its text's last one
    data = data.copy()
    data[between] = 0x20
    inside[between] = True
    sizes = np.bincount(of, end - start, len(n)).astype(np.int64) + np.maximum(np.bincount(of, minlength=len(n)) - 1, 0)
    return n, removed, sizes, data[inside]


def _cutter(window: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def run(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for lo, hi, data, offsets in textnum.pieces(texts):
            part = runs.slice(lo, hi - lo)
            flat, size = part.flatten(), np.asarray(part.value_lengths().fill_null(0))
            first, number = (np.asarray(flat.field(c)).astype(np.int64) for c in ("first", "number"))
            n, removed, sizes, kept = cut(data, offsets, np.repeat(np.arange(hi - lo), size), first, number, window)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            kept = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(ends), pa.py_buffer(kept))
            out.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), kept], fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs plus n_words, n_removed, kept (text), kept_sha256; see the module's docstring."""
    if not 0 < seed <= window:
        raise ValueError("seed must lie in 1..window")
    spark = docs.sparkSession
    shared.tune(spark)
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    key_type, text_at = docs.schema[key].dataType.simpleString(), inner[names.index(text)]
    base = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)])
    base = base.withColumn("__tid", F.xxhash64(F.coalesce(text_at, F.lit(""))))
    slim = base.select(F.col(inner[names.index(key)]).alias("key"), F.col("__tid").alias("tid"), F.col(text_at).alias("text"))

    seeds = slim.mapInArrow(_seeder(window, seed), f"key {key_type}, tid long, first int, number int, anchor long, reach long")
    seeds = shared.write_table(seeds, "anchors")
    met = seeds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi")).where("n > 1")
    met = shared.write_table(met.select("anchor", "n", (F.col("lo") != F.col("hi")).alias("breaks")), "met")
    shared.free_shuffles(spark)
    reaches = shared.skew_join(seeds.drop("reach"), met, ["anchor"], seeds.count())
    runs = F.struct("first", "number")
    reaches = reaches.groupBy("key", "tid").agg(  # sets: of equal rows one stands for all
        F.collect_set(F.when(F.col("breaks"), runs)).alias("broken"), F.collect_set(F.when(~F.col("breaks"), runs)).alias("whole")
    )
    reaches = shared.write_table(reaches, "reaches")
    shared.free_shuffles(spark)
    shared.drop_table(seeds)
    shared.drop_table(met)

    def beside(left: DataFrame, right: DataFrame, key: str, tid: str, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"key": "__k", "tid": "__t"})
        return left.join(right, left[key].eqNullSafe(right["__k"]) & (left[tid] == right["__t"]), how).drop("__k", "__t")

    broken = reaches.select("key", "tid", "broken").where(F.size("broken") > 0)
    windows = beside(slim, broken, "key", "tid", "inner").mapInArrow(_windows(window), f"key {key_type}, tid long, first int, h1 long, h2 long")
    windows = shared.write_table(windows, "windows")
    shared.free_shuffles(spark)
    twice = shared.write_table(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    again = shared.skew_join(windows, twice, ["h1", "h2"], windows.count()).select("key", "tid", "first", F.lit(1).alias("number"))
    whole = reaches.where(F.size("whole") > 0).select("key", "tid", F.inline("whole"))
    repeats = again.unionByName(whole).groupBy("key", "tid").agg(F.collect_set(runs).alias("__runs"))
    repeats = shared.write_table(repeats, "repeats")
    shared.free_shuffles(spark)
    for table in (reaches, windows, twice):
        shared.drop_table(table)

    out = beside(base, repeats, inner[names.index(key)], "__tid", "left").withColumn("__cut", _cutter(window)(F.col(text_at), F.col("__runs")))
    taken = [c.lower() for c in ADDED]
    passed = [F.col(i).alias(f"{c}_in" if c.lower() in taken else c) for c, i in zip(names, inner)]
    out = out.select(*passed, *[F.col(f"__cut.{c}") for c in ADDED[:3]])
    return shared.reads(out.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)), repeats)
