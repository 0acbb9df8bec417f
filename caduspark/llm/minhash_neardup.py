"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Words are runs of non-space bytes in lower case; shingles are five words (a text of one to four words is one
shingle).  A shingle weighs tf * idf, with tf its count in the document and idf = 1 + ln((1 + N) / (1 + df)).
df is counted over all documents, per hashed feature (2**18 of them, as hashing TF-IDF does), so the table of
weights has a fixed size however large the corpus; shingles themselves are told apart by 64 bits.  Two
documents link if the weighted Jaccard similarity of their shingles is THRESHOLD or more.

1. One scan counts df; one scan draws K = BANDS * ROWS consistent weighted samples of every document.
2. Documents with the same word sequence fold into the smallest id; the rest works on distinct texts.
3. Texts that agree on a band share a bucket.  A bucket is a grid of block pairs of about BLOCK texts and SHINGLES shingles
   a block at most, so a task's memory is bounded however large the bucket and however long the texts; all
   pairs of a bucket stand in one task.
4. Tasks over the samples alone find candidates: pairs that agree on at least AGREE of K places and whose
   total weights allow the threshold, each in the first band that it shares.  Only texts of candidates travel on.
5. In a task, candidates are verified on the whole texts, likeliest first; pairs that earlier
   links have joined already need no test.  Only links that join components leave the task.
6. Links give components.  Hot buckets, texts and nodes go through shared.skew_join.
A pair at the threshold shares a band with probability 0.999 and agrees on AGREE places with 0.9999.

Defined results: null, empty and blank texts link with nothing; a repeated id is one document (its texts' links
are united); a null id gets a null component and is kept; equal texts always share a component; the component
is its smallest id; an empty table gives no rows; other columns are not read.  drop_duplicates keeps, of a kept id, one row of each
different text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caduspark.llm import shared, textnum

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, AGREE = 10, 3, 15
#: Texts and distinct shingles of one block of a bucket, about; larger buckets become a grid of block pairs.
BLOCK, SHINGLES = 1_024, 1 << 19
#: Shingles of the candidates that are verified at once, so that long texts in many pairs can't fill a worker.
VERIFIED = 1 << 20
FEATURE_BITS = 18
_SLICE = 1 << 12

_rng = np.random.Generator(np.random.PCG64(77))
_R = _rng.gamma(2.0, 1.0, 1 << 16)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16))
_BETA = (np.arange(1 << 16) + 0.5) / (1 << 16)
_SALT = _rng.integers(1, 2**63, 256, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (text, hash, count), ordered by text and hash, and two hashes of each word sequence."""
    words = textnum.Words(data, offsets, lower=True)
    n = np.diff(words.first)
    text = np.repeat(np.arange(len(n)), n)
    last = np.maximum(words.first[1:] - size, words.first[:-1])  # first word of a text's last shingle
    at = np.arange(len(text))
    at = at[at <= last[text]] if len(text) else at
    of = text[at]
    hashed = words.window(at, np.minimum(at + size, words.first[of + 1]))
    order = np.argsort(hashed)
    order = order[np.argsort(of[order].astype(np.uint16) if len(n) < 1 << 16 else of[order], kind="stable")]
    of, hashed = of[order], hashed[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashed[1:] != hashed[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(of)))
    whole = np.stack([words.window(words.first[:-1], words.first[1:], which) + n.astype(np.uint64) for which in (5, 6)])
    return of[heads], hashed[heads], counts, whole


def feature(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """Documents that hold each feature, over all documents: 2**FEATURE_BITS numbers."""

    def count(batches):
        total = np.zeros(1 << FEATURE_BITS, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in textnum.chunks(batch, "t"):
                of, hashed, _, _ = shingles(data, offsets)
                pair = np.unique(of << FEATURE_BITS | feature(hashed))
                total += np.bincount(pair & ((1 << FEATURE_BITS) - 1), minlength=len(total))
        if total.any():
            salt = int(textnum.mix(total[:1].astype(np.uint64) + total[-1:].astype(np.uint64))[0] % np.uint64(1024))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(0, len(total), _SLICE), pa.int32()), pa.array([salt] * (len(total) // _SLICE), pa.int32()), pa.array([total[i : i + _SLICE].tobytes() for i in range(0, len(total), _SLICE)])],
                names=["slice", "salt", "counts"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"slice": table.column("slice")[:1], "salt": table.column("salt")[:1], "counts": pa.array([total.tobytes()])})

    schema = "slice int, salt int, counts binary"
    parts = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, schema)
    parts = parts.groupBy("slice", "salt").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema)
    out = np.zeros(1 << FEATURE_BITS, np.int64)
    for row in parts.collect():  # 64 rows
        out[row["slice"] : row["slice"] + _SLICE] = np.frombuffer(row["counts"], np.int64)
    return out


def sample(of: np.ndarray, hashed: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """k consistent weighted samples of each text (uint64); 0 for a text without shingles."""
    out = np.zeros((texts, k), np.uint64)
    if not len(of):
        return out
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    log_w = np.log(weight)
    segment = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(of))))
    for i in range(k):
        h = textnum.mix(hashed ^ _SALT[i])
        r, beta = _R[h & np.uint64(0xFFFF)], _BETA[(h >> np.uint64(32)) & np.uint64(0xFFFF)]
        t = np.floor(log_w / r + beta)
        a = _LOG_C[(h >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta + 1)
        hit = np.flatnonzero(a == np.minimum.reduceat(a, heads)[segment])
        hit = hit[np.append(True, segment[hit][1:] != segment[hit][:-1])]
        out[of[heads], i] = textnum.mix(hashed[hit] + t[hit].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SALT[i])
    return out


def _signer(idf: np.ndarray):
    """(id, tid, t) -> hashes, weight, distinct shingles, marks (a byte of each sample) and band keys of texts with words."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in textnum.pieces(batch.column(2)):
                of, hashed, counts, whole = shingles(data, offsets)
                weight = counts * idf[feature(hashed)]
                drawn = sample(of, hashed, weight, hi - lo, BANDS * ROWS)
                bands = np.zeros((hi - lo, BANDS), np.uint64)
                for b in range(BANDS):
                    for r in range(ROWS):
                        bands[:, b] = textnum.mix(bands[:, b] + drawn[:, b * ROWS + r] + np.uint64(b + 1))
                total, size = np.bincount(of, weight, hi - lo), np.bincount(of, minlength=hi - lo)
                some = np.flatnonzero(size > 0)
                marks = (drawn >> np.uint64(56)).astype(np.uint8)
                rows = pa.array(some + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(whole[0][some].view(np.int64)),
                        pa.array(whole[1][some].view(np.int64)),
                        pa.array(total[some]),
                        pa.array(size[some]),
                        pa.array([m.tobytes() for m in marks[some]], pa.binary()),
                        textnum.lists(bands[some].ravel().view(np.int64), np.full(len(some), BANDS), pa.int64()),
                    ],
                    names=["id", "tid", "h1", "h2", "weight", "size", "marks", "keys"],
                )

    return run


def weighted_jaccard(a: tuple, b: tuple, rows: int) -> np.ndarray:
    """Similarity of the i-th texts of two lists of distinct shingles (text, hash, weight)."""
    of = np.concatenate([a[0], b[0]])
    hashed = np.concatenate([a[1], b[1]])
    weight = np.concatenate([a[2], b[2]])
    order = np.lexsort((hashed, of))
    of, hashed, weight = of[order], hashed[order], weight[order]
    twin = np.flatnonzero((of[1:] == of[:-1]) & (hashed[1:] == hashed[:-1]))
    shared_weight = np.bincount(of[twin], np.minimum(weight[twin], weight[twin + 1]), rows)
    total = np.bincount(of, weight, rows)
    return np.divide(shared_weight, total - shared_weight, out=np.zeros(rows), where=total > 0)


def candidates(weight: np.ndarray, marks: np.ndarray, keys: np.ndarray, side: np.ndarray | None, band: int, threshold: float):
    """(i, j, places that agree) of the candidates of one block pair of a bucket of `band`, strip by strip; side None: one block."""
    n = len(weight)
    for at in range(0, n, 128):
        to = min(at + 128, n)
        if n <= 48:
            agree = (marks[at:to, None] == marks[None]).sum(2)
        else:
            agree = np.zeros((to - at, n), np.int16)
            for k in range(marks.shape[1]):
                agree += marks[at:to, k, None] == marks[None, :, k]
        ok = (agree >= AGREE) & (np.arange(n)[None] > np.arange(at, to)[:, None])
        ok &= np.minimum(weight[at:to, None], weight[None]) >= threshold * np.maximum(weight[at:to, None], weight[None]) * (1 - 1e-9)
        if side is not None:
            ok &= side[at:to, None] != side[None]
        for k in range(band):  # a pair belongs to the first band that it shares
            ok &= keys[at:to, k, None] != keys[None, :, k]
        i, j = np.nonzero(ok)
        yield (i + at).astype(np.int32), j.astype(np.int32), agree[i, j].astype(np.int8)  # up to half a block squared of them are held


HEAD = ("band", "key", "i", "j")


def _groups(batches, columns: tuple[str, ...]):
    """(head, rows) of the block pairs of a task: batches come ordered by HEAD, and a block pair's rows as one table of `columns`."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        heads = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in HEAD]
        new = np.flatnonzero(np.any([h[1:] != h[:-1] for h in heads], axis=0)) + 1
        rest = batch.select(list(columns))
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(batch)]):
            head = tuple(int(h[lo]) for h in heads)
            if head != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = head
            held.append(rest.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def _samples(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """weight, marks, keys, side of a block pair's rows."""
    marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(len(rows), BANDS * ROWS)
    keys = np.asarray(rows.column("keys").combine_chunks().flatten()).reshape(len(rows), BANDS)
    return np.asarray(rows.column("weight")), marks, keys, np.asarray(rows.column("side"))


_ASKED = ("id", "tid", *HEAD, "side", "weight", "marks", "keys")


def _asker(threshold: float):
    """Rows of a block pair that have a candidate there."""

    def run(batches):
        for (band, _, i, j), rows in _groups(batches, _ASKED):
            if len(rows) < 2:
                continue
            weight, marks, keys, side = _samples(rows)
            hit = np.zeros(len(rows), bool)
            for x, y, _ in candidates(weight, marks, keys, side if i != j else None, band, threshold):
                hit[x] = hit[y] = True
            if hit.any():
                yield from rows.filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def links_of(ids: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray, like: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links among candidates (i, j) that join components; sets are the shingles (hash, weight) of each text."""

    def some(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = [sets[k] for k in which.tolist()]
        return np.repeat(np.arange(len(part)), [len(h) for h, _ in part]), np.concatenate([h for h, _ in part]), np.concatenate([w for _, w in part])

    order = np.argsort(-like, kind="stable")  # likeliest first: later pairs are often joined already
    i, j = i[order], j[order]
    size = np.array([len(h) for h, _ in sets])
    root, out = np.arange(len(ids)), []
    while len(i):
        n = max(1, int(np.searchsorted(np.cumsum(size[i[:256]] + size[j[:256]]), VERIFIED, "right")))
        near = weighted_jaccard(some(i[:n]), some(j[:n]), n) >= threshold - 1e-12
        for x, y in zip(i[:n][near].tolist(), j[:n][near].tolist()):
            if root[x] != root[y]:
                out.append((int(ids[x]), int(ids[y])))
                root[root == root[y]] = root[x]
        i, j = i[n:], j[n:]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return out


def _linker(idf: np.ndarray, threshold: float):
    """Links of the block pairs of one task; shingles are held instead of texts."""

    def shingled(batches):
        for batch in batches:
            hashes, weights, sizes = [], [], []
            for lo, hi, data, offsets in textnum.pieces(batch.column(batch.schema.get_field_index("t"))):
                of, hashed, counts, _ = shingles(data, offsets)
                hashes.append(hashed.view(np.int64))
                weights.append(counts * idf[feature(hashed)])
                sizes.append(np.bincount(of, minlength=hi - lo))
            if sizes:
                sizes = np.concatenate(sizes)
                lists = [textnum.lists(np.concatenate(x), sizes, kind) for x, kind in ((hashes, pa.int64()), (weights, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in _ASKED), *lists], names=[*_ASKED, "hashes", "weights"])

    def run(batches):
        for (band, _, a, b), rows in _groups(shingled(batches), (*_ASKED, "hashes", "weights")):
            twice = np.unique(np.stack([np.asarray(rows.column("id")), np.asarray(rows.column("tid"))]), axis=1, return_index=True)[1]
            rows = rows.take(pa.array(np.sort(twice)))  # equal rows of the table stand here once
            if len(rows) < 2:
                continue
            weight, marks, keys, side = _samples(rows)
            found = list(candidates(weight, marks, keys, side if a != b else None, band, threshold))
            i, j, like = (np.concatenate([f[k] for f in found]) for k in range(3))
            lists = [rows.column(c).combine_chunks() for c in ("hashes", "weights")]
            cuts = np.asarray(lists[0].offsets)
            hashed, w = np.asarray(lists[0].values).view(np.uint64), np.asarray(lists[1].values)
            sets = [(hashed[x:y], w[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            out = links_of(np.asarray(rows.column("id")), sets, i, j, like, threshold)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, component_id, kept) of every document; kept is the smallest id of each component."""
    spark = docs.sparkSession
    shared.tune(spark)
    raw = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.coalesce(raw, F.lit(""))).alias("tid"), raw.alias("t"))
    df = document_frequencies(docs, text)
    idf = 1 + np.log((1 + docs.count()) / (1 + df))
    sampled = "weight double, size long, marks binary, keys array<long>"
    signed = rows.where("id is not null").mapInArrow(_signer(idf), f"id long, tid long, h1 long, h2 long, {sampled}")
    signed = shared.write_table(signed, "signed")
    folded = signed.groupBy("h1", "h2").agg(F.min(F.struct("id", "tid", "weight", "size", "marks", "keys")).alias("rep"), F.count("*").alias("n"))
    folded = shared.write_table(folded.select("h1", "h2", "n", "rep.*"), "folded")
    reps = folded.where("n > 1").select("h1", "h2", "n", F.col("id").alias("rep"))
    copies = shared.skew_join(signed.select("id", "h1", "h2"), reps, ["h1", "h2"], signed.count())
    copies = copies.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    banded = folded.select("id", "tid", "size", F.posexplode("keys").alias("band", "key"))
    many = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    many = shared.write_table(many, "many")
    met = shared.skew_join(banded.drop("size"), many, ["band", "key"], BANDS * folded.count())
    met = met.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / SHINGLES)).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("id", "tid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("id", "tid", "band", "key", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    met = met.join(folded.select("id", "tid", "weight", "marks", "keys").hint("merge"), ["id", "tid"])
    met = met.select(*_ASKED).repartition(*HEAD).sortWithinPartitions(*HEAD)
    asked = met.mapInArrow(_asker(threshold), "id long, tid long, band int, key long, i int, j int, side int, weight double, marks binary, keys array<long>")
    asked = shared.write_table(asked, "asked")
    shared.free_shuffles(spark)

    tasks = rows.join(asked.hint("merge"), ["id", "tid"]).repartition(*HEAD).sortWithinPartitions(*HEAD)
    links = shared.write_table(tasks.mapInArrow(_linker(idf, threshold), "a long, b long").distinct(), "links")
    shared.free_shuffles(spark)
    found = shared.connected_components(links.unionByName(copies))
    for table in (signed, folded, many, asked, links):
        shared.drop_table(table)
    out = rows.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    out = out.select(F.col("id").alias(key), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    return shared.reads(out, *found._reads)


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, the smallest id; of its rows, one of each different text; null ids stay."""
    marked = near_duplicates(docs, key, text)
    kept = marked.where("kept").select(F.col(key).alias("__kept"))
    named = docs.where(F.col(f"`{key}`").isNotNull()).withColumn("__tid", F.xxhash64(F.col(f"`{text}`")))
    out = named.join(kept, named[key].cast("long") == kept["__kept"]).dropDuplicates([key, "__tid"]).drop("__kept", "__tid")
    return shared.reads(out.unionByName(docs.where(F.col(f"`{key}`").isNull())), *marked._reads)
