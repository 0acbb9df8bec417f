"""Quality: attention-based multiple-instance learning.

A document is a bag of passages (`PASSAGE` consecutive words, the last one shorter).  Each passage is
described by shares of kinds of characters and words and by its hashed words and pairs of letters
(`BUCKETS` shares of each), encoded h = tanh(W x + b), weighted by gated
attention a = softmax(u . (tanh(P h) * sigmoid(Q h))) within its document, and the weighted sum of the
passages gives the score sigmoid(c . sum a h + d).  All weights are learned together from document labels,
on the driver, from a bounded sample (`limit` documents, see labels.sample); scoring reads every
passage of every whole text.  Of a quarter of the good documents in the sample, a copy whose letters are replaced at random
is learned as a bad one, so that the surface of prose alone doesn't make a good text.

Defined results: null, empty and blank texts are one passage of zeros and get its score; without labels, or with
one class only, every score is the smoothed share of label 1.  Rows never influence one another, whatever the batches: a
passage ends with its text; ties and repeated rows score alike; other columns pass through, one with the added name
as <name>_in.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caduspark.llm import labels as folds
from caduspark.llm import shared, textnum
from caduspark.llm.toxicity import scorer

PASSAGE, HIDDEN, LIMIT = 48, 16, 6_000
FOLDS, HELD = 4, 2

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "pipe": b"|",
    "symbol": b"#$%&*+/<=>@\\^_`{}~",
    "quote": b"\"'()[]-",
    "line": b"\n\r",
    "high": bytes(range(128, 256)),
}
_TABLES = []
for _chars in _CLASSES.values():
    _t = np.zeros(256, np.int32)
    _t[list(_chars)] = 1
    _TABLES.append(_t)
#: Buckets of hashed words and of hashed pairs of letters.
BUCKETS = 64
SURFACE, _NUMBER = len(_TABLES) + 9, len(_TABLES) + 7
FEATURES = SURFACE + 2 * BUCKETS
_PAIR_BUCKET = (textnum.mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(58)).astype(np.uint8)
_LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
#: Words whose letter pairs are counted at once.
_SLAB = 1 << 16


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(passages of each text, features of all passages); a text without words has one passage of zeros."""
    words = textnum.Words(data, offsets, lower=True)
    n = np.diff(words.first)
    counts = np.maximum(1, -(-n // size))
    total = int(counts.sum())
    x = np.zeros((total, FEATURES), np.float32)
    if not len(words.start):
        return counts, x
    text = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(text)) - words.first[text]
    base = np.cumsum(counts) - counts
    of = base[text] + within // size
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    rows = of[heads]
    number = np.diff(np.append(heads, len(of))).astype(np.float32)
    begin = words.start[heads]
    stop = np.minimum(np.append(begin[1:], len(data)), offsets[text[heads] + 1])  # the next passage's first word, or the text's end
    length = (words.end - words.start).astype(np.float32)
    chars = np.add.reduceat(length, heads)
    for i, table in enumerate(_TABLES):
        upto = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        x[rows, i] = (upto[stop] - upto[begin]) / chars
    same = np.zeros(len(of), np.float32)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((words.hash, of))
    first = np.ones(len(of), np.float32)
    first[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (of[order][1:] != of[order][:-1])
    head_byte, tail_byte = data[words.start], data[words.end - 1]
    k = len(_TABLES)
    x[rows, k] = np.add.reduceat(same, heads) / number
    x[rows, k + 1] = np.add.reduceat(first, heads) / number
    x[rows, k + 2] = chars / number / 10
    x[rows, k + 3] = np.add.reduceat(length * length, heads) / number / 100
    x[rows, k + 4] = np.add.reduceat(((head_byte >= 65) & (head_byte <= 90)).astype(np.float32), heads) / number
    x[rows, k + 5] = np.add.reduceat((length <= 1).astype(np.float32), heads) / number
    x[rows, k + 6] = np.add.reduceat(((tail_byte < 128) & textnum.TERM_SPACE[tail_byte]).astype(np.float32), heads) / number
    x[rows, k + 7] = np.log1p(number) / 4
    x[rows, k + 8] = 1
    hashed = np.bincount(of * BUCKETS + (textnum.mix(words.hash) >> np.uint64(58)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    x[rows, SURFACE : SURFACE + BUCKETS] = 10 * hashed[rows] / number[:, None]
    pairs = np.zeros((total, BUCKETS), np.int64)
    for at in range(0, len(of), _SLAB):
        start, end, some = words.start[at : at + _SLAB], words.end[at : at + _SLAB], of[at : at + _SLAB]
        left = np.zeros(int(end[-1] - start[0]) + 1, np.int8)  # bytes with another one of their word behind them
        left[start - start[0]] += 1
        left[end - 1 - start[0]] -= 1
        place = np.flatnonzero(np.cumsum(left[:-1], dtype=np.int8)) + start[0]
        code = words.data[place].astype(np.int64) << 8 | words.data[place + 1]
        low = int(some[0])
        got = np.bincount((np.repeat(some, end - start - 1) - low) * BUCKETS + _PAIR_BUCKET[code])
        got = np.append(got, np.zeros(-len(got) % BUCKETS, np.int64)).reshape(-1, BUCKETS)
        pairs[low : low + len(got)] += got
    x[rows, SURFACE + BUCKETS :] = 10 * pairs[rows] / np.maximum(chars - number, 1)[:, None]
    return counts, x


def scrambled(data: np.ndarray) -> np.ndarray:
    """The bytes of a text with its ASCII letters replaced at random, case kept."""
    lower = textnum.LOWER[data]
    letter = (lower >= 97) & (lower <= 122)
    other = _LETTERS[(textnum.mix(np.arange(len(data), dtype=np.uint64) + np.uint64(len(data))) % np.uint64(26)).astype(np.int64)]
    return np.where(letter, other - (lower - data), data).astype(np.uint8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Attention:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None

    def forward(self, counts: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        """All steps from standardised features to scores."""
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        p, q = np.tanh(h @ w["P"]), _sigmoid(h @ w["Q"])
        e = (p * q) @ w["u"]
        heads = np.cumsum(counts) - counts
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), counts))
        a = e / np.repeat(np.add.reduceat(e, heads), counts)
        z = np.add.reduceat(a[:, None] * h, heads)
        return {"h": h, "p": p, "q": q, "a": a, "z": z, "heads": heads, "s": _sigmoid(z @ w["c"] + w["d"])}

    def ready(self, x: np.ndarray) -> np.ndarray:
        """Standardised features; hashed shares count by how many words they rest on."""
        x = (x - self.mean) * self.scale
        number = np.expm1(4 * (x[:, _NUMBER] / self.scale[_NUMBER] + self.mean[_NUMBER]))
        x[:, SURFACE:] *= (number / (number + PASSAGE / 2))[:, None]
        return x

    def score_passages(self, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.forward(counts, self.ready(x))["s"]

    def score_array(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.weights is not None:
            for lo, hi, data, offsets in textnum.pieces(texts):
                out[lo:hi] = self.score_passages(*passages(data, offsets))
        return out


def fit(y: np.ndarray, counts: np.ndarray, x: np.ndarray, hidden: int = HIDDEN, epochs: int = 24, batch: int = 512, seed: int = 11) -> Attention:
    """Adam on the logistic loss of the documents, in batches of documents."""
    prior = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.all() or not y.any():
        return Attention(float(prior), np.zeros(0), np.zeros(0), None)
    mean, scale = x.mean(0, dtype=np.float64).astype(np.float32), (1 / (x.std(0, dtype=np.float64) + 0.02)).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"W": draw(x.shape[1], hidden), "b": np.zeros(hidden, np.float32), "P": draw(hidden, hidden), "Q": draw(hidden, hidden), "u": draw(hidden), "c": draw(hidden), "d": np.zeros(1, np.float32)}
    model = Attention(float(prior), mean, scale, w)
    x = model.ready(x)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) ** 0.5
    first = np.cumsum(counts) - counts
    steps = [some for _ in range(epochs) for some in np.array_split(rng.permutation(len(y)), -(-len(y) // batch))]
    for step, some in enumerate(steps, 1):
        size = counts[some]
        rows = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own, part = x[rows], weight[some] / weight[some].sum()
        f = model.forward(size, own)
        gz = ((f["s"] - y[some]) * part).astype(np.float32)
        grads = {"c": f["z"].T @ gz, "d": np.array([gz.sum()], np.float32)}
        dz = np.repeat(gz, size)[:, None] * w["c"][None]
        da = (dz * f["h"]).sum(1)
        mean_da = np.add.reduceat(f["a"] * da, f["heads"])
        de = f["a"] * (da - np.repeat(mean_da, size))
        pq = f["p"] * f["q"]
        grads["u"] = pq.T @ de
        dpq = de[:, None] * w["u"][None]
        dp, dq = dpq * f["q"] * (1 - f["p"] ** 2), dpq * f["p"] * f["q"] * (1 - f["q"])
        grads["P"], grads["Q"] = f["h"].T @ dp, f["h"].T @ dq
        dh = (f["a"][:, None] * dz + dp @ w["P"].T + dq @ w["Q"].T) * (1 - f["h"] ** 2)
        grads["W"], grads["b"] = own.T @ dh, dh.sum(0)
        for k, g in grads.items():
            m, s = state[k]
            m += 0.1 * (g + 1e-5 * w[k] - m)
            s += 0.01 * (g * g - s)
            w[k] = w[k] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "quality", limit: int = LIMIT) -> Attention:
    """Fit on at most `limit` labelled documents outside the held-out fold."""
    shared.tune(docs.sparkSession)

    def featurise(batches):
        for batch in batches:
            for lo, hi, data, offsets in textnum.chunks(batch, "__text"):
                rows = batch.slice(lo, hi - lo)
                keys, y = rows.column(0).cast(pa.string()), np.asarray(rows.column(1))
                counts, x = passages(data, offsets)
                yield pa.RecordBatch.from_arrays([keys, rows.column(1), textnum.lists(x.ravel(), counts * FEATURES, pa.float32())], names=["k", "y", "x"])
                some = [i for i, k in enumerate(keys.to_pylist()) if y[i] > 0 and zlib.crc32(k.encode()) >> 8 & 3 == 0]
                if some:
                    texts = [scrambled(data[offsets[i] : offsets[i + 1]]) for i in some]
                    counts, x = passages(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
                    names = pa.array([f"{k} scrambled" for k in keys.take(pa.array(some)).to_pylist()])
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(some))), textnum.lists(x.ravel(), counts * FEATURES, pa.float32())], names=["k", "y", "x"])

    got = folds.sample(docs, labels, target, FOLDS, HELD, limit, key, text).mapInArrow(featurise, "k string, y double, x array<float>").toArrow()
    got = got.sort_by("k")
    lists = got.column("x").combine_chunks()
    at = np.asarray(lists.offsets)
    x = np.asarray(lists.values)[at[0] : at[-1]].reshape(-1, FEATURES)
    return fit(np.asarray(got.column("y")) > 0, np.diff(at) // FEATURES, x)


def score(docs: DataFrame, model: Attention, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text in column `name`."""
    shared.tune(docs.sparkSession)
    return shared.with_added(docs, name, scorer(model)(F.col(f"`{text}`")))
