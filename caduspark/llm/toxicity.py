"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 where the text holds a term of
bucket i.  Terms are lower-case runs of letters and digits and their first 4, 5 and 6 bytes, hashed into 2**18 buckets; of these the
`terms` buckets that tell the labels apart best (likelihood ratio) enter the machine.  The pairwise part
learns that two terms together weigh more or less than their sum.  It is fitted on the driver on a bounded
sample (`limit` documents, see labels.sample); scoring reads every whole text.

Defined results: null, empty and blank texts score sigmoid(w0); without labels, or with one class only, every
score is the smoothed share of label 1.  Rows never influence one another, so ties and repeated rows score
alike; other columns pass through, one with the added name as <name>_in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caduspark.llm import labels as folds
from caduspark.llm import shared, textnum

BUCKETS = 1 << 18
#: Inflected forms share their first bytes, so a form that training never met still has known terms.
PREFIXES = (4, 5, 6)
TERMS, FACTORS, LIMIT = 1024, 8, 8_000
FOLDS, HELD = 5, 0


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term: whole words and, of longer words, the stems of PREFIXES bytes."""
    words = textnum.Words(data, offsets, lower=True, space=textnum.TERM_SPACE)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    texts, hashes = [text], [words.hash]
    for size in PREFIXES:
        which, hashed = words.prefix(size)
        texts.append(text[which])
        hashes.append(hashed)
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(46)).astype(np.int64)


@dataclass
class Machine:
    bias: float
    buckets: np.ndarray  # sorted
    weight: np.ndarray
    factor: np.ndarray  # terms x factors

    def scores(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from distinct (text, term) pairs; term indexes buckets."""
        z = self.bias + np.bincount(text, self.weight[term], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            z += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score_array(self, texts: pa.Array) -> np.ndarray:
        place = np.full(BUCKETS, -1, np.int32)
        place[self.buckets] = np.arange(len(self.buckets))
        out = np.zeros(len(texts))
        for lo, hi, data, offsets in textnum.pieces(texts):
            text, bucket = buckets_of(data, offsets)
            term = place[bucket]
            text, term = text[term >= 0], term[term >= 0]
            pair = np.unique(text * np.int64(len(self.buckets) or 1) + term)
            out[lo:hi] = self.scores(pair // (len(self.buckets) or 1), pair % (len(self.buckets) or 1), hi - lo)
        return out


def fit(rows: list[tuple[float, np.ndarray]], terms: int = TERMS, factors: int = FACTORS, steps: int = 160, seed: int = 7) -> Machine:
    """Fit on (label, distinct buckets) rows; full-batch Adam on the logistic loss with decay."""
    y = np.array([r[0] for r in rows]) > 0
    prior = (y.sum() + 0.5) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not len(y) or y.all() or not y.any():
        return Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    sizes = np.array([len(r[1]) for r in rows])
    flat, of = np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    a = np.bincount(flat[y[of]], minlength=BUCKETS).astype(float)
    b = np.bincount(flat[~y[of]], minlength=BUCKETS).astype(float)
    pa_, pb = (a + 0.5) / (y.sum() + 1), (b + 0.5) / ((~y).sum() + 1)
    p = (a + b + 1) / (len(y) + 2)
    gain = y.sum() * (pa_ * np.log(pa_ / p) + (1 - pa_) * np.log((1 - pa_) / (1 - p))) + (~y).sum() * (pb * np.log(pb / p) + (1 - pb) * np.log((1 - pb) / (1 - p)))
    gain[a + b < 2] = 0
    best = np.lexsort((np.arange(BUCKETS), -gain))[:terms]
    best = np.sort(best[gain[best] > 0])
    place = np.full(BUCKETS, -1)
    place[best] = np.arange(len(best))
    x = np.zeros((len(rows), len(best)), np.float32)
    hit = place[flat] >= 0
    x[of[hit], place[flat[hit]]] = 1
    rng = np.random.Generator(np.random.PCG64(seed))
    w0, w, v = np.float32(bias), (0.5 * np.log(pa_ / pb))[best].astype(np.float32), rng.normal(0, 0.01, (len(best), factors)).astype(np.float32)
    moments = [[np.zeros_like(q), np.zeros_like(q)] for q in (np.zeros(1, np.float32), w, v)]
    for step in range(1, steps + 1):
        xv = x @ v
        z = w0 + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32) / len(y)
        xg = x.T @ g
        grads = (np.array([g.sum()], np.float32), xg + 1e-5 * w, x.T @ (g[:, None] * xv) - v * xg[:, None] + 1e-4 * v)
        out = []
        for (m, s), d, rate in zip(moments, grads, (0.05, 0.1, 0.02)):
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            out.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8))
        w0, w, v = w0 - out[0][0], w - out[1], v - out[2]
    return Machine(float(w0), best, w.astype(float), v.astype(float))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "toxic", limit: int = LIMIT) -> Machine:
    """Fit on at most `limit` labelled documents outside the held-out fold."""
    shared.tune(docs.sparkSession)

    def featurise(batches):
        for batch in batches:
            for lo, hi, data, offsets in textnum.chunks(batch, "__text"):
                of, bucket = buckets_of(data, offsets)
                pair = np.unique(of * BUCKETS + bucket)
                counts = np.bincount(pair // BUCKETS, minlength=hi - lo)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).cast(pa.string()), rows.column(1), textnum.lists((pair % BUCKETS).astype(np.int32), counts, pa.int32())], names=["k", "y", "terms"]
                )

    got = folds.sample(docs, labels, target, FOLDS, HELD, limit, key, text).mapInArrow(featurise, "k string, y double, terms array<int>").toArrow()
    got = got.sort_by("k")  # the fit must not depend on the order of partitions
    lists = got.column("terms").combine_chunks()
    at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    ys = np.asarray(got.column("y"))
    return fit([(ys[i], flat[at[i] : at[i + 1]]) for i in range(len(ys))])


def scorer(model) -> Callable:
    """A column function: text -> score of the model."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score_array(texts), pa.float64())

    return score


def score(docs: DataFrame, model: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text in column `name`."""
    shared.tune(docs.sparkSession)
    return shared.with_added(docs, name, scorer(model)(F.col(f"`{text}`")))
