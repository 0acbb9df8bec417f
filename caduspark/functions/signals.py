"""Confidence signals: a share in [0, 1], or -1 where the signal is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caduspark.functions import fixed


def self_reported(text: Column) -> Column:
    """Mean of all stated percentages from 0 to 100."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in fixed.CONFIDENCE_PATTERNS])
    values = F.filter(F.transform(found, lambda x: x.cast("double")), lambda x: x <= 100)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x / 100) / F.size(values)
    return F.when(F.size(values) > 0, mean).otherwise(F.lit(-1.0))


def vocabulary_share(text: Column, pattern: str, vocabulary: list[str]) -> Column:
    """Share of the tokens of a shape that the vocabulary knows, whatever their case; repeats count."""
    tokens = F.regexp_extract_all(text, F.lit("(?U)" + pattern), 1)
    words = F.array(*[F.lit(w.lower()) for w in sorted(set(vocabulary))]).cast("array<string>")
    known = F.size(F.filter(tokens, lambda t: F.array_contains(words, F.lower(t))))
    return F.when(F.size(tokens) > 0, known / F.size(tokens)).otherwise(F.lit(-1.0))


def grounding(text: Column, vocabulary: list[str] | None) -> Column:
    return F.lit(-1.0) if vocabulary is None else vocabulary_share(text, fixed.ICD_PATTERN, vocabulary)


def hallucination(text: Column, vocabulary: list[str] | None) -> Column:
    return F.lit(-1.0) if vocabulary is None else vocabulary_share(text, fixed.DRUG_PATTERN, vocabulary)


def completeness(provided: Column, required: Column) -> Column:
    needed = F.array_distinct(required)
    return F.when(F.size(needed) > 0, F.size(F.array_intersect(provided, needed)) / F.size(needed)).otherwise(F.lit(-1.0))


def composite(signals: dict[str, Column], weights: dict[str, float] | None = None, unscored: float = fixed.UNSCORED) -> Column:
    """Weighted mean of the signals that are present, clamped to [0, 1]; unknown signals weigh nothing."""
    weights = fixed.SIGNAL_WEIGHTS if weights is None else weights
    if any(w < 0 for w in weights.values()):
        raise ValueError("confidence weights must be non-negative")
    if sum(weights.values()) <= 0:
        raise ValueError("confidence weights must not all be zero")
    if not 0.0 <= unscored <= 1.0:
        raise ValueError("the score of nothing must lie in [0, 1]")
    total, weight, present = F.lit(0.0), F.lit(0.0), F.lit(0)
    for name, value in signals.items():
        w = F.lit(float(weights.get(name, 0.0)))
        total = total + F.when(value >= 0, value * w).otherwise(0.0)
        weight = weight + F.when(value >= 0, w).otherwise(0.0)
        present = present + F.when(value >= 0, 1).otherwise(0)
    score = total / F.when(weight == 0, F.lit(1.0)).otherwise(weight)
    return F.when(present == 0, F.lit(float(unscored))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for empty, unequal or zero ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def uncertainty(logprob: Column, temperature: float = 1.5) -> Column:
    raised = F.pow(F.exp(logprob), F.lit(float(temperature)))
    return F.when(logprob.isNull(), F.lit(-1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raised)))


def guideline_adherence(rules: dict[str, Column]) -> tuple[Column, Column]:
    """(share of rules that hold, names of those that do not)."""
    if not rules:
        return F.lit(-1.0), F.array().cast("array<string>")
    held = sum((F.when(c, 1).otherwise(0) for c in rules.values()), F.lit(0))
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return held / len(rules), broken


def override_prediction(features: dict[str, Column], weights: dict[str, float], bias: float = 0.0) -> Column:
    """1 - logistic(bias + sum of weight * feature): how unlikely a human override is; -1 without weights."""
    if not weights:
        return F.lit(-1.0)
    z = F.lit(float(bias))
    for name, w in weights.items():
        z = z + F.coalesce(features[name], F.lit(0.0)) * w if name in features else z
    return 1 - 1 / (1 + F.exp(-z))


def temper(p: Column, temperature: Column | float) -> Column:
    """sigmoid(logit(p) / T), with p clamped away from 0 and 1."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    clamped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    z = F.ln(clamped / (1 - clamped)) / t
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
