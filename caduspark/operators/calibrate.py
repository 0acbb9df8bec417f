"""Calibration: best escalation threshold by F1, and the temperature that fits labels best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caduspark.functions import signals

GRID = [round(0.05 * i, 2) for i in range(2, 19)]


def calibrate_threshold(df: DataFrame, confidence: str, correct: str, grid: list[float] | None = None) -> DataFrame:
    """One row (threshold, f1, precision, recall): the lowest threshold of the best F1; 0.7 without samples."""
    grid = grid or GRID
    exprs = [F.count("*").alias("n"), F.coalesce(F.count_if(F.col(correct)), F.lit(0)).alias("pos")]
    for i, t in enumerate(grid):  # one scan: two counts for each of 17 thresholds
        over = F.col(confidence) >= F.lit(t)
        exprs += [F.count_if(over & F.col(correct)).alias(f"tp{i}"), F.count_if(over).alias(f"all{i}")]
    sums = df.agg(*exprs)
    rows = []
    for i, t in enumerate(grid):
        tp, said = F.col(f"tp{i}"), F.col(f"all{i}")
        precision = F.when(said > 0, tp / said).otherwise(0.0)
        recall = F.when(F.col("pos") > 0, tp / F.col("pos")).otherwise(0.0)
        f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        rows.append(F.struct(f1.alias("f1"), F.lit(-t).alias("minus"), F.lit(t).alias("threshold"), precision.alias("precision"), recall.alias("recall")))
    best = F.array_max(F.array(*rows))
    none = F.struct(F.lit(0.0).alias("f1"), F.lit(-0.7).alias("minus"), F.lit(0.7).alias("threshold"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    return sums.select(F.when(F.col("n") > 0, best).otherwise(none).alias("b")).select("b.threshold", "b.f1", "b.precision", "b.recall")


def nll(df: DataFrame, probability: str, label: str, temperature: float) -> DataFrame:
    """Mean negative log-likelihood of labels at a temperature."""
    s = signals.temper(F.col(probability), temperature)
    loss = F.when(F.col(label), -F.ln(F.greatest(s, F.lit(1e-15)))).otherwise(-F.ln(F.greatest(1 - s, F.lit(1e-15))))
    return df.agg(F.avg(loss).alias("nll"))


def fit_temperature(df: DataFrame, probability: str, label: str, low: float = 0.01, high: float = 10.0, digits: int = 6, steps: int = 32) -> float:
    """Temperature in [low, high] of the least loss, to 1e-6; the loss has one minimum.

    The (probability, label) pairs, counted at `digits` digits, stay distributed.  Each job takes the losses at steps + 1
    temperatures in one aggregate and narrows the interval to the neighbours of the best.
    """
    pairs = df.groupBy(F.round(probability, digits).alias("p"), F.col(label).alias("y")).agg(F.count("*").alias("n")).where("p is not null and y is not null").persist()

    def losses(grid: list[float]) -> list[float]:
        def loss(t: float) -> Column:
            s = signals.temper(F.col("p"), t)
            return F.sum(-F.col("n") * F.ln(F.greatest(F.when(F.col("y"), s).otherwise(1 - s), F.lit(1e-15))))

        return list(pairs.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(grid)]).first())

    try:
        while True:
            grid = [low + (high - low) * i / steps for i in range(steps + 1)]
            found = losses(grid)
            if found[0] is None:
                raise ValueError("no samples to fit")
            best = min(range(steps + 1), key=found.__getitem__)
            low, high = grid[max(best - 1, 0)], grid[min(best + 1, steps)]
            if high - low <= 2e-6:
                return (low + high) / 2
    finally:
        pairs.unpersist()
