"""Split conformal prediction, globally and per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.operators.metrics import null_safe_join, running


def nonconformity(probs: Column, label: Column) -> Column:
    """One minus the probability of the true label (counted from 0)."""
    return 1 - F.element_at(probs, label.cast("int") + 1)


def probability_violations(df: DataFrame, probs: str) -> DataFrame:
    """Rows whose probabilities are missing, outside [0, 1], do not sum to 1 within 1e-6, or differ in number from the first."""
    p = F.col(probs)
    sizes = df.agg(F.min(F.size(p)).alias("_k"))
    bad = p.isNull() | (F.size(p) == 0) | F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)) | (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6)
    return df.crossJoin(F.broadcast(sizes)).where(F.coalesce(bad, F.lit(True)) | (F.size(p) != F.col("_k"))).drop("_k")


def thresholds(df: DataFrame, score: str, alpha: float, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """``by, n, k, threshold``: the k-th smallest score with k = ceil((n + 1)(1 - alpha)), infinite where k exceeds n.

    Ranks are computed in double precision. Scores are within [0, 1]. A group with fewer than ``least`` rows is an error.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie within (0, 1)")
    by = by or []
    h = df.groupBy(*by, F.col(score).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    sizes = h.groupBy(*by).agg(F.sum("n").alias("size")).withColumn("k", F.ceil((F.col("size") + 1) * F.lit(1.0 - alpha)))
    if by and least > 1 and not sizes.where(F.col("size") < least).isEmpty():
        raise ValueError(f"a group has fewer than {least} calibration rows")
    run = running(h, by, ["n"], descending=False)
    run = null_safe_join(run, sizes, by) if by else run.crossJoin(F.broadcast(sizes))
    found = run.groupBy(*by).agg(F.max("size").alias("n"), F.max("k").alias("k"), F.min(F.when(F.col("cum_n") >= F.col("k"), F.col("c"))).alias("t"))
    found = found.where("n is not null")
    return found.select(*by, "n", "k", F.coalesce("t", F.lit(float("inf"))).alias("threshold"))


def prediction_set(probs: Column, threshold: Column) -> Column:
    """Labels whose nonconformity is at most the threshold, in order."""
    return F.filter(F.sequence(F.lit(0), F.size(probs) - 1), lambda i: (1 - F.element_at(probs, i + 1)) <= threshold)


def apply_sets(df: DataFrame, probs: str, fitted: DataFrame, by: list[str] | None = None, out: str = "prediction_set") -> DataFrame:
    """Adds the prediction set of each row; a group without a fitted threshold is an error. ``fitted`` has one row per group."""
    by = by or []
    t = fitted.select(*by, F.col("threshold").alias("_t"))
    joined = df.join(t, by, "left") if by else df.crossJoin(F.broadcast(t))
    if by and not joined.where("_t is null").isEmpty():
        raise KeyError("a group has no calibrated threshold")
    return joined.withColumn(out, prediction_set(F.col(probs), F.col("_t"))).drop("_t")


def coverage(df: DataFrame, sets: str, label: str, by: list[str] | None = None) -> DataFrame:
    """``by, n, coverage``: share of rows whose set holds the label."""
    hit = F.coalesce(F.array_contains(F.col(sets), F.col(label).cast("int")), F.lit(False))
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("coverage"))
