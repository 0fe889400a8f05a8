"""Weighted isotonic calibration by pooling adjacent violators, in two distributed stages.

Rows are first summed per distinct score; contiguous ranges of scores pool their violators on their
own, and only the blocks that remain meet in one task per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNKS = 256
_BLOCK = "lower double, upper double, weight double, positive double, n long"


def level_balanced_weights(df: DataFrame, level: str, out: str = "weight", by: list[str] | None = None) -> DataFrame:
    """Adds weights n / (L * n_level), which sum to n (per group), so that every level counts the same."""
    by = by or []
    sizes = df.groupBy(*by, level).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    sizes = sizes.select(*by, level, (F.sum("_n").over(w) / (F.count(F.lit(1)).over(w) * F.col("_n"))).alias(out))
    return df.join(sizes, [*by, level])


def _pool(rows: Iterator[tuple]) -> list[list]:
    """Blocks whose means do not fall, from (lower, upper, weight, positive, n) in the order of the scores."""
    out: list[list] = []
    for lower, upper, weight, positive, n in rows:
        out.append([lower, upper, weight, positive, n])
        while len(out) > 1 and out[-2][3] * out[-1][2] > out[-1][3] * out[-2][2]:
            last = out.pop()
            prev = out[-1]
            out[-1] = [prev[0], last[1], prev[2] + last[2], prev[3] + last[3], prev[4] + last[4]]
    return out


def fit(df: DataFrame, score: str, correct: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``by, block, lower, upper, weight, positive, n, value``: the steps of the best non-decreasing fit, in order.

    Scores are finite numbers within [0, 1]; equal ones are pooled first. Weights must be positive. Neighbouring
    blocks of equal value stay apart. Independent of the order of the rows.
    """
    by = by or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.groupBy(*by, F.col(score).alias("lower")).agg(F.sum(w).alias("weight"), F.sum(w * F.col(correct).cast("double")).alias("positive"), F.count(F.lit(1)).alias("n"))
    base = base.select(*by, F.col("lower"), F.col("lower").alias("upper"), "weight", "positive", "n", F.least(F.floor(F.col("lower") * CHUNKS), F.lit(CHUNKS - 1)).alias("_part"))
    groups = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*by).schema) if by else ""
    head = f"{groups}, " if groups else ""
    cols = ["lower", "upper", "weight", "positive", "n"]

    def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lower")
        got = pd.DataFrame(_pool(pdf[cols].itertuples(index=False, name=None)), columns=cols)
        for b in reversed(by):
            got.insert(0, b, [pdf[b].iloc[0]] * len(got))
        return got

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pooled(pdf)
        got.insert(len(by), "block", range(len(got)))
        got["value"] = got["positive"] / got["weight"]
        return got

    local = base.groupBy(*by, "_part").applyInPandas(pooled, head + _BLOCK)
    return local.groupBy(*(by or [F.lit(0).alias("_all")])).applyInPandas(final, f"{head}block int, {_BLOCK}, value double") if by else local.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(final, f"block int, {_BLOCK}, value double")


def predict(x: Column, blocks: Column) -> Column:
    """The fitted value at ``x``: constant within a block, linear between two, clipped at the ends.

    ``blocks`` is the array of structs (lower, upper, value) in order; null for null ``x`` or no blocks.
    """
    before = F.filter(blocks, lambda b: b["lower"] <= x)
    after = F.filter(blocks, lambda b: b["lower"] > x)
    left, right = F.try_element_at(before, F.size(before)), F.try_element_at(after, F.lit(1))
    share = (x - left["upper"]) / (right["lower"] - left["upper"])
    between = left["value"] + share * (right["value"] - left["value"])
    value = F.when(F.size(before) == 0, right["value"]).when((F.size(after) == 0) | (x <= left["upper"]), left["value"]).otherwise(between)
    return F.when(x.isNotNull() & (F.size(blocks) > 0), value)


def apply(df: DataFrame, score: str, fitted: DataFrame, by: list[str] | None = None, out: str = "calibrated") -> DataFrame:
    """Adds the calibrated value; rows of groups without a fit get null (an unsupported group)."""
    by = by or []
    table = fitted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lower", "upper", "value"))).alias("_blocks"))
    joined = df.join(table, by, "left") if by else df.crossJoin(F.broadcast(table))
    return joined.withColumn(out, predict(F.col(score), F.col("_blocks"))).drop("_blocks")


def fit_violations(fitted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Blocks that overlap or fall below their predecessor, or whose sums are impossible; empty for a sound fit."""
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy("block")
    prev = fitted.select("*", F.lag("upper").over(w).alias("_u"), F.lag("value").over(w).alias("_v"))
    bad = (F.col("lower") > F.col("upper")) | (F.col("_u") >= F.col("lower")) | (F.col("_v") > F.col("value")) | (F.col("weight") <= 0) | (F.col("positive") < 0) | (F.col("positive") > F.col("weight") * (1 + 1e-12))
    return prev.where(F.coalesce(bad, F.lit(False))).drop("_u", "_v")
