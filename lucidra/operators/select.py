"""Deterministic samples: hash order, quotas and round robin; tertiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: Column, seed: str | int = "") -> Column:
    """Order of a seeded shuffle: SHA-256 of ``seed:key`` (of the key alone without a seed)."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key) if seed != "" else key, 256)


def top_per_level(df: DataFrame, by: list[str], key: str, k: int, seed: str | int = "") -> DataFrame:
    """The first ``k`` rows of each level in hash order, with their ``rank``; a null key comes first, ties by key."""
    w = W.partitionBy(*by).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quota_sample(df: DataFrame, level: str, key: str, size: int) -> DataFrame:
    """``size`` rows in hash order with near equal quotas per level; what a small level leaves goes to the first other rows."""
    levels = df.select(level).distinct().select(level, (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(level)) - 1).alias("_i"), F.count(F.lit(1)).over(W.partitionBy(F.lit(1))).alias("_l"))
    quota = F.floor(F.lit(size) / F.col("_l")) + F.when(F.col("_i") < F.lit(size) % F.col("_l"), 1).otherwise(0)
    w = W.partitionBy(level).orderBy(hash_order(F.col(key)), key)
    ranked = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).join(F.broadcast(levels), level).withColumn("_in", F.col("_r") <= quota)
    return ranked.orderBy(F.desc("_in"), hash_order(F.col(key)), key).limit(size).drop("_r", "_in", "_i", "_l")


def round_robin_sample(df: DataFrame, split: str, order: list[str], key: str, size: int) -> DataFrame:
    """``size`` rows taken in turn from the splits in ``order``, each in hash order; other splits are left out."""
    w = W.partitionBy(split).orderBy(hash_order(F.col(key)), key)
    turn = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    picked = df.where(F.col(split).isin(order)).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= size)
    return picked.orderBy("turn", turn).limit(size)


def chain_units(df: DataFrame, owner: str, unit: str, levels: str, limit: int, seed: str | int = "") -> DataFrame:
    """Units (one row each, with the array of levels they serve) taken in hash order until all their levels are full.

    A unit is skipped only if every one of its levels already has ``limit`` units. The scan is sequential by
    definition and runs per owner over units, not rows; at most (number of levels) * limit units are ever
    taken, and units beyond the first ``limit`` of a level set are cut off before the scan.
    """
    import pandas as pd

    w = W.partitionBy(owner, levels).orderBy(hash_order(F.col(unit), seed), unit)
    few = df.select(owner, unit, F.array_sort(levels).alias(levels)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    few = few.withColumn("_o", hash_order(F.col(unit), seed))
    schema = few.select(owner, unit).schema

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: dict[str, int] = {}
        taken = []
        for row in pdf.sort_values(["_o", unit]).itertuples(index=False):
            has = list(getattr(row, levels))
            if all(counts.get(x, 0) >= limit for x in has):
                continue
            for x in has:
                counts[x] = counts.get(x, 0) + 1
            taken.append((getattr(row, owner), getattr(row, unit)))
        return pd.DataFrame(taken, columns=[owner, unit])

    return few.groupBy(owner).applyInPandas(scan, schema)


def tertiles(df: DataFrame, value: str) -> tuple[float, float]:
    """Inclusive tertile cuts by linear interpolation with integer remainders; needs three values and two distinct cuts.

    Order statistics come from the counts of distinct values; only the four values needed reach the driver.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = h.agg(F.sum("n")).first()[0] or 0
    if total < 3:
        raise ValueError("tertiles need at least three values")
    spots = [divmod(i * (total - 1), 3) for i in (1, 2)]
    ranks = sorted({r for j, d in spots for r in (j, min(j + 1, total - 1))})
    part = F.expr("cast(floor(v) as bigint)")
    sums = h.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).select("p", (F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("p")) - F.col("n")).alias("before"))
    inner = h.withColumn("p", part).withColumn("upto", F.sum("n").over(W.partitionBy("p").orderBy("v")))
    run = inner.join(sums, "p").select("v", (F.col("before") + F.col("upto") - F.col("n")).alias("lo"), (F.col("before") + F.col("upto")).alias("hi"))
    want = F.explode(F.filter(F.array(*[F.lit(r) for r in ranks]), lambda r: (r >= F.col("lo")) & (r < F.col("hi"))))
    at = {r.rank: r.v for r in run.select("v", want.alias("rank")).collect()}
    cuts = [(at[j] * (3 - d) + at[min(j + 1, total - 1)] * d) / 3 for j, d in spots]
    if not cuts[0] < cuts[1]:
        raise ValueError("ties leave fewer than three levels")
    return cuts[0], cuts[1]
