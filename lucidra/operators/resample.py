"""Bootstrap intervals and multiple testing.

Replicates draw clusters, and every statistic is rebuilt from the sums of the drawn clusters. How often a
cluster is drawn in a replicate comes from a hash of (seed, replicate, draw), so results depend neither
on the partitioning nor on the order of rows. Each replicate sees as many draws as there are clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucidra.functions.numeric import hash_fraction


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys with their rank 0, 1, ... in the order of the key, and their number ``k``."""
    keys = df.select(key).distinct()
    return keys.select(key, (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(key)) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy(F.lit(1))).alias("k"))


def draws(clusters: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """``replicate, i, m``: how often cluster i is drawn; only drawn clusters appear.

    ``clusters`` has ``i`` and ``k`` as :func:`numbered` gives them.
    """
    each = clusters.select("i", "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    key = F.concat_ws(":", F.col("replicate").cast("string"), F.col("i").cast("string"))
    hit = F.floor(hash_fraction(key, seed) * F.col("k")).cast("int")
    return each.select("replicate", hit.alias("i")).groupBy("replicate", "i").agg(F.count(F.lit(1)).alias("m"))


def interval(estimates: DataFrame, value: str, confidence: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """``lower, upper`` by index: int(tail * B) and int((1 - tail) * B) - 1 of the sorted replicates."""
    tail = (1.0 - confidence) / 2.0
    s = estimates.groupBy(*(by or [])).agg(F.sort_array(F.collect_list(value)).alias("_s")).where(F.size("_s") > 0)
    b = F.size("_s")
    lo = F.greatest(F.lit(0), F.floor(F.lit(tail) * b).cast("int"))
    hi = F.greatest(F.lit(0), F.least(b - 1, F.floor(F.lit(1.0 - tail) * b).cast("int") - 1))
    return s.select(*(by or []), F.element_at("_s", lo + 1).alias("lower"), F.element_at("_s", hi + 1).alias("upper"))


def linear_interval(estimates: DataFrame, value: str, confidence: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """``lower, upper`` by linear interpolation between the sorted replicates."""
    tail = (1.0 - confidence) / 2.0
    return estimates.groupBy(*(by or [])).agg(F.percentile(value, tail).alias("lower"), F.percentile(value, 1.0 - tail).alias("upper"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: Column, statistic: str = "mean", replicates: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: ``estimate, lower, upper`` of the mean of ``value`` with whole clusters drawn; an empty input gives no row."""
    sums = df.groupBy(F.col(cluster).alias("_g")).agg(F.sum(value.cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    ids = numbered(sums, "_g")
    stats = ids.join(sums, "_g")
    est = draws(ids, replicates, seed).join(stats.select("i", "s", "n"), "i").groupBy("replicate").agg((F.sum(F.col("m") * F.col("s")) / F.sum(F.col("m") * F.col("n"))).alias("v"))
    return stats.agg((F.sum("s") / F.sum("n")).alias("estimate")).crossJoin(interval(est, "v", confidence))


def ratio_bootstrap(df: DataFrame, cluster: str, parts: dict[str, tuple[Column, Column]], replicates: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """``metric, estimate, lower, upper`` of several ratios of sums, each rebuilt from summed parts in every replicate."""
    aggs = [F.sum(c.cast("double")).alias(f"{name}_{i}") for name, pair in parts.items() for i, c in enumerate(pair)]
    sums = df.groupBy(F.col(cluster).alias("_g")).agg(*aggs)
    ids = numbered(sums, "_g")
    stats = ids.join(sums, "_g").drop("_g", "k")
    drawn = draws(ids, replicates, seed).join(stats, "i")
    over = lambda w: F.array(
        *[F.struct(F.lit(name).alias("metric"), F.try_divide(F.sum(w * F.col(f"{name}_0")), F.sum(w * F.col(f"{name}_1"))).alias("v")) for name in parts]
    )
    est = drawn.groupBy("replicate").agg(over(F.col("m")).alias("r")).select("replicate", F.inline("r"))
    whole = stats.agg(over(F.lit(1)).alias("r")).select(F.inline("r")).withColumnRenamed("v", "estimate")
    return whole.join(linear_interval(est, "v", confidence, ["metric"]), "metric")


def two_sample_difference(df: DataFrame, key: str, value: Column, first: Column, replicates: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: difference of the means of two groups that are resampled independently of each other."""
    rows = df.select(F.col(key).alias("_g"), value.cast("double").alias("v"), first.alias("f"))
    out = []
    for flag, s in ((True, seed), (False, seed + 1)):
        part = rows.where(F.col("f") == flag).groupBy("_g").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
        ids = numbered(part, "_g")
        stats = ids.join(part, "_g")
        est = draws(ids, replicates, s).join(stats.select("i", "s", "n"), "i").groupBy("replicate").agg((F.sum(F.col("m") * F.col("s")) / F.sum(F.col("m") * F.col("n"))).alias(f"v{int(flag)}"))
        out.append((est, stats.agg((F.sum("s") / F.sum("n")).alias(f"e{int(flag)}"))))
    est = out[0][0].join(out[1][0], "replicate").select((F.col("v1") - F.col("v0")).alias("v"))
    return out[0][1].crossJoin(out[1][1]).select((F.col("e1") - F.col("e0")).alias("estimate")).crossJoin(linear_interval(est, "v", confidence))


def paired_aurc(df: DataFrame, cluster: str, first: str, second: str, correct: str, replicates: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: AURC of two scores on the same rows, their difference and its cluster bootstrap interval.

    Weights per cluster and replicate multiply the score histograms; curves are rebuilt per replicate.
    """
    from lucidra.operators.metrics import running

    long = df.select(F.col(cluster).alias("_g"), F.col(correct).cast("long").alias("y"), F.inline(F.array(F.struct(F.lit("a").alias("side"), F.col(first).alias("c")), F.struct(F.lit("b").alias("side"), F.col(second).alias("c")))))
    h = long.groupBy("_g", "side", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    ids = numbered(h, "_g")
    drawn = draws(ids, replicates, seed).unionByName(ids.select(F.lit(-1).alias("replicate"), "i", F.lit(1).cast("long").alias("m")))
    w = h.join(ids.select("_g", "i"), "_g").join(drawn, "i")
    w = w.groupBy("replicate", "side", "c").agg(F.sum(F.col("m") * F.col("n")).alias("n"), F.sum(F.col("m") * F.col("pos")).alias("pos"))
    run = running(w, ["replicate", "side"], ["n", "pos"], descending=True)
    area = run.groupBy("replicate", "side").agg((F.sum(F.col("n") * (F.col("cum_n") - F.col("cum_pos")) / F.col("cum_n")) / F.sum("n")).alias("v"))
    both = area.groupBy("replicate").agg(F.max(F.when(F.col("side") == "a", F.col("v"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("v"))).alias("b"))
    est = both.where("replicate >= 0").select((F.col("a") - F.col("b")).alias("v"))
    return both.where("replicate < 0").select(F.col("a").alias("aurc_a"), F.col("b").alias("aurc_b"), (F.col("a") - F.col("b")).alias("difference")).crossJoin(interval(est, "v", confidence))


def holm(df: DataFrame, key: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``adjusted``: step-down adjusted p-values; ties keep the order of ``key``. Families are ``by`` and fit in one task."""
    fam = W.partitionBy(*(by or [F.lit(1)]))
    order = fam.orderBy(p, key)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(fam) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn("adjusted", F.max("_step").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_step")
