"""Mixing sources to target weights (problem 9).

Entropy balancing: document rates as close as possible (in relative entropy) to "every document once",
subject to the tokens each source must contribute and to the cap on repeats. The rates are
w = min(cap, exp(lambda_s * tokens)); the dual is solved by safeguarded Newton iterations whose sums
are taken by Spark over the histogram of (source, length); the driver holds one number per source.
Rates are rounded to whole copies by running sums over the lengths, and what a source then lacks or has
too many is made up with documents of its ``FINE`` shortest lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucidra.llm.packing import ranked_within
from lucidra.util import cut

ROUNDS, TOLERANCE = 60, 1e-9
#: Shortest lengths of each source whose documents even out the rounding; also the most counts per source that the driver sees.
FINE = 4096


def _solve(cells: DataFrame, wanted: dict[str, float], caps: dict[str, int], scale: dict[str, float]) -> dict[str, float]:
    """lambda per source (per ``scale`` tokens) such that the capped rates give the wanted tokens."""
    spark = cells.sparkSession
    lam = {s: 0.0 for s in wanted}
    low, high = {s: -math.inf for s in wanted}, {s: math.inf for s in wanted}
    open_ = set(wanted)
    for _ in range(ROUNDS):
        if not open_:
            break
        now = spark.createDataFrame([(s, lam[s], float(caps[s]), scale[s]) for s in sorted(open_)], "source string, lam double, cap double, scale double")
        rate = F.least(F.col("cap"), F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("scale"), F.lit(700.0))))
        free = F.when(rate < F.col("cap"), F.col("n") * F.pow("n_tokens", F.lit(2.0)) / F.col("scale") * rate).otherwise(0.0)
        sums = cells.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens") * rate).alias("g"), F.sum(free).alias("h"))
        for r in sums.collect():
            s, gap = r.source, r.g - wanted[r.source]
            if abs(gap) <= TOLERANCE * max(wanted[s], 1.0):
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - gap / r.h if r.h > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isinf(low[s]):
                    step = 2 * lam[s] - 1
                elif math.isinf(high[s]):
                    step = 2 * lam[s] + 1
                else:
                    step = (low[s] + high[s]) / 2
            if step == lam[s]:
                open_.discard(s)
            lam[s] = step
    return lam


def _even_out(cells: list, lacking: dict[str, float]) -> list[tuple[str, int, int]]:
    """(source, n_tokens, change of copies) that bring each source closest to its tokens, longest documents first.

    ``cells``: source, n_tokens, n, given, cap of the shortest documents of each source.
    """
    out = []
    for r in sorted(cells, key=lambda r: (r.source, -r.n_tokens)):
        gap = lacking.get(r.source, 0.0)
        k = int(gap / r.n_tokens + (0.5 if gap > 0 else -0.5)) if r.n_tokens == 1 else int(gap / r.n_tokens)
        k = max(-r.given, min(k, int(r.n * r.cap) - r.given))
        if k:
            out.append((r.source, r.n_tokens, k))
            lacking[r.source] = gap - k * r.n_tokens
    return out


def mix(docs: DataFrame, doc_id: str, source: str, n_tokens: str, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, report) of the mixture.

    ``targets``: ``source, target_share, max_repeats``, a small fixed table; shares are scaled to sum to 1 and
    must be positive. ``docs`` compares sources as they are; documents of other or null sources, or without
    tokens, take no part. ``total`` is the size of the mixture in tokens, by default the largest at which
    every source that has tokens can reach its share within its cap; a larger one is refused with the source that fails.
    A target source without tokens stays in the report with 0 documents and an actual share of 0 against its full
    target; the others keep their proportions to each other.
    copies: ``doc_id, source, n_tokens, copies`` (0 for documents left out); report: one row per target source.
    """
    goal = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.collect() if r.source is not None and r.target_share and r.target_share > 0}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(n_tokens).cast("long").alias("n_tokens"))
    rows = rows.where(F.col("source").isin(list(goal)) & (F.col("n_tokens") > 0)) if goal else rows.limit(0)
    rows = cut(rows)
    cells = cut(rows.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r.source: (r.t, r.n) for r in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    everything = sum(share for share, _ in goal.values()) or 1.0
    asked = {s: share / everything for s, (share, _) in goal.items()}
    goal = {s: v for s, v in goal.items() if s in have} if total is None else goal
    weight = sum(share for share, _ in goal.values()) or 1.0
    most = min((cap * have[s][0] * weight / share if s in have else 0.0 for s, (share, cap) in goal.items()), default=0.0)
    size = most if total is None else float(total)
    if size > most * (1 + 1e-12):
        short = [s for s, (share, cap) in goal.items() if s not in have or cap * have[s][0] < size * share / weight]
        raise ValueError(f"{short} cannot reach their share of {size:.0f} tokens; at most {most:.0f} are possible")
    wanted = {s: size * share / weight for s, (share, _) in goal.items()}
    caps = {s: cap for s, (_, cap) in goal.items()}
    full = {s for s in wanted if wanted[s] >= caps[s] * have[s][0] * (1 - 1e-12)}
    scale = {s: have[s][0] / have[s][1] for s in wanted}
    lam = _solve(cells, {s: w for s, w in wanted.items() if s not in full}, caps, scale) | {s: math.inf for s in full}

    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(s, None if math.isinf(lam[s]) else lam[s], float(caps[s]), scale[s]) for s in sorted(goal)],
        "source string, lam double, cap double, scale double",
    )
    tilt = F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("scale"), F.lit(700.0)))
    rated = cells.join(F.broadcast(table), "source").withColumn("rate", F.when(F.col("lam").isNull(), F.col("cap")).otherwise(F.least("cap", tilt)))
    through = F.sum(F.col("n") * F.col("rate")).over(W.partitionBy("source").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0))
    whole = rated.withColumn("_to", F.floor(through + 0.5)).withColumn("_from", F.lag("_to", 1, 0).over(W.partitionBy("source").orderBy("n_tokens")))
    given = F.least(F.col("_to") - F.col("_from"), F.col("n") * F.col("cap").cast("long"))
    whole = cut(whole.select("source", "n_tokens", "n", "cap", given.cast("long").alias("given")))
    sums = whole.groupBy("source").agg(F.sum(F.col("given") * F.col("n_tokens")).alias("t")).collect()
    lacking = {r.source: wanted[r.source] - r.t for r in sums}
    shortest = F.row_number().over(W.partitionBy("source").orderBy("n_tokens"))
    changes = _even_out(whole.withColumn("_place", shortest).where(F.col("_place") <= FINE).drop("_place").collect(), lacking)
    if changes:
        fix = spark.createDataFrame(changes, "source string, n_tokens long, change long")
        whole = whole.join(F.broadcast(fix), ["source", "n_tokens"], "left").withColumn("given", F.col("given") + F.coalesce("change", F.lit(0))).drop("change")
    whole = whole.drop("cap")

    hashed = rows.withColumn("_o", F.struct(F.xxhash64("doc_id").alias("h"), "doc_id"))
    ranked = ranked_within(hashed, ["source", "n_tokens"], "_o").drop("_o").join(whole, ["source", "n_tokens"])
    base = F.floor(F.col("given") / F.col("n"))
    copies = base + F.when(F.col("rank") < F.col("given") - base * F.col("n"), 1).otherwise(0)
    out = ranked.select("doc_id", "source", "n_tokens", copies.cast("long").alias("copies"))

    sums = out.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("copies") > 0).alias("documents_used"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most_copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"),
    )
    targeted = spark.createDataFrame(sorted(asked.items()), "source string, target_share double")
    counts = ["documents", "documents_used", "copies", "most_copies", "tokens"]
    report = targeted.join(sums, "source", "left").select("source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], "target_share")
    used = F.sum("tokens").over(W.partitionBy(F.lit(1)))
    return out, report.withColumn("actual_share", F.when(used > 0, F.col("tokens") / used).otherwise(0.0))
