"""Calibration and selective-risk metrics, over any grouping.

All metrics of a group follow from its score histogram: for each distinct score the number of rows and
of correct ones. The histogram is one partial aggregate; windows then see distinct scores only, and
running sums are taken in ``CHUNKS`` parts of the score range, so no group is sorted in one task.
Rows must pass :func:`require_pairs` first; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNKS = 1024


def pair_violations(df: DataFrame, conf: str, correct: str) -> DataFrame:
    """One row: rows, and how many have a confidence or outcome that cannot be used."""
    c, y = F.col(conf), F.col(correct).cast("double")
    bad_c = c.isNull() | F.isnan(c) | (c < 0) | (c > 1)
    bad_y = y.isNull() | ~y.isin(0.0, 1.0)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad_c).alias("bad_confidence"), F.count_if(bad_y).alias("bad_outcome"))


def require_pairs(df: DataFrame, conf: str, correct: str) -> DataFrame:
    """``df`` itself, or an error if it is empty or any row has an unusable confidence or outcome."""
    r = pair_violations(df, conf, correct).first()
    if not r.rows or r.bad_confidence or r.bad_outcome:
        raise ValueError(f"unusable pairs: {r.asDict()}")
    return df


def score_histogram(df: DataFrame, conf: str, correct: str, by: list[str]) -> DataFrame:
    """``by, c, n, pos``: rows and correct rows of each distinct confidence."""
    return df.groupBy(*by, (F.col(conf) + F.lit(0.0)).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("long")).alias("pos"))


def running(hist: DataFrame, by: list[str], columns: list[str], descending: bool, order: str = "c") -> DataFrame:
    """Adds ``cum_x`` for each column: its sum up to and with the row in the order of ``order`` (within [0, 1])."""
    part = F.least(F.floor(F.col(order) * CHUNKS), F.lit(CHUNKS - 1))
    h = hist.withColumn("_part", -part if descending else part)
    totals = h.groupBy(*by, "_part").agg(*[F.sum(x).alias(x) for x in columns])
    w = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_part", *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(f"_before_{x}") for x in columns])
    inner = W.partitionBy(*by, "_part").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(W.unboundedPreceding, 0)
    h = h.select("*", *[F.sum(x).over(inner).alias(f"_in_{x}") for x in columns])
    joined = null_safe_join(h, totals, [*by, "_part"])
    keep = hist.columns
    return joined.select(*keep, *[(F.col(f"_in_{x}") + F.col(f"_before_{x}")).alias(f"cum_{x}") for x in columns])


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; the result has each of them once."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def brier(c: str = "c", n: str = "n", pos: str = "pos") -> Column:
    """Mean squared error, over a histogram."""
    x = F.col(c)
    return F.sum((1 - x) * (1 - x) * F.col(pos) + x * x * (F.col(n) - F.col(pos))) / F.sum(n)


def log_loss(eps: float = 1e-15) -> Column:
    """Mean negative log-likelihood with clipped confidences, over a histogram."""
    p = F.greatest(F.least(F.col("c"), F.lit(1 - eps)), F.lit(eps))
    return F.sum(-(F.col("pos") * F.log(p) + (F.col("n") - F.col("pos")) * F.log(1 - p))) / F.sum("n")


def reliability_bins(df: DataFrame, conf: str, correct: str, by: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """``by, bin, lower, upper, n, mean_confidence, accuracy, gap`` of the equal-width bins with rows; 1.0 is in the last bin."""
    by = by or []
    b = F.least(F.floor(F.col(conf) * n_bins), F.lit(n_bins - 1)).cast("int")
    g = df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return g.select(*by, "bin", (F.col("bin") / n_bins).alias("lower"), ((F.col("bin") + 1) / n_bins).alias("upper"), "n", "mean_confidence", "accuracy", F.abs(F.col("mean_confidence") - F.col("accuracy")).alias("gap"))


def ece(df: DataFrame, conf: str, correct: str, by: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """``by, ece``: gaps of the equal-width bins weighted by their rows."""
    by = by or []
    return reliability_bins(df, conf, correct, by, n_bins).groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def ace(df: DataFrame, conf: str, correct: str, by: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """``by, ace``: the mean gap over bins of equal count; rows are ordered by confidence, wrong before right.

    With N rows and B = min(n_bins, N) bins, bin i holds the rows from i*N div B to (i+1)*N div B. Runs of equal
    rows are cut into the bins they cross arithmetically instead of row by row.
    """
    by = by or []
    h = score_histogram(df, conf, correct, by)
    total = h.groupBy(*by).agg(F.sum("n").alias("total"))
    h = null_safe_join(running(h, by, ["n"], descending=False), total, by) if by else running(h, by, ["n"], descending=False).crossJoin(F.broadcast(total))
    start = F.col("cum_n") - F.col("n")
    runs = h.select(
        *by,
        "c",
        "total",
        F.inline(
            F.array(
                F.struct(start.alias("a"), (start + F.col("n") - F.col("pos")).alias("z"), F.lit(0).alias("y")),
                F.struct((start + F.col("n") - F.col("pos")).alias("a"), F.col("cum_n").alias("z"), F.lit(1).alias("y")),
            )
        ),
    ).where("z > a")
    bins = F.least(F.lit(n_bins).cast("long"), F.col("total"))
    # the bin of rank r is the largest i with i*N div B <= r
    bin_of = lambda r: F.floor(((r + 1) * bins - 1) / F.col("total"))
    cut = runs.withColumn("bins", bins).withColumn("bin", F.explode(F.sequence(bin_of(F.col("a")).cast("long"), bin_of(F.col("z") - 1).cast("long"))))
    lo, hi = F.expr("bin * total div bins"), F.expr("(bin + 1) * total div bins")
    m = F.greatest(F.lit(0), F.least("z", hi) - F.greatest("a", lo))
    g = cut.withColumn("m", m).groupBy(*by, "total", "bin").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("c")).alias("conf"), F.sum(F.col("m") * F.col("y")).alias("right"))
    return g.groupBy(*by).agg((F.sum(F.abs(F.col("conf") - F.col("right"))) / F.max("total")).alias("ace"))


def auroc(df: DataFrame, conf: str, correct: str, by: list[str] | None = None) -> DataFrame:
    """``by, auroc``: chance that a right row scores above a wrong one, ties half; null with one outcome only."""
    by = by or []
    h = running(score_histogram(df, conf, correct, by), by, ["n"], descending=False)
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    g = h.groupBy(*by).agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return g.select(*by, ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auroc"))


def risk_coverage(df: DataFrame, conf: str, correct: str, by: list[str] | None = None) -> DataFrame:
    """``by, threshold, accepted, coverage, risk`` for each distinct confidence; equal ones enter together."""
    by = by or []
    h = score_histogram(df, conf, correct, by)
    total = h.groupBy(*by).agg(F.sum("n").alias("total"))
    h = running(h, by, ["n", "pos"], descending=True)
    h = null_safe_join(h, total, by) if by else h.crossJoin(F.broadcast(total))
    return h.select(*by, F.col("c").alias("threshold"), F.col("cum_n").alias("accepted"), (F.col("cum_n") / F.col("total")).alias("coverage"), ((F.col("cum_n") - F.col("cum_pos")) / F.col("cum_n")).alias("risk"), (F.col("n") / F.col("total")).alias("width"))


def aurc(df: DataFrame, conf: str, correct: str, by: list[str] | None = None) -> DataFrame:
    """``by, aurc``: the risk-coverage curve integrated as a step function."""
    by = by or []
    return risk_coverage(df, conf, correct, by).groupBy(*by).agg(F.sum(F.col("width") * F.col("risk")).alias("aurc"))


def selective(df: DataFrame, conf: str, correct: str, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """``by, threshold, total, accepted, coverage, risk, accuracy``: one scan for the whole grid; no accepted rows give null rates."""
    by = by or []
    h = score_histogram(df, conf, correct, by)
    cols = []
    for i, t in enumerate(thresholds):
        hit = F.col("c") >= F.lit(float(t))
        cols += [F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(f"a{i}"), F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias(f"p{i}")]
    g = h.groupBy(*by).agg(F.sum("n").alias("total"), *cols)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("accepted"), F.col(f"p{i}").alias("right")) for i, t in enumerate(thresholds)])
    g = g.select(*by, "total", F.inline(rows)).where("total is not null")
    acc = ratio(F.col("right"), F.col("accepted"))
    return g.select(*by, "threshold", "total", "accepted", (F.col("accepted") / F.col("total")).alias("coverage"), (1 - acc).alias("risk"), acc.alias("accuracy"))


def group_report(df: DataFrame, conf: str, correct: str, by: list[str], n_bins: int = 10) -> DataFrame:
    """``by`` and n, accuracy, brier, log_loss, ece, ace, auroc, aurc of each group."""
    h = score_histogram(df, conf, correct, by)
    out = h.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("pos") / F.sum("n")).alias("accuracy"), brier().alias("brier"), log_loss().alias("log_loss"))
    for part in (ece(df, conf, correct, by, n_bins), ace(df, conf, correct, by, n_bins), auroc(df, conf, correct, by), aurc(df, conf, correct, by)):
        out = null_safe_join(out, part, by)
    return out


def grouping_sets(df: DataFrame, conf: str, correct: str, sets: list[list[str]]) -> DataFrame:
    """``report, cell, n, accuracy, brier`` of several crossings at once, over observed cells; the columns' values name the cell."""
    every = sorted({c for s in sets for c in s})
    h = score_histogram(df, conf, correct, every)
    parts = []
    for s in sets:
        cell = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<null>"))) for c in s]) if s else F.lit("all")
        parts.append(F.struct(F.lit("x".join(s) or "all").alias("report"), cell.alias("cell")))
    rows = h.select("c", "n", "pos", F.inline(F.array(*parts)))
    return rows.groupBy("report", "cell").agg(F.sum("n").alias("n"), (F.sum("pos") / F.sum("n")).alias("accuracy"), brier().alias("brier"))


def oracle_recall(df: DataFrame, candidates: str, label: str, by: list[str] | None = None) -> DataFrame:
    """``by, n, recall``: how often the candidates contain the label; null labels and candidates count as misses."""
    hit = F.coalesce(F.array_contains(F.col(candidates), F.col(label)), F.lit(False)).cast("double")
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("recall"))


def set_efficiency(df: DataFrame, sets: str, by: list[str] | None = None) -> DataFrame:
    """``by, n, mean, median, p90, singleton, empty`` of the sizes of prediction sets; a null set is empty."""
    sizes = df.select(*(by or []), F.coalesce(F.size(F.array_distinct(sets)), F.lit(0)).alias("s"))
    return sizes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("s").alias("mean"),
        F.median("s").alias("median"),
        F.expr("percentile_disc(0.9) within group (order by s)").cast("double").alias("p90"),
        F.avg((F.col("s") == 1).cast("double")).alias("singleton"),
        F.avg((F.col("s") == 0).cast("double")).alias("empty"),
    )


def level_floors(df: DataFrame, expected: dict[str, list[str]], least: int) -> DataFrame:
    """``cell columns, n`` of every expected combination of levels with fewer than ``least`` rows, those without rows included."""
    spark = df.sparkSession
    grid = None
    for column, levels in expected.items():
        one = spark.createDataFrame([(x,) for x in levels], f"`{column}` string")
        grid = one if grid is None else grid.crossJoin(one)
    counts = df.groupBy(*expected).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, list(expected), "left").select(*expected, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)
