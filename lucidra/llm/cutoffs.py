"""Score cutoffs that keep a target fraction of each source (problem 7).

Scores in [0, 1] are integer-coded to ``DEPTH`` bits. A dyadic count tree holds, for every group and
every fourth level, how many scores fall into each dyadic interval; its leaves hold the distinct
scores with their counts. Batches are added by summing counts, so the tree persists as a table and
never needs the old rows again. A cutoff is found by descending from the root to the interval that
holds the target rank and refining that one leaf to its distinct scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucidra.util import cut

DEPTH = 24
STEP = 4


@dataclass(frozen=True)
class CountTree:
    """``nodes`` (groups, level, node, n) and ``leaves`` (groups, node, score, n)."""

    groups: tuple[str, ...]
    nodes: DataFrame
    leaves: DataFrame

    @staticmethod
    def of(df: DataFrame, groups: list[str], score: str) -> CountTree:
        """The tree of one batch. Scores must be finite and within [0, 1]; rows with null groups belong to a null group."""
        code = F.least(F.floor(F.col(score) * F.lit(float(1 << DEPTH))), F.lit((1 << DEPTH) - 1)).cast("long")
        leaves = cut(df.groupBy(*groups, code.alias("node"), (F.col(score) + F.lit(0.0)).alias("score")).agg(F.count(F.lit(1)).alias("n")))
        return CountTree(tuple(groups), _nodes(leaves, groups), leaves)

    def add(self, other: CountTree) -> CountTree:
        """The tree of both batches."""
        g = list(self.groups)
        leaves = self.leaves.unionByName(other.leaves).groupBy(*g, "node", "score").agg(F.sum("n").alias("n"))
        nodes = self.nodes.unionByName(other.nodes).groupBy(*g, "level", "node").agg(F.sum("n").alias("n"))
        return CountTree(self.groups, nodes, leaves)

    def save(self, path: str) -> None:
        """Write both tables below ``path``."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.leaves.write.mode("overwrite").parquet(f"{path}/leaves")

    @staticmethod
    def load(spark: SparkSession, path: str, groups: list[str]) -> CountTree:
        """Read a saved tree."""
        return CountTree(tuple(groups), spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/leaves"))

    def ranks(self, targets: DataFrame, percent: str) -> DataFrame:
        """Groups with a target: ``n`` rows and ``k = ceil(percent * n / 100)`` in exact integer arithmetic."""
        g = list(self.groups)
        totals = self.nodes.where(F.col("level") == STEP).groupBy(*g).agg(F.sum("n").alias("n"))
        k = F.expr(f"(cast({percent} as bigint) * n + 99) div 100")
        return targets.select(*g, percent).join(totals, g).select(*g, "n", k.alias("k"))

    def cutoffs(self, targets: DataFrame, percent: str) -> DataFrame:
        """``groups, n, k, cutoff, kept``: all scores at or above the cutoff, the k-th largest, are kept.

        ``targets`` has one row per group with the percentage to keep; groups without rows are absent,
        a percentage of 0 gives a null cutoff and keeps nothing.
        """
        g = list(self.groups)
        front = self.ranks(targets, percent).withColumn("left", F.col("k")).withColumn("at", F.lit(0).cast("long"))
        none = front.where("k = 0").select(*g, "n", "k", F.lit(None).cast("double").alias("cutoff"), F.lit(0).cast("long").alias("kept"))
        front = front.where("k > 0")
        down = W.partitionBy(*g)
        for level in range(STEP, DEPTH + 1, STEP):
            here = self.nodes.where(F.col("level") == level).select(*g, "node", F.col("n").alias("m"), F.shiftright("node", STEP).alias("at"))
            above = F.sum("m").over(down.orderBy(F.desc("node")).rowsBetween(W.unboundedPreceding, 0)) - F.col("m")
            front = (
                front.join(here, [*g, "at"])
                .withColumn("above", above)
                .where((F.col("above") < F.col("left")) & (F.col("above") + F.col("m") >= F.col("left")))
                .select(*g, "n", "k", (F.col("left") - F.col("above")).alias("left"), F.col("node").alias("at"))
            )
        leaf = self.leaves.select(*g, F.col("node").alias("at"), "score", F.col("n").alias("m"))
        through = F.sum("m").over(down.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0))
        found = (
            front.join(leaf, [*g, "at"])
            .withColumn("through", through)
            .where((F.col("through") >= F.col("left")) & (F.col("through") - F.col("m") < F.col("left")))
            .select(*g, "n", "k", F.col("score").alias("cutoff"), (F.col("k") - F.col("left") + F.col("through")).alias("kept"))
        )
        return found.unionByName(none)


def _nodes(leaves: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of every fourth level, the deeper ones first so that each level sums the one below."""
    out, below = None, leaves.groupBy(*groups, "node").agg(F.sum("n").alias("n"))
    for level in range(DEPTH, 0, -STEP):
        if level < DEPTH:
            below = below.groupBy(*groups, F.shiftright("node", STEP).alias("node")).agg(F.sum("n").alias("n"))
        rows = below.select(*groups, F.lit(level).alias("level"), "node", "n")
        out = rows if out is None else out.unionByName(rows)
    return cut(out)


def keep_fraction(df: DataFrame, groups: list[str], score: str, targets: DataFrame, percent: str) -> DataFrame:
    """The rows of ``df`` at or above the cutoff of their group. ``targets`` has one row per group.

    The cutoffs are written first, so that the join knows their size and broadcasts them only below Spark's threshold.
    """
    cuts = cut(CountTree.of(df, groups, score).cutoffs(targets, percent).select(*groups, F.col("cutoff").alias("_cutoff")))
    return df.join(cuts, groups).where(F.col(score) >= F.col("_cutoff")).drop("_cutoff")
