"""Connected components of rows that share tokens, without any group on one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidra.util import counted_hot, cut, drop_cut, skew_join


def _star_join(edges: DataFrame, share: float) -> DataFrame:
    """``u, v, m`` with m the least of u and its neighbours; hubs with very many edges do not move them."""
    stats = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    least = stats.select("u", F.least("u", "m").alias("m"))
    return skew_join(edges, least, "u", "inner", hot=counted_hot(stats, "u", "n", share))


def connected_components(links: DataFrame, row: str, token: str, max_rounds: int = 60, hot_share: float = 0.02) -> DataFrame:
    """``row, component`` for every row that shares a token with another row, directly or through others.

    ``links`` has one row per (row id, token); null rows and tokens link nothing. ``component`` is the
    smallest row id of the component, so it does not depend on any order. Rows that are alone are absent.

    Each token ties its rows to the smallest of them, so a token with n rows costs n - 1 edges, never pairs.
    Then large-star and small-star rounds run to the fixpoint; a round rewires every edge to the
    smallest neighbour, and chains of any length shrink by about half in each. The lineage is cut by
    tables in the shared folder. Raises if ``max_rounds`` do not suffice rather than return partial groups.
    """
    pairs = links.select(F.col(row).alias("row"), F.col(token).alias("token")).dropna().distinct()
    pairs = cut(pairs)
    hubs = cut(pairs.groupBy("token").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("n")))
    hot = counted_hot(hubs, "token", "n", hot_share)
    edges = skew_join(pairs, hubs.where("n > 1").drop("n"), "token", "inner", hot=hot).where("row != hub").select(F.col("row").alias("u"), F.col("hub").alias("v"))
    edges = cut(edges.distinct())
    drop_cut(pairs)

    state, old = None, edges
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_star_join(both, hot_share).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = _star_join(down, hot_share)
        small = joined.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        edges = cut(small.where("u != v").distinct())
        drop_cut(large)
        drop_cut(old)
        old = edges
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return edges.groupBy(F.col("u").alias("row")).agg(F.min("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("row"), F.col("v").alias("component")).distinct()
            )
        state = tuple(seen)
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
