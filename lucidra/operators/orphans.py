"""References to records that do not exist (problem 3).

A reference is a tuple of child columns that should name a row of a parent table. References are
grouped by *null mask* (which of the key columns are null); each mask is joined on its non-null
columns only, under a declared match rule:

``simple``   a null in any key column makes the row no reference;
``partial``  the non-null columns must be found together in one parent row;
``full``     all columns null is no reference, some null is an unresolved reference (``malformed``).

The state of a reference at time *t* (the child's arrival) depends on all parent rows with its key:
``missing`` when there is none, ``late`` when all arrived after *t*, ``deleted`` when all that had
arrived were deleted by *t*; otherwise it resolves.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucidra.util import counted_hot, cut, skew_join

#: End of what was never deleted, and the moment just before it that stands for an unknown time of judgement.
FOREVER, LAST = "9999-12-31 00:00:00", "9999-12-30 00:00:00"


def reference_key(c: Column) -> Column:
    """Keys compare after trimming blanks and ignoring letter case; blank is null."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(t != "", t)


def _digest(cols: list[str]) -> Column:
    return cols and F.to_json(F.array(*cols))


def _lives(parent: DataFrame, cols: list[str], arrived: str, deleted: str | None, salts: int) -> DataFrame:
    """``_k, _a, _e``: spans [arrived, deleted) that cover all times at which some row of a key is alive.

    Of rows that arrived later only those that outlive the earlier ones matter. They are told apart within
    salted parts of a key: a key that holds a third of all rows is never sorted in one task.
    """
    end = F.coalesce(F.col(deleted), F.to_timestamp_ntz(F.lit(FOREVER))) if deleted else F.to_timestamp_ntz(F.lit(FOREVER))
    rows = (
        parent.select(_digest(cols).alias("_k"), F.col(arrived).alias("_a"), end.alias("_e"))
        .where(F.col("_k").isNotNull())
        .withColumn("_a", F.coalesce("_a", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))))
        .groupBy("_k", "_a")
        .agg(F.max("_e").alias("_e"))
        .withColumn("_s", F.pmod(F.xxhash64("_a"), F.lit(salts)))
    )
    before = W.partitionBy("_k", "_s").orderBy("_a").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max("_e").over(before)).where(F.col("_m").isNull() | (F.col("_e") > F.col("_m"))).select("_k", "_a", "_e")


def _unresolved(refs: DataFrame, lives: DataFrame, hot: list, salts: int) -> DataFrame:
    """The references (``_k, _t``) to no row that is alive at their time: an anti-join. References to hot keys are
    split into ``salts`` parts and meet a copy of the key's spans in each, so that nothing has to be broadcast."""
    is_hot = F.col("_k").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("row_id"), F.lit(salts))).otherwise(0)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = refs.withColumn("_s", salt.cast("int")).alias("r")
    right = lives.withColumn("_s", F.explode(every)).alias("l")
    alive = (F.col("r._k") == F.col("l._k")) & (F.col("r._s") == F.col("l._s")) & (F.col("l._a") <= F.col("r._t")) & (F.col("l._e") > F.col("r._t"))
    return left.join(right, alive, "left_anti").drop("_s")


def orphan_references(
    child: DataFrame,
    parent: DataFrame,
    row_id: str,
    child_keys: list[str],
    parent_keys: list[str],
    seen: str,
    arrived: str,
    deleted: str | None = None,
    match: str = "simple",
    salts: int = 32,
    hot_share: float = 0.01,
    keep: list[str] | None = None,
) -> DataFrame:
    """Unresolved references of ``child``: ``row_id, ref_key, ref_state`` and the columns in ``keep``.

    ``child_keys`` hold comparable keys (see :func:`reference_key`); a row may occur several times with
    different keys, equal (row, key) pairs are reported once. ``seen`` is the time at which the reference
    is judged; a null there counts as the end of time. ``ref_key`` is the key, or the JSON array of the
    keys when there are several columns. Each mask is one anti-join; the few unresolved references then look up
    when their key first arrived. Empty tables give an empty result or only ``missing`` rows.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match rule {match!r}")
    if len(child_keys) != len(parent_keys) or not child_keys:
        raise ValueError("child_keys and parent_keys must name equally many columns")
    n, keep = len(child_keys), keep or []
    names = [f"_c{i}" for i in range(n)]
    refs = child.select(
        F.col(row_id).alias("row_id"),
        F.coalesce(F.col(seen), F.to_timestamp_ntz(F.lit(LAST))).alias("_t"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        *[F.col(c).alias(a) for c, a in zip(child_keys, names)],
    )
    refs = refs.dropDuplicates(["row_id", *names])
    targets = parent.select(
        *[F.col(c).alias(a) for c, a in zip(parent_keys, names)],
        F.col(arrived).alias("_arrived"),
        *([F.col(deleted).alias("_deleted")] if deleted else []),
    )
    label = F.col(names[0]) if n == 1 else F.to_json(F.array(*names), {"ignoreNullFields": "false"})
    parts = []
    for size in range(n, 0, -1):
        for there in combinations(range(n), size):
            if size < n and match == "simple":
                continue
            mask = F.lit(True)
            for i in range(n):
                mask = mask & (F.col(names[i]).isNotNull() if i in there else F.col(names[i]).isNull())
            some = refs.where(mask)
            if size < n and match == "full":
                parts.append(some.withColumn("ref_state", F.lit("malformed")))
                continue
            cols = [names[i] for i in there]
            mine = targets.dropna(subset=cols)
            some = some.withColumn("_k", _digest(cols))
            counts = cut(some.groupBy("_k").agg(F.count(F.lit(1)).alias("n")))
            hot = counted_hot(counts, "_k", "n", hot_share)
            lost = _unresolved(some, _lives(mine, cols, "_arrived", "_deleted" if deleted else None, salts), hot, salts)
            firsts = mine.groupBy(_digest(cols).alias("_k")).agg(F.min(F.coalesce("_arrived", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00")))).alias("_first"))
            state = F.when(F.col("_first").isNull(), "missing").when(F.col("_first") > F.col("_t"), "late").otherwise("deleted")
            parts.append(skew_join(lost, firsts, "_k", "left", hot=hot).withColumn("ref_state", state).drop("_k", "_first"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("row_id", label.alias("ref_key"), "ref_state", *[F.col(f"_keep_{c}").alias(c) for c in keep])


def orphan_report(orphans: DataFrame, table: str | Column, at: str) -> DataFrame:
    """Unresolved references per table, month of ``at`` and state: ``child_table, period, ref_state, refs, rows``."""
    return (
        orphans.groupBy((F.lit(table) if isinstance(table, str) else table).alias("child_table"), F.date_format(at, "yyyy-MM").alias("period"), "ref_state")
        .agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("row_id").alias("rows"))
    )
