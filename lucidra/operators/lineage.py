"""Splitting by lineage, leakage between splits, closures and iterated exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidra.functions.numeric import hash_split
from lucidra.operators.components import connected_components
from lucidra.util import cut, drop_cut


def lineage_tokens(df: DataFrame, row: str, fields: dict[str, str]) -> DataFrame:
    """``row, key, token``: one row for each value of each field; ``fields`` maps a key to an array<string> column or SQL expression.

    Tokens carry their key, so equal values of different keys stay apart; null and blank values give none.
    """
    parts = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(e).cast("array<string>").alias("vs")) for k, e in fields.items()])
    t = df.select(F.col(row).alias("row"), F.inline(parts)).select("row", "key", F.explode("vs").alias("v"))
    return t.where("trim(v) != ''").select("row", "key", F.concat_ws("=", "key", F.trim("v")).alias("token"))


def assign_splits(df: DataFrame, row: str, tokens: DataFrame, fractions: tuple[float, ...] = (0.2, 0.3, 0.5), seed: int = 0) -> DataFrame:
    """``row, component, split``: rows that share a token, directly or not, get one split by the hash of their component.

    The component is named by its smallest row id, so assignments depend on the set of rows only. A row without
    any token is an error: it could leak unseen.
    """
    loose = df.select(F.col(row).alias("row")).join(tokens.select("row").distinct(), "row", "left_anti")
    if not loose.isEmpty():
        raise KeyError("a row has none of the lineage fields")
    comp = connected_components(tokens, "row", "token")
    every = df.select(F.col(row).alias("row")).distinct().join(comp, "row", "left").withColumn("component", F.coalesce("component", "row"))
    return every.withColumn("split", hash_split(F.col("component").cast("string"), fractions, seed=seed))


def split_leakage(tokens: DataFrame, splits: DataFrame) -> DataFrame:
    """``key, token, splits``: tokens that occur in more than one split. ``splits``: row, split."""
    t = tokens.join(splits, "row").groupBy("key", "token").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return t.where(F.size("splits") > 1)


def require_no_leakage(tokens: DataFrame, splits: DataFrame) -> None:
    """Raise with the leaking keys if a token occurs in several splits."""
    bad = split_leakage(tokens, splits).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()
    if bad:
        raise ValueError("split leakage: " + ", ".join(f"{r.key} ({r.n})" for r in bad))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` of keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lineage_violations(df: DataFrame, fields: dict[str, str], exemptions: str) -> DataFrame:
    """Adds ``violations``: for each field that neither has a value nor an exemption with a reason, or that has both.

    ``fields`` maps a name to a nullable string expression, ``exemptions`` is a map<string,string> column.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = lambda k: F.try_element_at(F.coalesce(F.col(exemptions), F.create_map().cast("map<string,string>")), F.lit(k))
    checks = []
    for k, e in fields.items():
        v = F.expr(e)
        checks.append(F.when(blank(v) & blank(reason(k)), f"{k}: missing").when(~blank(v) & ~blank(reason(k)), f"{k}: value and exemption"))
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def id_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys that are missing in ``found`` or unexpected there."""
    missing = expected.select(key).distinct().join(found, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = found.select(key).distinct().join(expected, key, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


def closure(start: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``id, depth``: everything reachable from ``start`` (id) along ``edges`` (parent, child), with the fewest steps to it."""
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_rounds + 1):
        nxt = front.select(F.col("id").alias("parent")).join(edges, "parent").select(F.col("child").alias("id")).where("id is not null").distinct()
        front = cut(nxt.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        grown = cut(seen.unionByName(front))
        drop_cut(seen)
        seen = grown
    raise RuntimeError(f"the closure did not end within {max_rounds} rounds")


def exclude_crossing(atoms: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``parent, round``: parents excluded because one of their questions also stands in another split.

    ``atoms``: step, parent, split, question. The wording of a step is the most frequent one among the parents that
    remain, so removing parents can change it; rounds run until no wording crosses splits.
    """
    from lucidra.operators.composition import preferred

    gone = cut(atoms.select("parent").limit(0).withColumn("round", F.lit(0)))
    for k in range(1, max_rounds + 1):
        left = atoms.join(gone.select("parent"), "parent", "left_anti")
        wording = left.join(preferred(left, "step", "question").select("step", "preferred"), "step")
        crossing = wording.groupBy("preferred").agg(F.countDistinct("split").alias("s")).where("s > 1").select("preferred")
        newly = cut(wording.join(crossing, "preferred", "left_semi").select("parent").distinct().withColumn("round", F.lit(k)))
        if newly.isEmpty():
            return gone
        gone = cut(gone.unionByName(newly))
    raise RuntimeError(f"exclusions did not settle within {max_rounds} rounds")
