"""Atomic questions out of the decompositions of composed ones, and panels of frequency and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.functions.dimensions import r1_level
from lucidra.functions.text import resolve_placeholders
from lucidra.operators import metrics, select
from lucidra.operators.composition import preferred

STEP = "array<struct<position:int,source_step_id:string,question:string,answer:string,supporting_title:string>>"


def _same(c: Column) -> Column:
    """Identity of a text up to blanks and letter case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def occurrences(chains: DataFrame, provenance: str = "provenance") -> DataFrame:
    """``step, parent, split, position, question, raw_question, answer, title``: one row per step of each chain.

    ``chains``: example_id, split and the provenance JSON. Steps are taken in the order of their positions, which must
    be 1, 2, ...; references to earlier answers are resolved, forward ones are an error.
    """
    s = F.array_sort(F.from_json(F.get_json_object(provenance, "$.question_decomposition"), STEP))
    t = chains.select(F.col("example_id").alias("parent"), "split", s.alias("steps")).where(F.size("steps") > 0)
    counted = F.exists(F.transform("steps", lambda x, i: x["position"] == i + 1), lambda ok: ~F.coalesce(ok, F.lit(False)))
    t = t.withColumn("steps", F.when(counted, F.raise_error(F.concat(F.lit("positions must count from 1 in "), "parent"))).otherwise(F.col("steps")))
    t = t.withColumn("answers", F.col("steps.answer"))
    each = t.select("parent", "split", "answers", F.inline("steps"))
    return each.select(F.col("source_step_id").alias("step"), "parent", "split", "position", resolve_placeholders("question", "answers", "position").alias("question"), F.col("question").alias("raw_question"), "answer", F.col("supporting_title").alias("title"))


def conflicts(steps: DataFrame) -> DataFrame:
    """``step, conflict``: steps that occur in several splits, or with different answers or titles."""
    g = steps.groupBy("step").agg(F.countDistinct("split").alias("s"), F.countDistinct(_same(F.col("answer"))).alias("a"), F.countDistinct(_same(F.col("title"))).alias("t"))
    named = F.array_compact(F.array(F.when(F.col("s") > 1, "split"), F.when(F.col("a") > 1, "answer"), F.when(F.col("t") > 1, "title")))
    return g.select("step", F.explode(named).alias("conflict"))


def atoms(steps: DataFrame) -> DataFrame:
    """One row per step: preferred wording, answer and title, number of occurrences and its parent links in order.

    Steps that contradict each other are an error; see :func:`conflicts`.
    """
    if not (bad := conflicts(steps)).isEmpty():
        raise ValueError(f"conflicting steps: {[tuple(r) for r in bad.limit(5).collect()]}")
    g = steps.groupBy("step").agg(
        F.min("split").alias("split"), F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set(F.struct("parent", "position"))).alias("parents"), F.countDistinct("raw_question").alias("raw_variants")
    )
    for c in ("question", "answer", "title"):
        p = preferred(steps.where(F.col(c).isNotNull()), "step", c).select("step", F.col("preferred").alias(c), F.col("variants").alias(f"{c}_variants"))
        g = g.join(p, "step", "left")
    return g


def frequency_panel(examples: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """(panel, exclusions, cuts): examples with ``r1_level`` by tertiles of the development proxies only.

    ``examples``: example_id, split; ``seeds``: example_id, proxy. Examples without a seed or with a missing or negative
    proxy are counted as excluded; an empty split x level cell is an error.
    """
    j = examples.join(seeds.select("example_id", "proxy", F.lit(True).alias("_seed")), "example_id", "left")
    why = F.when(F.col("_seed").isNull(), "missing_seed").when(F.col("proxy").isNull() | F.isnan("proxy"), "missing_proxy").when(F.col("proxy") < 0, "negative_proxy")
    j = j.withColumn("_why", why)
    ok = j.where("_why is null").drop("_why", "_seed")
    cuts = select.tertiles(ok.where("split = 'development'"), "proxy")
    panel = ok.withColumn("r1_level", r1_level(F.col("proxy"), *cuts))
    empty = metrics.level_floors(panel, {"split": ["development", "calibration", "test"], "r1_level": ["tail", "middle", "head"]}, 1).collect()
    if empty:
        raise ValueError(f"empty cells: {[tuple(r) for r in empty]}")
    return panel, j.where("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("n")), cuts


def least_of_atoms(composed: DataFrame, atoms_col: str, values: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``value`` of each composed row as the least of its atoms'; null if an atom has none."""
    links = composed.select("example_id", F.explode(atoms_col).alias(key)).join(values.select(key, value), key, "left")
    least = links.groupBy("example_id").agg(F.when(F.count(value) == F.count(F.lit(1)), F.min(value)).alias(value))
    return composed.join(least, "example_id", "left")


def frequency_depth_report(rows: DataFrame, floor: int = 75) -> tuple[DataFrame, DataFrame]:
    """(cells, contrasts) of ``r1, r5, correct``: accuracy per cell with support, and the tail gap at each depth with their difference.

    The gap is tail accuracy minus the pooled accuracy of middle and head; it is null where a side is empty.
    """
    cells = rows.groupBy("r5", "r1").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("right"), F.avg("correct").alias("accuracy")).withColumn("supported", F.col("n") >= floor)
    tail = F.col("r1") == "tail"
    gaps = rows.groupBy("r5").agg((F.avg(F.when(tail, F.col("correct"))) - F.avg(F.when(~tail, F.col("correct")))).alias("gap"))
    pick = lambda level: F.max(F.when(F.col("r5") == level, F.col("gap")))
    return cells, gaps.agg(pick("one_hop").alias("one_hop_gap"), pick("two_hop").alias("two_hop_gap"), (pick("two_hop") - pick("one_hop")).alias("interaction"))


def synthesis_by_level(chains: DataFrame, atoms_col: str, scored: DataFrame) -> DataFrame:
    """``r1, n_chains, composed_accuracy, both_right, synthesis_loss``; every assigned chain counts in the denominator.

    ``chains``: example_id, r1 and the atom ids; ``scored``: example_id, correct. Chains or atoms without a score
    are neither right nor wrong but stay in ``n_chains``.
    """
    part = chains.select("example_id", F.explode(atoms_col).alias("atom")).join(scored.select(F.col("example_id").alias("atom"), F.col("correct").alias("_a")), "atom", "left")
    a = part.groupBy("example_id").agg(F.when(F.count("_a") == F.count(F.lit(1)), F.min("_a")).alias("_all"))
    t = chains.join(a, "example_id", "left").join(scored.select("example_id", "correct"), "example_id", "left")
    full = F.col("_all").isNotNull() & F.col("correct").isNotNull()
    both = F.sum(F.when(full & (F.col("_all") == 1), 1).otherwise(0))
    return t.groupBy("r1").agg(
        F.count(F.lit(1)).alias("n_chains"),
        (F.sum(F.when(full, F.col("correct")).otherwise(0)) / F.count(F.lit(1))).alias("composed_accuracy"),
        both.alias("both_right"),
        F.try_divide(F.sum(F.when(full & (F.col("_all") == 1), 1 - F.col("correct")).otherwise(0)), both).alias("synthesis_loss"),
    )
