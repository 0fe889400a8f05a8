"""Whether correctness and confidence survive multi-step composition, and related comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.operators.metrics import ece, ratio


def chain_atoms(chains: DataFrame, chain: str, atoms: str, scored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``chain``, ``depth`` and each of ``columns`` as an array in the order of the atoms of the chain.

    ``atoms`` is the ordered array of atom keys. A chain with an atom that is not in ``scored`` is absent from the
    result; :func:`missing_atoms` lists those. Keys of ``scored`` must be unique.
    """
    links = chains.select(chain, F.size(atoms).alias("depth"), F.posexplode(atoms).alias("pos", key))
    got = links.join(scored.select(key, *columns), key)
    g = got.groupBy(chain, "depth").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_a"))
    return g.where(F.size("_a") == F.col("depth")).select(chain, "depth", *[F.col("_a")[c].alias(c) for c in columns])


def missing_atoms(chains: DataFrame, chain: str, atoms: str, scored: DataFrame, key: str) -> DataFrame:
    """``chain, pos, key`` of the atoms that are not in ``scored``."""
    links = chains.select(chain, F.posexplode(atoms).alias("pos", key))
    return links.join(scored.select(key).distinct(), key, "left_anti").select(chain, "pos", key)


def product(values: Column) -> Column:
    """Product of an array."""
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def union_bound(values: Column) -> Column:
    """1 minus the summed error of an array of confidences, at least 0."""
    return F.greatest(F.lit(0.0), 1.0 - F.aggregate(values, F.lit(0.0), lambda a, x: a + (1.0 - x)))


def composition_report(df: DataFrame, atoms_correct: str, chain_correct: str, atoms_conf: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Chain accuracy, how often all atoms are right, accuracy and loss given that, product confidence and union bound.

    Rates over no rows are null. Every chain needs at least one atom.
    """
    every = F.forall(F.col(atoms_correct), lambda x: x == 1)
    y = F.col(chain_correct).cast("double")
    g = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("chain_accuracy"),
        F.avg(every.cast("double")).alias("all_atoms_correct"),
        F.avg(F.when(every, y)).alias("accuracy_given_atoms"),
        *([F.avg(product(F.col(atoms_conf))).alias("mean_product"), F.avg(union_bound(F.col(atoms_conf))).alias("mean_union_bound")] if atoms_conf else []),
    )
    g = g.withColumn("synthesis_loss", 1 - F.col("accuracy_given_atoms"))
    return g.withColumn("product_gap", F.col("mean_product") - F.col("chain_accuracy")) if atoms_conf else g


def factorized(df: DataFrame, atoms_correct: str, chain_correct: str, band: float = 0.05) -> DataFrame:
    """One row: atomic accuracy, mean depth, chain error expected if atoms failed independently, residual and whether it is within the band."""
    a = F.col(atoms_correct)
    right = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    sums = df.agg((F.sum(right) / F.sum(F.size(a))).alias("atomic_accuracy"), F.avg(F.size(a)).alias("mean_depth"), (1 - F.avg(F.col(chain_correct).cast("double"))).alias("chain_error"))
    with_rate = df.crossJoin(F.broadcast(sums.select("atomic_accuracy")))
    expected = with_rate.agg(F.avg(1 - F.pow(F.col("atomic_accuracy"), F.size(a))).alias("expected_error"), F.avg(F.least(F.lit(1.0), F.size(a) * (1 - F.col("atomic_accuracy")))).alias("union_bound_error"))
    out = sums.crossJoin(expected).withColumn("residual", F.col("chain_error") - F.col("expected_error"))
    return out.withColumn("within_band", F.abs("residual") <= band)


def agreement(df: DataFrame, key: str, response: str, valid: list[str] | None = None) -> DataFrame:
    """``key, n, valid_rate, classes, idempotency``: how repeated answers agree; a single answer has no agreement (null)."""
    ok = F.col(response).isin(valid).cast("int") if valid else F.lit(1)
    c = df.groupBy(key, response).agg(F.count(F.lit(1)).alias("_c"), F.sum(ok).alias("_v"))
    n = F.sum("_c")
    pairs = F.sum(F.expr("_c * (_c - 1) div 2"))
    return c.groupBy(key).agg(n.alias("n"), (F.sum("_v") / n).alias("valid_rate"), F.count(F.lit(1)).alias("classes"), ratio(pairs, n * (n - 1) / 2).alias("idempotency"))


def rater_agreement(df: DataFrame, item: str, label: str) -> DataFrame:
    """One row: items rated at least twice, share rated unanimously, mean share of agreeing pairs of raters."""
    c = df.groupBy(item, label).agg(F.count(F.lit(1)).alias("_c"))
    g = c.groupBy(item).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"), F.sum(F.expr("_c * (_c - 1) div 2")).alias("_same")).where("_n > 1")
    return g.agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("_k") == 1).cast("double")).alias("unanimous"), F.avg(F.col("_same") / (F.col("_n") * (F.col("_n") - 1) / 2)).alias("pairwise"))


def preferred(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, preferred, variants``: the most frequent variant; ties go to the shorter, then to the one first in order up to case."""
    c = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.struct(-F.col("_n"), F.length(value), F.lower(F.col(value)), F.col(value))
    return c.groupBy(key).agg(F.min_by(value, rank).alias("preferred"), F.count(F.lit(1)).alias("variants"))


def _panel(df: DataFrame, conf: str, correct: str, panel: Column) -> DataFrame:
    t = df.withColumn("_panel", panel).where("_panel is not null")
    e = ece(t, conf, correct, ["_panel"])
    c, y = F.col(conf), F.col(correct).cast("double")
    return t.groupBy("_panel").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("accuracy"), F.avg((c - y) * (c - y)).alias("brier")).join(e, "_panel")


def domain_transfer(df: DataFrame, conf: str, correct: str, is_source: Column) -> DataFrame:
    """One row: count, accuracy, ECE and Brier on the source and on the target rows, and how much the errors rise."""
    g = _panel(df, conf, correct, F.when(is_source, "source").otherwise("target"))
    pick = lambda p, c: F.max(F.when(F.col("_panel") == p, F.col(c)))
    cols = [pick(p, c).alias(f"{p}_{c}") for p in ("source", "target") for c in ("n", "accuracy", "ece", "brier")]
    r = g.agg(*cols)
    return r.select("*", (F.col("target_ece") - F.col("source_ece")).alias("ece_increase"), (F.col("target_brier") - F.col("source_brier")).alias("brier_increase"))


def transfer_gain(df: DataFrame, baseline: str, calibrated: str, correct: str, is_within: Column) -> DataFrame:
    """One row: gains of a calibrator over a baseline within and across domains, and the difference of the gains."""
    panel = F.when(is_within, "within").otherwise("cross")
    g = _panel(df, baseline, correct, panel).select("_panel", "n", F.col("ece").alias("be"), F.col("brier").alias("bb"))
    k = _panel(df, calibrated, correct, panel).select("_panel", F.col("ece").alias("ke"), F.col("brier").alias("kb"))
    both = g.join(k, "_panel").select("_panel", "n", (F.col("be") - F.col("ke")).alias("ece_gain"), (F.col("bb") - F.col("kb")).alias("brier_gain"))
    pick = lambda p, c: F.max(F.when(F.col("_panel") == p, F.col(c)))
    r = both.agg(*[pick(p, c).alias(f"{p}_{c}") for p in ("within", "cross") for c in ("n", "ece_gain", "brier_gain")])
    return r.select("*", (F.col("within_ece_gain") - F.col("cross_ece_gain")).alias("ece_advantage"), (F.col("within_brier_gain") - F.col("cross_brier_gain")).alias("brier_advantage"))
