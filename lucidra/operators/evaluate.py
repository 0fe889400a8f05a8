"""The whole evaluation report of one run: identity checks, coverage floors, metrics per group, crossing and policy level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.functions.dimensions import POLICY_GRID, r7_level
from lucidra.operators import metrics

# Columns that must hold one value per report.
LINKAGE = ["run_id", "model_snapshot_id", "evaluation_track", "condition_table_hash", "calibration_object_hash"]
POLICY = "R7"


@dataclass(frozen=True)
class Report:
    """The tables of a report and what they are about."""

    identity: dict
    overall: DataFrame
    groups: dict[str, DataFrame]
    interactions: dict[str, DataFrame]
    frontier: DataFrame | None
    curve: DataFrame


def outcome(c: Column) -> Column:
    """1 or 0 for the written booleans of a CSV (1/true/yes, 0/false/no, any case); null for anything else."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes"), 1).when(t.isin("0", "false", "no"), 0)


def identity_of(df: DataFrame, legacy: bool = False) -> dict:
    """The single run, model, track, condition table and calibrator of the rows; a mixture or a blank is an error.

    ``legacy`` allows missing linkage columns and score kinds (then probabilities are assumed).
    """
    optional = ["score_kind", "score_source", "calibrator_id", "normalization_contract"]
    have = [c for c in [*LINKAGE, *optional, "condition_hash"] if c in df.columns]
    aggs = []
    for c in have:
        v = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        aggs += [F.min(F.when(v != "", v)).alias(f"{c}_lo"), F.max(F.when(v != "", v)).alias(f"{c}_hi"), F.count_if(v == "").alias(f"{c}_blank")]
    r = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    if not r.n:
        raise ValueError("there are no rows to evaluate")
    out: dict = {"rows": r.n}
    for c in [*LINKAGE, *optional, "condition_hash"]:
        lo, hi, blank = (r[f"{c}_lo"], r[f"{c}_hi"], r[f"{c}_blank"]) if c in have else (None, None, r.n)
        if c != "condition_hash" and lo != hi:
            raise ValueError(f"one report needs a single {c}; found {lo!r} and {hi!r}")
        if blank and c not in ("calibrator_id", "normalization_contract") and not legacy:
            raise ValueError(f"{c} is blank on {blank} rows")
        if c in ("calibrator_id", "normalization_contract", "score_kind", "score_source") and lo is not None and blank:
            raise ValueError(f"{c} must be on every row or on none")
        if c != "condition_hash":
            out[c] = lo
    if out["score_kind"] is None:
        out |= {"score_kind": "legacy_probability_assumption", "score_source": "legacy_confidence", "calibrator_id": "legacy_unspecified"}
    if out["score_kind"] in ("probability", "legacy_probability") and not out["calibrator_id"]:
        raise ValueError("probabilities need a calibrator_id")
    return out


def evaluate(
    df: DataFrame,
    groups: list[str] | None = None,
    interactions: list[list[str]] | None = None,
    thresholds: list[float] | None = None,
    n_bins: int = 10,
    expected_levels: dict[str, list[str]] | None = None,
    least_level: int = 1,
    least_cell: int = 1,
    legacy: bool = False,
) -> Report:
    """Evaluate rows of strings or numbers with ``example_id, confidence, correct`` and any group columns.

    Scores that are no probabilities have no calibration metrics, and no policy metrics either unless a normalization
    contract is declared. ``R7`` as a group or in a crossing means the policy grid. Duplicate or blank ids, unusable
    pairs, missing group columns and expected levels or cells below their floors are errors.
    """
    groups, interactions = groups or [], interactions or []
    identity = identity_of(df, legacy)
    asked = {c for x in [groups, *interactions, list(expected_levels or {})] for c in x if c != POLICY}
    absent = sorted(({"example_id", "confidence", "correct"} | asked) - set(df.columns))
    if absent:
        raise KeyError(f"missing columns {absent}")
    t = df.select("example_id", *sorted(asked - {"example_id"}), F.expr("try_cast(confidence as double)").alias("confidence"), outcome(F.col("correct")).alias("correct"))
    ids = t.agg(F.count_if(F.coalesce(F.trim("example_id"), F.lit("")) == "").alias("blank"), F.count(F.lit(1)).alias("n"), F.countDistinct("example_id").alias("k")).first()
    if ids.blank or ids.n != ids.k:
        raise ValueError("example_id must be nonblank and unique")
    blank_groups = [c for c in sorted(asked) if not t.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").isEmpty()]
    if blank_groups:
        raise ValueError(f"blank values in the group columns {blank_groups}")
    probability = identity["score_kind"] in ("probability", "legacy_probability", "legacy_probability_assumption")
    policy = probability or bool(identity["normalization_contract"])
    if not policy and (thresholds or POLICY in groups or any(POLICY in x for x in interactions)):
        raise ValueError("policy metrics of raw scores need a normalization contract")
    if policy:
        metrics.require_pairs(t, "confidence", "correct")
    elif not t.where("confidence is null or isnan(confidence) or abs(confidence) = double('inf') or correct is null").isEmpty():
        raise ValueError("scores must be finite and outcomes binary")
    for column, levels in (expected_levels or {}).items():
        if column != POLICY:
            low = metrics.level_floors(t.withColumn(column, F.col(column).cast("string")), {column: levels}, least_level).collect()
            if low:
                raise ValueError(f"levels below {least_level} rows: {[tuple(r) for r in low]}")
    for x in interactions:
        cols = [c for c in x if c != POLICY]
        if expected_levels and cols and all(c in expected_levels for c in cols):
            low = metrics.level_floors(t, {c: expected_levels[c] for c in cols}, least_cell).collect()
            if low:
                raise ValueError(f"cells below {least_cell} rows: {[tuple(r) for r in low]}")

    grid = list(thresholds or POLICY_GRID) if policy else []
    if grid != sorted(set(grid)):
        raise ValueError("thresholds must rise")

    def report(by: list[str]) -> DataFrame:
        full = metrics.group_report(t, "confidence", "correct", by, n_bins) if policy else _ranking_only(t, by)
        if not probability:
            for c in ("brier", "log_loss", "ece", "ace"):
                full = full.withColumn(c, F.lit(None).cast("double"))
        return full

    def policy_report(by: list[str]) -> DataFrame:
        s = metrics.selective(t, "confidence", "correct", grid, by)
        return s.withColumn("policy_level", r7_level(F.col("threshold"))).withColumn("answer", F.col("accepted")).withColumn("set", F.lit(0)).withColumn("abstain", F.col("total") - F.col("accepted"))

    curve = metrics.risk_coverage(t, "confidence", "correct") if policy else _curve(t)
    return Report(
        identity | {"probability_metrics": "computed" if probability else "withheld", "policy_metrics": "computed" if policy else "withheld"},
        report([]),
        {c: policy_report([]) if c == POLICY else report([c]) for c in groups},
        {"*".join(x): policy_report([c for c in x if c != POLICY]) if POLICY in x else report(x) for x in interactions},
        policy_report([]) if policy else None,
        curve,
    )


def _scaled(t: DataFrame) -> DataFrame:
    """Scores of any range moved into [0, 1] in the same order, for the ranking metrics only."""
    ends = t.agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), (F.col("confidence") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return t.crossJoin(F.broadcast(ends)).withColumn("confidence", x).drop("lo", "hi")


def _ranking_only(t: DataFrame, by: list[str]) -> DataFrame:
    s = _scaled(t)
    out = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))
    for part in (metrics.auroc(s, "confidence", "correct", by), metrics.aurc(s, "confidence", "correct", by)):
        out = metrics.null_safe_join(out, part, by)
    return out


def _curve(t: DataFrame) -> DataFrame:
    return metrics.risk_coverage(_scaled(t), "confidence", "correct")
