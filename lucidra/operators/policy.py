"""The fail-closed answer / set / abstain policy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.functions.dimensions import DIMENSIONS, POLICY_GRID, r7_level

ALL_ACTIONS = ("answer", "set", "abstain")


def read_policy(score: Column, threshold: Column, candidates: Column, supported: Column, ambiguity_complete: Column, allowed: Column | None = None) -> Column:
    """``struct(action, reason, answer, candidates)`` of one scored read.

    The first rule that applies decides: no calibration support, score below the threshold, no candidate,
    several candidates (a set, if sets are allowed), a single candidate whose ambiguity is not settled, and
    only then a committed answer. Null flags count as false, null candidates as none. Scores and thresholds
    must be in [0, 1]; see :func:`policy_violations`.
    """
    allowed = F.array(*map(F.lit, ALL_ACTIONS)) if allowed is None else allowed
    may = lambda a: F.coalesce(F.array_contains(allowed, a), F.lit(False))
    unique = F.array_distinct(F.coalesce(candidates, F.array().cast("array<string>")))
    none, nobody = F.array().cast("array<string>"), F.lit(None).cast("string")

    def outcome(action: str, reason: Column | str, answer: Column = nobody, kept: Column = none) -> Column:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(action).alias("action"), why.alias("reason"), answer.alias("answer"), kept.alias("candidates"))

    complete = F.coalesce(ambiguity_complete, F.lit(False))
    open_set = F.when(complete, "non_singleton_prediction_set").otherwise("ambiguity_incomplete_candidate_set")
    return (
        F.when(~F.coalesce(supported, F.lit(False)), outcome("abstain", "unsupported_calibration_group"))
        .when(~F.coalesce(score >= threshold, F.lit(False)), outcome("abstain", "below_threshold"))
        .when(F.size(unique) == 0, outcome("abstain", "empty_candidate_set"))
        .when((F.size(unique) > 1) & may("set"), outcome("set", open_set, kept=unique))
        .when(F.size(unique) > 1, outcome("abstain", "non_singleton_set_not_allowed"))
        .when(~complete, outcome("abstain", "ambiguity_incomplete_singleton"))
        .when(may("answer"), outcome("answer", "threshold_accepted", F.element_at(unique, 1), unique))
        .when(may("set"), outcome("set", "singleton_answer_not_allowed", kept=unique))
        .otherwise(outcome("abstain", "no_permitted_commit_action"))
    )


def selective_read(answer: Column, score: Column, threshold: Column, supported: Column) -> Column:
    """The policy for one answer of unknown ambiguity: it never commits."""
    return read_policy(score, threshold, F.array(answer), supported, F.lit(False), F.array(F.lit("answer"), F.lit("abstain")))


def prediction_set_read(candidates: Column, supported: Column, allowed: Column | None = None) -> Column:
    """The policy for a prediction set: score 1 against threshold 0, ambiguity not settled."""
    return read_policy(F.lit(1.0), F.lit(0.0), candidates, supported, F.lit(False), allowed)


def policy_violations(score: Column, threshold: Column, score_kind: Column, calibrator: Column, contract: Column) -> Column:
    """Names of the broken preconditions of a read: ranges, a probability without calibrator, a raw score without contract."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    off = lambda c: F.coalesce(F.isnan(c) | (c < 0) | (c > 1), F.lit(True))
    checks = [
        F.when(off(score), "score"),
        F.when(off(threshold), "threshold"),
        F.when(~F.coalesce(score_kind.isin("raw", "probability", "legacy_probability"), F.lit(False)), "score_kind"),
        F.when((score_kind == "probability") & blank(calibrator), "calibrator_id"),
        F.when((score_kind == "raw") & blank(contract), "normalization_contract"),
    ]
    return F.array_compact(F.array(*checks))


def policy_grid(df: DataFrame, name: str = "threshold", level: str = "policy_level", grid: list[float] | None = None) -> DataFrame:
    """Every row once per threshold, without a second scan of the input; the grid is a literal array."""
    rows = F.array(*[F.struct(F.lit(float(t)).alias(name), r7_level(F.lit(float(t))).alias(level)) for t in (grid or POLICY_GRID)])
    return df.select("*", F.inline(rows))


def decide(df: DataFrame, score: str, candidates: str, supported: str, ambiguity_complete: str, allowed: str | None = None) -> DataFrame:
    """``df`` times the policy grid with action, reason, answer and returned candidates."""
    swept = policy_grid(df)
    d = read_policy(F.col(score), F.col("threshold"), F.col(candidates), F.col(supported), F.col(ambiguity_complete), F.col(allowed) if allowed else None)
    return swept.withColumn("decision", d).select(*df.columns, "threshold", "policy_level", "decision.action", "decision.reason", F.col("decision.answer").alias("committed"), F.col("decision.candidates").alias("returned"))


def decide_r7(df: DataFrame, answer: str, confidence: str) -> DataFrame:
    """Answer or abstain at every grid threshold: no calibrated confidence, an empty answer and a model that abstains never commit."""
    from lucidra.functions.text import is_abstention

    swept = policy_grid(df)
    blank = F.coalesce(F.trim(F.col(answer)), F.lit("")) == ""
    reason = (
        F.when(F.col(confidence).isNull(), "unsupported_calibration_group")
        .when(blank, "empty_answer")
        .when(is_abstention(F.col(answer)), "model_abstained")
        .when(F.col(confidence) < F.col("threshold"), "below_threshold")
        .otherwise("threshold_accepted")
    )
    return swept.withColumn("reason", reason).withColumn("action", F.when(F.col("reason") == "threshold_accepted", "answer").otherwise("abstain"))


def action_counts(decisions: DataFrame, by: list[str]) -> DataFrame:
    """``by, answer, set, abstain``: how often each action was taken."""
    return decisions.groupBy(*by).agg(*[F.count_if(F.col("action") == a).alias(a) for a in ALL_ACTIONS])


LEVELS = DIMENSIONS["R7"][1]
