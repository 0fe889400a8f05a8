"""Invariants of the typed records as one ``violations`` array per row, and links between the record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidra.functions.dimensions import dimension_code, level_slug, r7_level

TRACKS = ["finite_label_certified", "open_ended_stress"]
ACTIONS = ["answer", "set", "abstain"]
SCORE_KINDS = ["raw", "probability", "legacy_probability"]


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _hash(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def _none(c: Column) -> Column:
    """Whether an array is null or empty."""
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _repeats(c: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(c)) != F.size(c), F.lit(False))


def _outside(a: Column, b: Column) -> Column:
    """Whether array ``a`` has an element that ``b`` lacks."""
    empty = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(a, empty), F.coalesce(b, empty))) > 0


def _collect(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items()])))


def dimensions_of(c: str) -> Column:
    """map<code, struct<raw,level>> with names resolved to R1..R7 and levels as slugs; names that are none are dropped."""
    pairs = F.transform(F.map_entries(F.col(c)), lambda e: F.struct(dimension_code(e["key"]).alias("key"), F.struct(e["value"]["raw"].alias("raw"), level_slug(e["value"]["level"]).alias("level")).alias("value")))
    named = F.filter(pairs, lambda e: e["key"].isNotNull())
    firsts = F.filter(named, lambda e, i: ~F.array_contains(F.transform(F.slice(named, F.lit(1), i), lambda x: x["key"]), e["key"]))
    return F.map_from_entries(firsts)


def _actions(c: Column) -> Column:
    return _none(c) | _repeats(c) | _outside(c, F.array(*map(F.lit, ACTIONS))) | ~F.array_contains(c, "abstain")


def workload_violations(df: DataFrame) -> DataFrame:
    """Adds ``violations`` to workload records: the names of the broken rules, in a fixed order; empty for a sound record."""
    t = df.withColumn("_d", dimensions_of("dimensions"))
    finite = F.col("track") == "finite_label_certified"
    union = F.array_distinct(F.flatten(F.map_values(F.coalesce(F.col("interpretation_answers"), F.create_map().cast("map<string,array<string>>")))))
    raw = lambda k: F.expr(f"try_cast(try_element_at(_d, '{k}').raw as double)")
    has = lambda k: F.map_contains_key(F.col("_d"), k)
    parts = F.coalesce(F.col("constituent_example_ids"), F.array().cast("array<string>"))
    checks = {
        "example_id": _blank(F.col("example_id")),
        "question": _blank(F.col("question")),
        "accepted_answers": _none(F.col("accepted_answers")) | _repeats(F.col("accepted_answers")),
        "track": ~F.col("track").isin(TRACKS),
        "r4_annotation_hash": F.col("r4_annotation_hash").isNotNull() & ~_hash(F.col("r4_annotation_hash")),
        "r5_chain_spec_hash": F.col("r5_chain_spec_hash").isNotNull() & ~_hash(F.col("r5_chain_spec_hash")),
        "candidate_universe": (finite & _none(F.col("candidate_universe"))) | _repeats(F.col("candidate_universe")),
        "answers_outside_universe": F.coalesce(finite & _outside(F.col("accepted_answers"), F.col("candidate_universe")), F.lit(False)),
        "interpretations_outside_universe": F.coalesce(finite & _outside(union, F.col("candidate_universe")), F.lit(False)),
        "allowed_actions": _actions(F.col("allowed_actions")),
        "dimensions": ~F.coalesce(F.array_sort(F.map_keys("_d")) == F.array(*map(F.lit, ["R2", "R4", "R5", "R6"])), F.lit(False)),
        "interpretation_count": F.coalesce(has("R4"), F.lit(False)) & ~F.coalesce(F.size(F.map_keys("interpretation_answers")) == raw("R4"), F.lit(False)),
        "interpretation_union": F.coalesce(has("R4"), F.lit(False)) & (_outside(union, F.col("accepted_answers")) | _outside(F.col("accepted_answers"), union)),
        "chain_id": F.coalesce(has("R5"), F.lit(False)) & _blank(F.col("chain_id")),
        "constituents": F.coalesce(has("R5"), F.lit(False)) & (_repeats(parts) | F.coalesce(F.array_contains(parts, F.col("example_id")), F.lit(False)) | ~F.coalesce(F.size(parts) == raw("R5"), F.lit(False))),
        "domain_name": F.coalesce(has("R6"), F.lit(False)) & _blank(F.col("domain_name")),
    }
    return _collect(t, checks).drop("_d")


def _score_checks() -> dict[str, Column]:
    s, kind = F.col("score"), F.col("score_kind")
    return {
        "score": s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")),
        "score_kind": ~kind.isin(SCORE_KINDS),
        "probability_range": F.coalesce(kind == "probability", F.lit(False)) & ~F.coalesce((s >= 0) & (s <= 1), F.lit(False)),
        "calibrator_id": F.coalesce(kind == "probability", F.lit(False)) & _blank(F.col("calibrator_id")),
    }


def generation_violations(df: DataFrame) -> DataFrame:
    """Adds ``violations`` to generation records."""
    ids = {c: _blank(F.col(c)) for c in ("generation_id", "run_id", "example_id", "model_snapshot_id", "score_source")}
    return _collect(df, ids | {"condition_hash": ~_hash(F.col("condition_hash")), "track": ~F.col("track").isin(TRACKS)} | _score_checks())


def result_violations(df: DataFrame) -> DataFrame:
    """Adds ``violations`` to read results: the generation rules, the frozen level of the threshold and what each action requires."""
    answer = F.coalesce(F.col("action") == "answer", F.lit(False))
    raw = F.coalesce(F.col("score_kind") == "raw", F.lit(False))
    checks = _score_checks() | {
        "policy_level": ~F.coalesce(F.col("policy_level") == r7_level(F.col("threshold")), F.lit(False)),
        "normalization_contract": raw & _blank(F.col("normalization_contract")),
        "raw_range": raw & ~F.coalesce((F.col("score") >= 0) & (F.col("score") <= 1), F.lit(False)),
        "allowed_actions": _actions(F.col("allowed_actions")),
        "action": ~F.coalesce(F.array_contains(F.col("allowed_actions"), F.col("action")), F.lit(False)),
        "answer": answer & (_blank(F.col("answer")) | ~F.coalesce(F.array_contains(F.col("candidates"), F.col("answer")), F.lit(False))),
        "answer_ambiguity": answer & ~F.coalesce(F.col("ambiguity_complete"), F.lit(False)),
        "set": F.coalesce(F.col("action") == "set", F.lit(False)) & _none(F.col("candidates")),
        "correctness_rule": _blank(F.col("correctness_rule")),
    }
    return _collect(df, checks)


def condition_violations(df: DataFrame) -> DataFrame:
    """Adds ``violations`` to model condition records: levels that do not follow from cut points, dates and raw values."""
    from lucidra.functions.dimensions import months_after, r3_level

    dim = lambda k, f: F.expr(f"try_element_at(dimensions, '{k}').{f}")
    freq, months = dim("R1", "raw").cast("double"), dim("R3", "raw").cast("double")
    tail, middle = F.col("r1_tail_max"), F.col("r1_middle_max")
    r1 = F.when(freq < 0, None).when(freq <= tail, "tail").when(freq <= middle, "middle").otherwise("head")
    days = months_after(F.to_date("r3_event_date"), F.to_date("r3_model_cutoff_date"))
    checks = {
        "example_id": _blank(F.col("example_id")),
        "model_snapshot_id": _blank(F.col("model_snapshot_id")),
        "cut_points": ~(tail < middle),
        "r1_level": ~F.coalesce(r1 == dim("R1", "level"), F.lit(False)),
        "r3_months": F.abs(days - months) > 1e-6,
        "r3_level": ~F.coalesce(r3_level(months) == dim("R3", "level"), F.lit(False)),
    }
    return _collect(df, checks)


def violation_counts(checked: DataFrame) -> DataFrame:
    """``violation, n`` over all rows."""
    return checked.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def require_sound(checked: DataFrame) -> DataFrame:
    """The rows without ``violations`` column, or an error naming the broken rules."""
    bad = {r.violation: r.n for r in violation_counts(checked).collect()}
    if bad:
        raise ValueError(f"records break their invariants: {bad}")
    return checked.drop("violations")


def linkage(results: DataFrame, generations: DataFrame, workloads: DataFrame) -> DataFrame:
    """``row_id, problem``: read results whose generation or workload is missing or disagrees with them on a shared field.

    Generations and workloads must be unique by their ids; see ``lineage.duplicate_keys``.
    """
    shared = ["run_id", "example_id", "model_snapshot_id", "condition_hash", "track", "score", "score_kind", "score_source", "calibrator_id", "normalization_contract"]
    g = generations.select("generation_id", *[F.col(c).alias(f"_g_{c}") for c in shared], F.lit(True).alias("_has_g"))
    w = workloads.select("example_id", F.col("track").alias("_w_track"), F.lit(True).alias("_has_w"))
    j = results.select("row_id", "generation_id", *shared).join(g, "generation_id", "left").join(w, "example_id", "left")
    problems = [F.when(F.col("_has_g").isNull(), "generation missing"), F.when(F.col("_has_w").isNull(), "workload missing")]
    problems += [F.when(F.col("_has_g") & ~F.col(c).eqNullSafe(F.col(f"_g_{c}")), f"generation: {c}") for c in shared]
    problems.append(F.when(F.col("_has_w") & ~F.col("track").eqNullSafe(F.col("_w_track")), "workload: track"))
    return j.select("row_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def ambiguity_complete(workload_interpretations: Column, candidates: Column) -> Column:
    """Whether the candidates cover every answer of every interpretation."""
    union = F.flatten(F.map_values(workload_interpretations))
    return F.coalesce(F.size(F.array_except(union, candidates)) == 0, F.lit(False))


def guarantee_status(track: Column, supported: Column, assumptions_hold: Column, scope: Column) -> Column:
    """What a certificate may claim: nothing for open-ended tracks, unsupported calibration or broken assumptions."""
    return (
        F.when(track == "open_ended_stress", "none_open_ended_generated_candidates")
        .when(~F.coalesce(supported, F.lit(False)), "none_unsupported_calibration")
        .when(~F.coalesce(assumptions_hold, F.lit(False)), "none_assumptions_not_satisfied")
        .when(scope.isNull(), "none_not_claimed")
        .when(scope == "marginal", "finite_label_marginal_under_recorded_assumptions")
        .otherwise("finite_label_group_marginal_under_recorded_assumptions")
    )
