"""Queries of the calibration, conformal, policy and isotonic operators over the read results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidra.functions.dimensions import nearest_r7
from lucidra.functions.numeric import clopper_pearson, wilson
from lucidra.operators import conformal, isotonic, metrics, policy, resample
from lucidra.session import load

EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
BY = ["track"]


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Read results with a usable score and a known outcome: ids, track, level, score_kind, conf, y."""
    r = load(spark, d, "read_result_record").select(
        "row_id",
        "example_id",
        "generation_id",
        "model_snapshot_id",
        "action",
        F.lower(F.regexp_replace("track", EDGE, "")).alias("track"),
        nearest_r7(F.col("threshold")).alias("level"),
        "score_kind",
        F.col("score").alias("conf"),
        F.col("correct").cast("int").alias("y"),
        "candidates",
        "answer",
    )
    return r.where("track is not null and level is not null and y is not null and conf is not null and not isnan(conf) and conf >= 0 and conf <= 1")


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles to a fixed number of places, since sums depend on the partitioning in the last bits."""
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) + 0.0 if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]).toDF(*df.columns)


LEVEL = "(SELECT l FROM (VALUES (0.5::DOUBLE,'tau_0_50'),(0.7::DOUBLE,'tau_0_70'),(0.9::DOUBLE,'tau_0_90'),(0.95::DOUBLE,'tau_0_95'),(0.99::DOUBLE,'tau_0_99')) t(v,l) ORDER BY abs(v-threshold), l LIMIT 1)"
SC = f"""sc AS (SELECT row_id, example_id, generation_id, model_snapshot_id, action, lower(regexp_replace(track, '{EDGE}', '', 'g')) track, {LEVEL} AS level,
  score_kind, score AS conf, correct::INT AS y, candidates, answer FROM read_result_record
  WHERE track IS NOT NULL AND threshold IS NOT NULL AND correct IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1)"""
BIN = "least(floor(conf*10), 9)"


def _bins(by: str) -> str:
    return f"bn AS (SELECT {by}, {BIN} b, count(*) n, avg(conf) c, avg(y) a FROM sc GROUP BY ALL)"


_ACE = """rk AS (SELECT track, conf, y, row_number() OVER (PARTITION BY track ORDER BY conf, y) - 1 r, count(*) OVER (PARTITION BY track) t FROM sc),
 ab AS (SELECT track, t, i, avg(conf) c, avg(y) a, count(*) n FROM rk, range(10) g(i) WHERE i < least(10, t) AND r >= (i * t) // least(10, t) AND r < ((i + 1) * t) // least(10, t) GROUP BY ALL)"""
_AUC = """ar AS (SELECT track, y, rank() OVER (PARTITION BY track ORDER BY conf) + (count(*) OVER (PARTITION BY track, conf) - 1) / 2.0 r FROM sc),
 au AS (SELECT track, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) v FROM ar GROUP BY track)"""
_CURVE = """cu AS (SELECT DISTINCT track, conf threshold, count(*) OVER w accepted, (count(*) OVER w) / (count(*) OVER (PARTITION BY track))::DOUBLE coverage,
  sum(1 - y) OVER w / (count(*) OVER w)::DOUBLE risk, (count(*) OVER (PARTITION BY track, conf)) / (count(*) OVER (PARTITION BY track))::DOUBLE width
  FROM sc WINDOW w AS (PARTITION BY track ORDER BY conf DESC RANGE UNBOUNDED PRECEDING))"""
GRID = "g(threshold) AS (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE))"
GRID_VALUES = [0.5, 0.7, 0.9, 0.95, 0.99]

_PROBS = """pr AS (SELECT vec_id, label, [w[1] / s, w[2] / s, w[3] / s] p, label % 3 y, vec_id % 2 part, label % 4 grp FROM (
  SELECT vec_id, label, w, (w[1] + w[2] + w[3])::DOUBLE s FROM (SELECT vec_id, label, [1 + (vec_id * 7) % 10, 1 + (vec_id * 8) % 10, 1 + (vec_id * 9) % 10] w FROM embeddings)))"""


def probs(spark: SparkSession, d: str) -> DataFrame:
    """Three class probabilities per embedding from its id: vec_id, p, y, part (0 calibration, 1 test), grp."""
    e = load(spark, d, "embeddings").select("vec_id", "label", F.array(*[(F.lit(1) + (F.col("vec_id") * (7 + i)) % 10) for i in range(3)]).alias("w"))
    s = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    return e.select("vec_id", F.transform("w", lambda x: x / s).alias("p"), (F.col("label") % 3).alias("y"), (F.col("vec_id") % 2).alias("part"), (F.col("label") % 4).alias("grp"))


def _calibration(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = probs(spark, d).withColumn("nc", conformal.nonconformity(F.col("p"), F.col("y")))
    return t.where("part = 0"), t.where("part = 1")


def conformal_sets(spark: SparkSession, d: str) -> DataFrame:
    cal, test = _calibration(spark, d)
    sets = conformal.apply_sets(test, "p", conformal.thresholds(cal, "nc", 0.3))
    return sets.select("vec_id", F.array_join(F.col("prediction_set").cast("array<string>"), ",").alias("labels"))


def mondrian_sets(spark: SparkSession, d: str) -> DataFrame:
    cal, test = _calibration(spark, d)
    sets = conformal.apply_sets(test, "p", conformal.thresholds(cal, "nc", 0.3, ["grp"]), ["grp"])
    return sets.select("vec_id", "grp", F.array_join(F.col("prediction_set").cast("array<string>"), ",").alias("labels"))


def coverage_by_group(spark: SparkSession, d: str) -> DataFrame:
    cal, test = _calibration(spark, d)
    sets = conformal.apply_sets(test, "p", conformal.thresholds(cal, "nc", 0.3, ["grp"]), ["grp"])
    return rounded(conformal.coverage(sets, "prediction_set", "y", ["grp"]))


def _nc(sql: str) -> str:
    return f"WITH {_PROBS}, cal AS (SELECT *, 1 - p[y + 1] nc FROM pr WHERE part = 0), {sql}"


_THR = "th AS (SELECT {g} n, k, coalesce(list_sort(l)[k::INT], 'inf'::DOUBLE) threshold FROM (SELECT {g} count(*) n, ceil((count(*) + 1) * 0.7::DOUBLE)::BIGINT k, list(nc) l FROM cal {by}))"
_SETS = "array_to_string(list_filter([0, 1, 2], lambda i: 1 - p[i + 1] <= threshold), ',') labels"


def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The policy recomputed for every read result with a usable score and threshold."""
    r = load(spark, d, "read_result_record").where("score is not null and not isnan(score) and score >= 0 and score <= 1 and threshold is not null")
    p = policy.read_policy(F.col("score"), F.col("threshold"), F.col("candidates"), F.lit(True), F.col("ambiguity_complete"), F.col("allowed_actions"))
    return r.select("row_id", p.alias("d")).select("row_id", "d.action", "d.reason", "d.answer", F.size("d.candidates").alias("returned"))


_POLICY = """SELECT row_id, split_part(d, '|', 1) AS action, split_part(d, '|', 2) AS reason, CASE WHEN d LIKE 'answer|%' THEN u[1] END AS answer,
  CASE WHEN d LIKE 'abstain|%' THEN 0 ELSE n END AS returned FROM (
  SELECT row_id, u, n, CASE WHEN score < threshold THEN 'abstain|below_threshold' WHEN n = 0 THEN 'abstain|empty_candidate_set'
   WHEN n > 1 THEN CASE WHEN NOT list_contains(a, 'set') THEN 'abstain|non_singleton_set_not_allowed' WHEN c THEN 'set|non_singleton_prediction_set' ELSE 'set|ambiguity_incomplete_candidate_set' END
   WHEN NOT c THEN 'abstain|ambiguity_incomplete_singleton' WHEN list_contains(a, 'answer') THEN 'answer|threshold_accepted'
   WHEN list_contains(a, 'set') THEN 'set|singleton_answer_not_allowed' ELSE 'abstain|no_permitted_commit_action' END d
  FROM (SELECT row_id, score, threshold, u, len(u) n, coalesce(allowed_actions, []) a, coalesce(ambiguity_complete, false) c FROM (
   SELECT *, [x FOR x, i IN coalesce(candidates, []) IF list_position(coalesce(candidates, []), x) = i] u FROM read_result_record
   WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 AND threshold IS NOT NULL)))"""


def r7_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Answer or abstain of every calibrated generation at every threshold, counted by reason."""
    g = load(spark, d, "generation_record").select(
        F.when(F.col("score_kind") == "probability", F.nanvl("score", F.lit(None).cast("double"))).alias("confidence"), F.try_element_at("candidates", F.lit(1)).alias("answer")
    )
    return policy.decide_r7(g, "answer", "confidence").groupBy("threshold", "policy_level", "action", "reason").agg(F.count(F.lit(1)).alias("n"))


_ISO = f"""WITH {SC}, h AS (SELECT track, conf s, count(*) n, sum(y) p FROM sc GROUP BY ALL),
 c AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY s) i, sum(n) OVER (PARTITION BY track ORDER BY s) cn, sum(p) OVER (PARTITION BY track ORDER BY s) cp FROM h),
 m AS (SELECT a.track, b.i, min((b.cp - a.cp + a.p) / (b.cn - a.cn + a.n)::DOUBLE) OVER (PARTITION BY a.track, a.i ORDER BY b.i DESC) v FROM c a JOIN c b ON a.track = b.track AND a.i <= b.i),
 iso AS (SELECT x.track, x.s, x.n, max(m.v) v FROM c x JOIN m ON m.track = x.track AND m.i = x.i GROUP BY ALL)"""


def isotonic_fit(spark: SparkSession, d: str) -> DataFrame:
    """The fitted value of each distinct score and track."""
    t = scored(spark, d).withColumn("s", F.col("conf"))
    fitted = isotonic.fit(t, "s", "y", by=BY)
    got = isotonic.apply(t.groupBy("track", "s").agg(F.count(F.lit(1)).alias("n")), "s", fitted, BY)
    return rounded(got.select("track", "s", "n", F.col("calibrated").alias("v")))


def isotonic_apply(spark: SparkSession, d: str) -> DataFrame:
    """Brier score before and after calibration, by track."""
    t = scored(spark, d)
    out = isotonic.apply(t, "conf", isotonic.fit(t, "conf", "y", by=BY), BY)
    err = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))
    return rounded(out.groupBy("track").agg(F.count(F.lit(1)).alias("n"), err("conf").alias("before"), err("calibrated").alias("after")))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    g = scored(spark, d).groupBy("track", "level").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("track", "level", "k", "n", wilson(F.col("k"), F.col("n")).alias("w")).select("track", "level", "k", "n", "w.lower", "w.upper"))


def exact_intervals(spark: SparkSession, d: str) -> DataFrame:
    g = scored(spark, d).groupBy("track", "level").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("track", "level", "k", "n", clopper_pearson(F.col("k"), F.col("n")).alias("w")).select("track", "level", "k", "n", "w.lower", "w.upper"))


def holm(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted p-values of the order priorities, from made-up p-values of their counts."""
    p = load(spark, d, "orders").groupBy("o_orderpriority").agg(((F.count(F.lit(1)) % 97) / F.lit(1000.0)).alias("p"))
    return rounded(resample.holm(p, "o_orderpriority", "p"))


def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Mean order price with its interval, nations of the customers drawn as clusters."""
    t = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_totalprice")
    return rounded(resample.cluster_bootstrap(t, "c_nationkey", F.col("o_totalprice")), 2)


def paired_aurc(spark: SparkSession, d: str) -> DataFrame:
    """The score against the score in tenths, models drawn as clusters."""
    t = scored(spark, d).withColumn("coarse", F.floor(F.col("conf") * 10) / 10.0)
    return rounded(resample.paired_aurc(t, "model_snapshot_id", "conf", "coarse", "y"))


def ratio_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, acceptance at 0.5 and accuracy of what is accepted, models drawn as clusters."""
    y, ok = F.col("y"), (F.col("conf") >= 0.5).cast("int")
    parts = {"accuracy": (y, F.lit(1)), "acceptance": (ok, F.lit(1)), "accepted_accuracy": (y * ok, ok)}
    return rounded(resample.ratio_bootstrap(scored(spark, d), "model_snapshot_id", parts))


def tail_minus_head(spark: SparkSession, d: str) -> DataFrame:
    """Difference of the accuracies of the two tracks, rows of each resampled by their model."""
    t = scored(spark, d)
    return rounded(resample.two_sample_difference(t, "model_snapshot_id", F.col("y"), F.col("track") == "open_ended_stress"))


QUERIES = {
    "pair_violations": lambda s, d: metrics.pair_violations(load(s, d, "read_result_record"), "score", "correct"),
    "brier_by_track": lambda s, d: rounded(metrics.score_histogram(scored(s, d), "conf", "y", BY).groupBy(*BY).agg(metrics.brier().alias("brier"), metrics.log_loss().alias("log_loss"))),
    "reliability_bins": lambda s, d: rounded(metrics.reliability_bins(scored(s, d), "conf", "y", BY)),
    "ece": lambda s, d: rounded(metrics.ece(scored(s, d), "conf", "y", ["track", "level"])),
    "ace": lambda s, d: rounded(metrics.ace(scored(s, d), "conf", "y", BY)),
    "auroc_by_track": lambda s, d: rounded(metrics.auroc(scored(s, d), "conf", "y", BY)),
    "risk_coverage": lambda s, d: rounded(metrics.risk_coverage(scored(s, d), "conf", "y", BY).drop("width")),
    "aurc": lambda s, d: rounded(metrics.aurc(scored(s, d), "conf", "y", BY)),
    "selective_grid": lambda s, d: rounded(metrics.selective(scored(s, d), "conf", "y", GRID_VALUES, BY)),
    "group_report": lambda s, d: rounded(metrics.group_report(scored(s, d), "conf", "y", BY)),
    "interaction_report": lambda s, d: rounded(metrics.grouping_sets(scored(s, d), "conf", "y", [[], ["track"], ["level"], ["track", "level"]])),
    "policy_interaction": lambda s, d: rounded(metrics.selective(scored(s, d), "conf", "y", GRID_VALUES, ["track", "score_kind"])),
    "action_counts": lambda s, d: policy.action_counts(scored(s, d), ["track", "level"]),
    "oracle_recall": lambda s, d: rounded(metrics.oracle_recall(scored(s, d), "candidates", "answer", BY)),
    "set_efficiency": lambda s, d: rounded(metrics.set_efficiency(scored(s, d), "candidates", BY)),
    "level_floors": lambda s, d: metrics.level_floors(scored(s, d), {"track": ["finite_label_certified", "open_ended_stress", "unseen"], "level": policy.LEVELS}, 100),
    "conformal_threshold": lambda s, d: rounded(conformal.thresholds(_calibration(s, d)[0], "nc", 0.3, ["grp"])),
    "conformal_sets": conformal_sets,
    "mondrian_sets": mondrian_sets,
    "coverage_by_group": coverage_by_group,
    "read_policy": policy_decisions,
    "r7_decisions": r7_decisions,
    "level_weights": lambda s, d: rounded(isotonic.level_balanced_weights(scored(s, d), "level", by=BY).groupBy("track", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight"))),
    "isotonic": isotonic_fit,
    "isotonic_apply": isotonic_apply,
    "wilson": intervals,
    "clopper_pearson": exact_intervals,
    "holm": holm,
    "cluster_bootstrap": cluster_bootstrap,
    "paired_aurc": paired_aurc,
    "ratio_bootstrap": ratio_bootstrap,
    "two_sample_difference": tail_minus_head,
}

_SEL = "count(*) AS total, count(*) FILTER (conf >= threshold) AS accepted, round(avg((conf >= threshold)::INT), 9) AS coverage, round(1 - avg(y) FILTER (conf >= threshold), 9) AS risk, round(avg(y) FILTER (conf >= threshold), 9) AS accuracy"
_LL = "round(avg(-(y * ln(least(greatest(conf, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(conf, 1e-15), 1 - 1e-15)))), 9)"
ORACLES = {
    "pair_violations": "SELECT count(*) AS rows, count(*) FILTER (score IS NULL OR isnan(score) OR score < 0 OR score > 1) AS bad_confidence, count(*) FILTER (correct IS NULL) AS bad_outcome FROM read_result_record",
    "brier_by_track": f"WITH {SC} SELECT track, round(avg((conf - y) ** 2), 9) AS brier, {_LL} AS log_loss FROM sc GROUP BY track",
    "reliability_bins": f"WITH {SC}, {_bins('track')} SELECT track, b::INT AS bin, b / 10 AS lower, (b + 1) / 10 AS upper, n, round(c, 9) AS mean_confidence, round(a, 9) AS accuracy, round(abs(c - a), 9) AS gap FROM bn",
    "ece": f"WITH {SC}, {_bins('track, level')} SELECT track, level, round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM bn GROUP BY ALL",
    "ace": f"WITH {SC}, {_ACE} SELECT track, round(sum(n * abs(c - a)) / sum(n), 9) AS ace FROM ab GROUP BY track",
    "auroc_by_track": f"WITH {SC}, {_AUC} SELECT track, round(v, 9) AS auroc FROM au",
    "risk_coverage": f"WITH {SC}, {_CURVE} SELECT track, round(threshold, 9) AS threshold, accepted, round(coverage, 9) AS coverage, round(risk, 9) AS risk FROM cu",
    "aurc": f"WITH {SC}, {_CURVE} SELECT track, round(sum(width * risk), 9) AS aurc FROM cu GROUP BY track",
    "selective_grid": f"WITH {SC}, {GRID} SELECT track, threshold, {_SEL} FROM sc, g GROUP BY track, threshold",
    "group_report": f"""WITH {SC}, {_bins('track')}, {_ACE}, {_AUC}, {_CURVE},
 e AS (SELECT track, sum(n * abs(c - a)) / sum(n) v FROM bn GROUP BY track), a2 AS (SELECT track, sum(n * abs(c - a)) / sum(n) v FROM ab GROUP BY track), u AS (SELECT track, sum(width * risk) v FROM cu GROUP BY track)
 SELECT sc.track, count(*) AS n, round(avg(y), 9) AS accuracy, round(avg((conf - y) ** 2), 9) AS brier, {_LL} AS log_loss, round(any_value(e.v), 9) AS ece, round(any_value(a2.v), 9) AS ace,
  round(any_value(au.v), 9) AS auroc, round(any_value(u.v), 9) AS aurc FROM sc JOIN e USING (track) JOIN a2 USING (track) JOIN au USING (track) JOIN u USING (track) GROUP BY sc.track""",
    "interaction_report": f"""WITH {SC} SELECT CASE grouping(track, level) WHEN 3 THEN 'all' WHEN 1 THEN 'track' WHEN 2 THEN 'level' ELSE 'trackxlevel' END AS report,
 CASE grouping(track, level) WHEN 3 THEN 'all' WHEN 1 THEN 'track=' || track WHEN 2 THEN 'level=' || level ELSE 'track=' || track || '|level=' || level END AS cell,
 count(*) AS n, round(avg(y), 9) AS accuracy, round(avg((conf - y) ** 2), 9) AS brier FROM sc GROUP BY GROUPING SETS ((), (track), (level), (track, level))""",
    "policy_interaction": f"WITH {SC}, {GRID} SELECT track, score_kind, threshold, {_SEL} FROM sc, g GROUP BY ALL",
    "action_counts": f"WITH {SC} SELECT track, level, count(*) FILTER (action = 'answer') AS answer, count(*) FILTER (action = 'set') AS \"set\", count(*) FILTER (action = 'abstain') AS abstain FROM sc GROUP BY ALL",
    "oracle_recall": f"WITH {SC} SELECT track, count(*) AS n, round(avg(coalesce(list_contains(candidates, answer), false)::INT), 9) AS recall FROM sc GROUP BY track",
    "set_efficiency": f"""WITH {SC}, z AS (SELECT track, coalesce(len(list_distinct(candidates)), 0) s FROM sc)
 SELECT track, count(*) AS n, round(avg(s), 9) AS mean, median(s) AS median, quantile_disc(s, 0.9)::DOUBLE AS p90, round(avg((s = 1)::INT), 9) AS singleton, round(avg((s = 0)::INT), 9) AS empty FROM z GROUP BY track""",
    "level_floors": f"""WITH {SC} SELECT t AS track, l AS level, count(y) AS n FROM (VALUES ('finite_label_certified'), ('open_ended_stress'), ('unseen')) a(t),
 (VALUES ('tau_0_50'), ('tau_0_70'), ('tau_0_90'), ('tau_0_95'), ('tau_0_99')) b(l) LEFT JOIN sc ON track = t AND level = l GROUP BY ALL HAVING count(y) < 100""",
    "conformal_threshold": _nc(_THR.format(g="grp,", by="GROUP BY grp")) + " SELECT grp, n, k, round(threshold, 9) AS threshold FROM th",
    "conformal_sets": _nc(_THR.format(g="", by="")) + f" SELECT vec_id, {_SETS} FROM pr, th WHERE part = 1",
    "mondrian_sets": _nc(_THR.format(g="grp,", by="GROUP BY grp")) + f" SELECT vec_id, grp, {_SETS} FROM pr JOIN th USING (grp) WHERE part = 1",
    "coverage_by_group": _nc(_THR.format(g="grp,", by="GROUP BY grp")) + " SELECT grp, count(*) AS n, round(avg((1 - p[y + 1] <= threshold)::INT), 9) AS coverage FROM pr JOIN th USING (grp) WHERE part = 1 GROUP BY grp",
    "read_policy": _POLICY,
    "r7_decisions": f"""WITH {GRID}, q AS (SELECT CASE WHEN score_kind = 'probability' AND NOT isnan(score) THEN score END c, candidates[1] a FROM generation_record),
 w AS (SELECT threshold, CASE WHEN c IS NULL THEN 'unsupported_calibration_group' WHEN coalesce(trim(a), '') = '' THEN 'empty_answer' WHEN regexp_matches(lower(a), '^[^a-z0-9]*abstain[^a-z0-9]*$') THEN 'model_abstained'
  WHEN c < threshold THEN 'below_threshold' ELSE 'threshold_accepted' END reason FROM q, g)
 SELECT threshold, {LEVEL} AS policy_level, CASE reason WHEN 'threshold_accepted' THEN 'answer' ELSE 'abstain' END AS action, reason, count(*) AS n FROM w GROUP BY ALL""",
    "level_weights": f"WITH {SC}, k AS (SELECT track, level, count(*) n FROM sc GROUP BY ALL) SELECT track, level, n, round(sum(n) OVER (PARTITION BY track) / (count(*) OVER (PARTITION BY track) * n)::DOUBLE, 9) AS weight FROM k",
    "isotonic": _ISO + " SELECT track, round(s, 9) AS s, n, round(v, 9) AS v FROM iso",
    "isotonic_apply": _ISO
    + " SELECT sc.track, count(*) AS n, round(avg((s - y) ** 2), 9) AS before, round(avg((v - y) ** 2), 9) AS after FROM sc JOIN iso ON iso.track = sc.track AND iso.s = conf GROUP BY sc.track",
    "wilson": f"""WITH {SC}, k AS (SELECT track, level, sum(y) k, count(*) n, 1.959963984540054::DOUBLE z FROM sc GROUP BY ALL), c AS (SELECT *, k / n::DOUBLE p FROM k)
 SELECT track, level, k::BIGINT AS k, n, round(greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) AS lower, round(least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) AS upper FROM c""",
    "holm": """WITH p AS (SELECT o_orderpriority, (count(*) % 97) / 1000.0::DOUBLE p FROM orders GROUP BY ALL), r AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, o_orderpriority) + 1) * p) s FROM p)
 SELECT o_orderpriority, round(p, 9) AS p, round(max(s) OVER (ORDER BY p, o_orderpriority ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM r""",
    "cluster_bootstrap": """WITH a AS (SELECT c_nationkey, sum(o_totalprice) s, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey), c AS (SELECT *, row_number() OVER (ORDER BY c_nationkey) - 1 i, count(*) OVER () k FROM a),
 d AS (SELECT rep, floor((('0x' || substr(sha256('0:' || rep || ':' || i), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0 * k)::BIGINT j FROM c, range(2000) r(rep)),
 e AS (SELECT rep, sum(s) / sum(n) v FROM d JOIN c ON c.i = d.j GROUP BY rep), l AS (SELECT list_sort(list(v)) s FROM e)
 SELECT (SELECT round(sum(s) / sum(n), 2) FROM c) AS estimate, round(s[51], 2) AS lower, round(s[1950], 2) AS upper FROM l""",
}
