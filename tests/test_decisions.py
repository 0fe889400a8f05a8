"""Conformal sets, the read policy, isotonic calibration, composition and resampling."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lucidra.operators import composition as comp
from lucidra.operators import conformal, isotonic, policy, resample


def test_conformal_rank(spark):
    t = lambda xs, a: conformal.thresholds(spark.createDataFrame([(x,) for x in xs], "s double"), "s", a).first()
    assert t([0.4, 0.1, 0.3, 0.2], 0.5).threshold == 0.3
    assert t([0.1, 0.2], 0.1).threshold == math.inf
    assert t([i / 10 for i in range(9)], 0.7).k == math.ceil(10 * (1.0 - 0.7))


def test_sets_by_group_and_unseen_group(spark):
    fit = spark.createDataFrame([("head", 0.25), ("tail", 0.75)], "g string, threshold double")
    df = spark.createDataFrame([([0.8, 0.2], "head", 0), ([0.3, 0.7], "tail", 1)], "p array<double>, g string, y int")
    got = conformal.apply_sets(df, "p", fit, ["g"])
    assert {r.g: r.prediction_set for r in got.collect()} == {"head": [0], "tail": [0, 1]}
    assert conformal.coverage(got, "prediction_set", "y").first().coverage == 1.0
    with pytest.raises(KeyError):
        conformal.apply_sets(df.withColumn("g", F.lit("new")), "p", fit, ["g"])
    full = conformal.apply_sets(df, "p", spark.createDataFrame([(math.inf,)], "threshold double"))
    assert all(r.prediction_set == [0, 1] for r in full.collect())


def test_probability_rows(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.5, 0.4],), ([1.2, -0.2],), (None,), ([],), ([1.0],)], "p array<double>")
    assert conformal.probability_violations(df.where(F.col("p").isNull() | (F.size("p") != 0)), "p").count() >= 3


def decide(spark, score, cands, complete, allowed=("answer", "set", "abstain"), supported=True):
    df = spark.createDataFrame([(score, list(cands) if cands is not None else None, complete, list(allowed), supported)], "s double, c array<string>, a boolean, w array<string>, u boolean")
    d = df.select(policy.read_policy(F.col("s"), F.lit(0.5), F.col("c"), F.col("u"), F.col("a"), F.col("w")).alias("d")).first().d
    return d.action, d.reason, d.answer, d.candidates


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ((0.9, ["x"], True, ("answer", "abstain"), False), ("abstain", "unsupported_calibration_group", None, [])),
        ((0.4, ["x"], True), ("abstain", "below_threshold", None, [])),
        ((None, ["x"], True), ("abstain", "below_threshold", None, [])),
        ((0.9, [], True), ("abstain", "empty_candidate_set", None, [])),
        ((0.9, None, True), ("abstain", "empty_candidate_set", None, [])),
        ((0.9, ["x", "y", "x"], True), ("set", "non_singleton_prediction_set", None, ["x", "y"])),
        ((0.9, ["x", "y"], False), ("set", "ambiguity_incomplete_candidate_set", None, ["x", "y"])),
        ((0.9, ["x", "y"], True, ("answer", "abstain")), ("abstain", "non_singleton_set_not_allowed", None, [])),
        ((0.9, ["x"], False), ("abstain", "ambiguity_incomplete_singleton", None, [])),
        ((0.5, ["x"], True), ("answer", "threshold_accepted", "x", ["x"])),
        ((0.9, ["x"], True, ("set", "abstain")), ("set", "singleton_answer_not_allowed", None, ["x"])),
        ((0.9, ["x"], True, ("abstain",)), ("abstain", "no_permitted_commit_action", None, [])),
    ],
)
def test_policy_order(spark, args, want):
    assert decide(spark, *args) == want


def test_wrappers_never_commit_a_singleton(spark):
    row = spark.range(1).select(policy.selective_read(F.lit("x"), F.lit(0.9), F.lit(0.5), F.lit(True)).alias("s"), policy.prediction_set_read(F.array(F.lit("x")), F.lit(True)).alias("p")).first()
    assert row.s.reason == row.p.reason == "ambiguity_incomplete_singleton"


def test_policy_preconditions(spark):
    df = spark.createDataFrame([(0.5, "raw", None, None), (1.5, "probability", " ", None), (0.5, "odd", "c", "n")], "s double, k string, c string, n string")
    got = df.select(policy.policy_violations(F.col("s"), F.lit(0.5), F.col("k"), F.col("c"), F.col("n")).alias("v")).collect()
    assert [r.v for r in got] == [["normalization_contract"], ["score", "calibrator_id"], ["score_kind"]]


def pava(rows):
    out = []
    for s, y, w in sorted(rows):
        if out and out[-1][0] == s:
            out[-1][1] += y * w
            out[-1][2] += w
        else:
            out.append([s, y * w, w])
    k = len(out)
    mean = lambda a, b: sum(o[1] for o in out[a : b + 1]) / sum(o[2] for o in out[a : b + 1])
    return {out[i][0]: max(min(mean(s, t) for t in range(i, k)) for s in range(i + 1)) for i in range(k)}


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_against_closed_form(spark, seed):
    rng = random.Random(seed)
    rows = [(g, rng.randrange(60) / 60, rng.randrange(2), rng.choice([0.5, 1.0, 2.0])) for g in "ab" for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, s double, y int, w double").repartition(5)
    fit = isotonic.fit(df, "s", "y", "w", ["g"])
    assert isotonic.fit_violations(fit, ["g"]).isEmpty()
    got = {(r.g, r.s): r.calibrated for r in isotonic.apply(df, "s", fit, ["g"]).collect()}
    for g in "ab":
        for s, v in pava([(s, y, w) for k, s, y, w in rows if k == g]).items():
            assert got[g, s] == pytest.approx(v)


def test_isotonic_golden_and_clipping(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "s double, y int")
    fit = isotonic.fit(df, "s", "y")
    assert [r.value for r in fit.orderBy("block").collect()] == [0.0, 0.5, 1.0]
    probe = spark.createDataFrame([(0.0,), (0.25,), (0.35,), (0.9,), (None,)], "s double")
    assert [r.calibrated for r in isotonic.apply(probe, "s", fit).collect()] == pytest.approx([0.0, 0.5, 0.75, 1.0, None])
    assert isotonic.apply(probe.withColumn("g", F.lit("z")), "s", fit.withColumn("g", F.lit("a")), ["g"]).where("calibrated is not null").isEmpty()


def test_level_weights(spark):
    df = spark.createDataFrame([("one_hop", 0)] * 5 + [("two_hop", 1)], "l string, y int")
    w = isotonic.level_balanced_weights(df, "l")
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(6.0)
    assert w.agg(F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).first()[0] == pytest.approx(0.5)


def test_composition(spark):
    df = spark.createDataFrame([([1, 1], [0.9, 0.8], 1), ([1, 1], [0.5, 0.5], 0), ([1, 0], [1.0, 1.0], 0)], "a array<int>, c array<double>, y int")
    three = spark.createDataFrame([([1, 1], 1), ([1, 1], 0), ([1, 0], 0)], "a array<int>, y int")
    r = comp.composition_report(three, "a", "y").first()
    assert (r.chain_accuracy, r.all_atoms_correct, r.accuracy_given_atoms, r.synthesis_loss) == pytest.approx((1 / 3, 2 / 3, 0.5, 0.5))
    r = comp.composition_report(df.limit(2), "a", "y", "c").first()
    assert (r.mean_product, r.product_gap, r.mean_union_bound) == pytest.approx((0.485, -0.015, 0.35))
    r = comp.composition_report(spark.createDataFrame([([0], 1)], "a array<int>, y int"), "a", "y").first()
    assert r.accuracy_given_atoms is None and r.synthesis_loss is None


def test_chain_atoms_keep_their_order(spark):
    chains = spark.createDataFrame([("c1", ["b", "a"]), ("c2", ["a", "zz"]), ("c3", [])], "chain string, atoms array<string>")
    scored = spark.createDataFrame([("a", 1), ("b", 0)], "key string, y int")
    assert [(r.chain, r.y) for r in comp.chain_atoms(chains, "chain", "atoms", scored, "key", ["y"]).collect()] == [("c1", [0, 1])]
    assert [(r.chain, r.pos, r.key) for r in comp.missing_atoms(chains, "chain", "atoms", scored, "key").collect()] == [("c2", 1, "zz")]


def test_agreement(spark):
    df = spark.createDataFrame([("q", x) for x in ["a", "a", "b", "invalid"]] + [("r", "a")], "k string, v string")
    got = {r.k: r for r in comp.agreement(df, "k", "v", ["a", "b"]).collect()}
    assert (got["q"].n, got["q"].valid_rate, got["q"].classes, got["q"].idempotency) == (4, 0.75, 3, pytest.approx(1 / 6))
    assert got["r"].idempotency is None


def test_preferred_variant(spark):
    df = spark.createDataFrame([("k", "bb"), ("k", "a"), ("k", "bb"), ("k", "a"), ("k", "ccc")], "k string, v string")
    assert comp.preferred(df, "k", "v").first().preferred == "a"


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double")
    assert [r.adjusted for r in resample.holm(df, "k", "p").orderBy("k").collect()] == pytest.approx([0.03, 0.06, 0.06])
    assert resample.holm(df.limit(0), "k", "p").isEmpty()


def test_bootstraps(spark):
    df = spark.createDataFrame([(i % 5, 2.5, 0.5, 1) for i in range(20)], "c int, v double, s double, y int")
    r = resample.cluster_bootstrap(df, "c", F.col("v"), replicates=30).first()
    assert (r.estimate, r.lower, r.upper) == (2.5, 2.5, 2.5)
    same = resample.paired_aurc(df, "c", "s", "s", "y", replicates=10).first()
    assert (same.difference, same.lower, same.upper) == (0.0, 0.0, 0.0)
    noisy = df.withColumn("v", F.rand(1))
    noisy = spark.createDataFrame(noisy.collect(), noisy.schema)
    a = resample.cluster_bootstrap(noisy, "c", F.col("v"), replicates=30).first()
    b = resample.cluster_bootstrap(noisy.repartition(7), "c", F.col("v"), replicates=30).first()
    assert a.lower == pytest.approx(b.lower) and a.upper == pytest.approx(b.upper) and a.lower <= a.estimate <= a.upper
    assert resample.cluster_bootstrap(df.limit(0), "c", F.col("v")).isEmpty() or resample.cluster_bootstrap(df.limit(0), "c", F.col("v")).first().estimate is None
    m = {r.metric: r for r in resample.ratio_bootstrap(noisy, "c", {"x": (F.col("v"), F.lit(1)), "none": (F.col("v"), F.lit(0))}, replicates=10).collect()}
    assert m["x"].lower <= m["x"].estimate <= m["x"].upper and m["none"].estimate is None


def test_transfer(spark):
    rows = [(True, 0.9, 1), (True, 0.1, 0), (False, 0.9, 0), (False, 0.1, 1)]
    df = spark.createDataFrame(rows, "s boolean, c double, y int")
    r = comp.domain_transfer(df, "c", "y", F.col("s")).first()
    assert r.ece_increase > 0 and r.brier_increase > 0
    g = comp.transfer_gain(df, "c", "c", "y", F.col("s")).first()
    assert g.cross_brier_gain == 0 and g.brier_advantage == 0
