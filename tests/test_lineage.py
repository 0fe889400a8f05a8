"""Components, splits, leakage, closures, samples and record invariants."""

import random

import pytest
from pyspark.sql import functions as F

from lucidra.operators import lineage, records, select
from lucidra.operators.components import connected_components


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, t in pairs:
        parent[find(("r", r))] = find(("t", t))
    groups = {}
    for r, _ in pairs:
        groups.setdefault(find(("r", r)), set()).add(r)
    return {r: min(g) for g in groups.values() if len(g) > 1 for r in g}


@pytest.mark.parametrize("case", ["random", "chain", "star", "repeats"])
def test_components_against_union_find(spark, case):
    rng = random.Random(5)
    pairs = {
        "random": [(i, f"t{rng.randrange(150)}") for i in range(120) for _ in range(2)],
        "chain": [(i, f"t{i + d}") for i in range(90) for d in (0, 1)],
        "star": [(i, "hub") for i in range(200)] + [(500, "x")],
        "repeats": [(1, "a")] * 5 + [(2, "a")] * 3,
    }[case]
    df = spark.createDataFrame([*pairs, (None, "a"), (77, None)], "row long, token string").repartition(6)
    got = {r.row: r.component for r in connected_components(df, "row", "token").collect()}
    assert got == union_find(pairs)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "row long, token string"), "row", "token").isEmpty()


def test_splits_keep_components_together_and_do_not_leak(spark):
    rows = [(i, [f"e{i // 3}"], [f"f{i % 40}"] if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, e array<string>, f array<string>")
    tokens = lineage.lineage_tokens(df, "id", {"entity": "e", "fact": "f"})
    a = lineage.assign_splits(df, "id", tokens)
    assert a.groupBy("component").agg(F.countDistinct("split").alias("k")).where("k > 1").isEmpty() and a.count() == 60
    lineage.require_no_leakage(tokens, a.select("row", "split"))
    b = lineage.assign_splits(df.repartition(5), "id", tokens.repartition(3))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    with pytest.raises(ValueError, match="entity"):
        lineage.require_no_leakage(tokens, a.select("row", (F.col("row") % 2).cast("string").alias("split")))
    with pytest.raises(KeyError):
        lineage.assign_splits(df.unionByName(spark.createDataFrame([(99, None, [" "])], df.schema)), "id", tokens)


def test_lineage_rules(spark):
    df = spark.createDataFrame([("v", None), (None, {"entity": "audited"}), (None, None), ("v", {"entity": "x"}), (" ", {})], "e string, x map<string,string>")
    got = [r.violations for r in lineage.lineage_violations(df, {"entity": "e"}, "x").collect()]
    assert got == [[], [], ["entity: missing"], ["entity: value and exemption"], ["entity: missing"]]


def test_closure_and_difference(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    assert {(r.id, r.depth) for r in lineage.closure(spark.createDataFrame([("a",)], "id string"), edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    d = lineage.id_difference(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string"), "k")
    assert {tuple(r) for r in d.collect()} == {("a", "missing"), ("c", "unexpected")}


def test_exclusions_run_to_the_end(spark):
    rows = [("s1", "p1", "dev", "Q"), ("s2", "p2", "test", "Q"), ("s3", "p3", "test", "other"), ("s1", "p4", "dev", "R"), ("s1", "p5", "dev", "R")]
    got = lineage.exclude_crossing(spark.createDataFrame(rows, "step string, parent string, split string, question string"))
    assert {r.parent for r in got.collect()} == set()
    got = lineage.exclude_crossing(spark.createDataFrame(rows[:3], "step string, parent string, split string, question string"))
    assert {(r.parent, r["round"]) for r in got.collect()} == {("p1", 1), ("p2", 1)}


def test_samples(spark):
    df = spark.createDataFrame([(f"k{i}", "abc"[i % 3] if i < 12 else "a") for i in range(30)], "k string, l string")
    top = select.top_per_level(df, ["l"], "k", 3, 7)
    assert top.groupBy("l").count().agg(F.max("count")).first()[0] == 3
    q = select.quota_sample(df, "l", "k", 20)
    assert q.count() == 20 and {r.l: r["count"] for r in q.groupBy("l").count().collect()} == {"a": 12, "b": 4, "c": 4}
    rr = select.round_robin_sample(df, "l", ["b", "c"], "k", 5).collect()
    assert [r.l for r in rr] == ["b", "c", "b", "c", "b"]
    units = spark.createDataFrame([("o", f"u{i}", ["one"] if i % 2 else ["one", "two"]) for i in range(20)], "o string, u string, ls array<string>")
    got = select.chain_units(units, "o", "u", "ls", 2, 1).collect()
    assert 2 <= len(got) <= 4


def test_tertiles(spark):
    t = lambda xs: select.tertiles(spark.createDataFrame([(float(x),) for x in xs], "v double"), "v")
    assert t([1, 2, 3, 4, 5, 6]) == (2.6666666666666665, 4.333333333333333)
    assert t([1, 50, 100]) == (33.666666666666664, 66.66666666666667)
    with pytest.raises(ValueError):
        t([1, 2])
    with pytest.raises(ValueError):
        t([3, 3, 3, 3])


def test_record_rules(spark):
    schema = "row_id long, generation_id string, run_id string, example_id string, model_snapshot_id string, condition_hash string, track string, score double, score_kind string, score_source string, calibrator_id string, threshold double, policy_level string, action string, correctness_rule string, candidates array<string>, answer string, allowed_actions array<string>, ambiguity_complete boolean, normalization_contract string"
    good = (1, "g", "r", "e", "m", "a" * 64, "open_ended_stress", 0.9, "raw", "s", None, 0.5, "tau_0_50", "answer", "rule", ["x"], "x", ["answer", "abstain"], True, "unit")
    bad = (2, " ", "r", "e", "m", "zz", "odd", float("nan"), "probability", "s", None, 0.5, "tau_0_90", "set", None, [], None, ["answer"], None, None)
    df = spark.createDataFrame([good, bad], schema)
    r = {x.row_id: x.violations for x in records.result_violations(df).collect()}
    assert r[1] == [] and set(r[2]) == {"score", "probability_range", "calibrator_id", "policy_level", "allowed_actions", "action", "set", "correctness_rule"}
    g = {x.row_id: x.violations for x in records.generation_violations(df).collect()}
    assert g[1] == [] and {"generation_id", "condition_hash", "track"} <= set(g[2])
    with pytest.raises(ValueError, match="policy_level"):
        records.require_sound(records.result_violations(df))
    assert records.require_sound(records.result_violations(df.where("row_id = 1"))).count() == 1


def test_workload_rules(spark, data):
    w = records.workload_violations(spark.read.parquet(f"{data}/workload_record.parquet"))
    assert w.where("violations is null").isEmpty() and w.count() > 0
    assert records.workload_violations(spark.read.parquet(f"{data}/workload_record.parquet").limit(0)).isEmpty()


def test_guarantees(spark):
    df = spark.createDataFrame([("open_ended_stress", True, True, "marginal"), ("f", False, True, None), ("f", True, False, None), ("f", True, True, None), ("f", True, True, "group")], "t string, s boolean, a boolean, c string")
    got = [r[0] for r in df.select(records.guarantee_status(*[F.col(c) for c in "tsac"])).collect()]
    assert got == ["none_open_ended_generated_candidates", "none_unsupported_calibration", "none_assumptions_not_satisfied", "none_not_claimed", "finite_label_group_marginal_under_recorded_assumptions"]
