"""Atoms, panels, authored records, manifests and the demo."""

import json

import pytest
from pyspark.sql import functions as F

from lucidra.operators import atoms
from lucidra.plans import demo, manifest
from lucidra.sources import authoring


def chain(i, split, *steps):
    made = [{"position": k, "source_step_id": s, "question": q, "answer": a, "supporting_title": "T"} for k, (s, q, a) in enumerate(steps, 1)]
    return (f"c{i}", split, json.dumps({"question_decomposition": made}))


def test_atoms(spark):
    rows = [chain(1, "dev", ("s1", "Who?", "Ann"), ("s2", "When was #1 born?", "1900")), chain(2, "dev", ("s3", "x", "y"), ("s2", "When was Ann born?", "1900 ")), ("c3", "dev", None), ("c4", "dev", "{")]
    steps = atoms.occurrences(spark.createDataFrame(rows, "example_id string, split string, provenance string"))
    assert steps.count() == 4
    got = {r.step: r for r in atoms.atoms(steps).collect()}
    assert len(got) == 3 and got["s2"].question == "When was Ann born?" and got["s2"].occurrences == 2
    assert [(p.parent, p.position) for p in got["s2"].parents] == [("c1", 2), ("c2", 2)]
    crossing = atoms.occurrences(spark.createDataFrame([chain(1, "dev", ("s1", "q", "a")), chain(2, "test", ("s1", "q", "b"))], "example_id string, split string, provenance string"))
    assert {tuple(r) for r in atoms.conflicts(crossing).collect()} == {("s1", "split"), ("s1", "answer")}
    with pytest.raises(ValueError):
        atoms.atoms(crossing)
    bad = spark.createDataFrame([("c", "d", json.dumps({"question_decomposition": [{"position": 2, "source_step_id": "s", "question": "q", "answer": "a"}]}))], "example_id string, split string, provenance string")
    with pytest.raises(Exception, match="count from 1"):
        atoms.occurrences(bad).collect()


def test_frequency_panel(spark):
    rows = [(f"e{i}", ["development", "calibration", "test"][i % 3]) for i in range(45)]
    seeds = [(f"e{i}", float(i)) for i in range(42)] + [("e42", None), ("e43", -1.0)]
    panel, out, cuts = atoms.frequency_panel(spark.createDataFrame(rows, "example_id string, split string"), spark.createDataFrame(seeds, "example_id string, proxy double"))
    assert panel.count() == 42 and cuts[0] < cuts[1]
    assert {r.reason: r.n for r in out.collect()} == {"missing_seed": 1, "missing_proxy": 1, "negative_proxy": 1}
    with pytest.raises(ValueError):
        atoms.frequency_panel(spark.createDataFrame(rows[:9], "example_id string, split string"), spark.createDataFrame([(f"e{i}", 1.0) for i in range(9)], "example_id string, proxy double"))


def test_frequency_by_depth(spark):
    rows = [("tail", "one_hop", 0), ("head", "one_hop", 1), ("middle", "one_hop", 1), ("tail", "two_hop", 0), ("head", "two_hop", 1), ("head", "two_hop", 0)]
    cells, gaps = atoms.frequency_depth_report(spark.createDataFrame(rows, "r1 string, r5 string, correct int"), floor=2)
    assert {(r.r5, r.r1): r.supported for r in cells.collect()}["two_hop", "head"] is True
    g = gaps.first()
    assert (g.one_hop_gap, g.two_hop_gap, g.interaction) == (-1.0, -0.5, 0.5)
    chains = spark.createDataFrame([("x", "tail", ["a", "b"]), ("y", "tail", ["a", "zz"]), ("z", "head", ["a"])], "example_id string, r1 string, atoms array<string>")
    scored = spark.createDataFrame([("a", 1), ("b", 1), ("x", 0), ("y", 1), ("z", 1)], "example_id string, correct int")
    s = {r.r1: r for r in atoms.synthesis_by_level(chains, "atoms", scored).collect()}
    assert (s["tail"].n_chains, s["tail"].both_right, s["tail"].synthesis_loss, s["tail"].composed_accuracy) == (2, 1, 1.0, 0.0)
    values = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "atom string, proxy double")
    assert {r.example_id: r.proxy for r in atoms.least_of_atoms(chains, "atoms", values, "atom", "proxy").collect()} == {"x": 1.0, "y": None, "z": 3.0}


def record(i, **over):
    r = {
        "example_id": f"e{i}", "family_id": "f", "dimension": "R4", "question": "q", "accepted_answers": ["a"], "interpretation_answers": {"i1": ["a"]}, "adjudicated_level": "unambiguous", "adjudication_status": "accepted",
        "independent_labels": {"x": "unambiguous", "y": "unambiguous"}, "adjudicator_id": "z", "author_id": "w", "contributor_consent": True, "domain_name": "law", "template_id": "t", "expertise_prerequisite": "some training",
        "expertise_rationale": "because it needs it", "source_urls": ["https://x"], "source_licenses": ["CC0"],
    }
    return json.dumps(r | over)


def test_authored_records(spark, tmp_path):
    two = {"interpretation_answers": {"i1": ["a"], "i2": ["a"]}, "adjudicated_level": "two_way"}
    bad = {
        "dimension": {"dimension": "R1"}, "question": {"question": " "}, "interpretation_union": {"accepted_answers": ["b"]}, "adjudicated_level": {"adjudicated_level": "coarse"}, "level_against_interpretations": {"adjudicated_level": "two_way"},
        "independent_labels": {"independent_labels": {"x": "unambiguous"}}, "adjudicator_independence": {"adjudicator_id": "x"}, "contributor_consent": {"contributor_consent": False}, "urls_and_licenses": {"source_licenses": []},
        "source_urls": {"source_urls": ["ftp://x"]}, "numeric_tolerance": {"numeric_tolerance": -1.0}, "one_interpretation": {"dimension": "R2", "adjudicated_level": "fine", **{"interpretation_answers": two["interpretation_answers"]}},
    }
    lines = [record(1), record(2, **two), record(1)] + [record(10 + i, **o) for i, o in enumerate(bad.values())] + ["", "[1]", "{"]
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(lines) + "\n")
    valid, quarantine = authoring.load_authored(spark, str(p))
    assert {r.example_id for r in valid.collect()} == {"e1", "e2"}
    errors = [r.error for r in quarantine.collect()]
    assert sorted(errors) == sorted([*bad, "duplicate_example_id", "blank_line", "no_object", "no_object"])
    got = {r.gate: r.passed for r in authoring.gates(valid, quarantine).collect()}
    assert got["has_accepted_rows"] and got["r4_families_complete"] and not got["no_validation_errors"] and not got["r4_all_levels"] and not got["r6_domains_complete"]
    assert authoring.label_agreement(valid).first().unanimous == 1.0


def test_audit_gate(spark):
    make = lambda rows: spark.createDataFrame(rows, "example_id string, review_status string")
    assert authoring.audit_approved(make([("a", " Approved"), ("b", "approved")]))
    for rows in ([], [("a", "pending")], [("a", "approved"), ("a", "approved")], [("a", None)], [(" ", "approved")]):
        assert not authoring.audit_approved(make(rows))


def test_manifests(spark, tmp_path):
    good = {"run_id": "r", "policy_grid": [0.5, 0.9], "dimension_settings": {d: {"rule": "x"} for d in manifest.DIMENSIONS}}
    assert manifest.finalize(good)["content_hash"] == manifest.finalize(dict(reversed(good.items())))["content_hash"]
    assert manifest.placeholder_paths({"a": [1, {"b": "TBD"}], "c": None, "d": " "}) == ["a[1].b", "c", "d"]
    for bad in (good | {"run_id": "todo"}, good | {"policy_grid": [0.9, 0.5]}, good | {"dimension_settings": {}}):
        with pytest.raises(ValueError):
            manifest.finalize(bad)
    t = spark.createDataFrame([(f"e{i}", i / 7, None) for i in range(50)], "k string, x double, y string")
    h = manifest.condition_table_hash(t, ["k"])
    assert h == manifest.condition_table_hash(t.repartition(5).select("y", "x", "k"), ["k"]) != manifest.condition_table_hash(t.where("k <> 'e1'"), ["k"])
    with pytest.raises(ValueError):
        manifest.condition_table_hash(t.unionAll(t), ["k"])
    p = tmp_path / "c.toml"
    p.write_text('[run]\nrun_id = "r"\nsplit = "test"\nlevels = ["one_hop"]\n[model]\nmodel_snapshot_id = "m"\n[prompt]\nprompt = "{question}"\n[budget]\nmax_requests = 5\n')
    assert manifest.load_run_config(p).levels == ("one_hop",)
    p.write_text("[run]\nrun_idd = 1\n")
    with pytest.raises(ValueError):
        manifest.load_run_config(p)


def test_demo(spark):
    out = demo.demo(spark)
    assert sum(r.n for r in out["coverage"].collect()) == 120 and all(r.coverage > 0.6 for r in out["coverage"].collect())
    assert demo.synthetic(spark, "calibration", 240).count() == 240 and out["frontier"].where(F.col("coverage") > 1).isEmpty()
