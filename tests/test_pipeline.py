"""Sources, adapters, the run pipeline, evaluation reports and the streaming log."""

import gzip
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lucidra.operators.evaluate import evaluate, identity_of, outcome
from lucidra.plans import pipeline as run
from lucidra.sources import adapters, io
from lucidra.streaming import log


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    io.write_json_lines([{"b": 1, "a": "ü"}, {"x": [1]}], p)
    assert p.read_text() == '{"a": "ü", "b": 1}\n{"x": [1]}\n'
    assert io.read_json_lines(spark, str(p)).count() == 2
    with pytest.raises(TypeError):
        io.write_json_lines([{"a": 1}, 3], p)
    assert p.read_text().startswith('{"a": "ü"')
    for bad in ("\n", "[1]\n", "{\n"):
        q = tmp_path / "bad.jsonl"
        q.write_text('{"a": 1}\n' + bad)
        with pytest.raises(Exception, match="no JSON object"):
            io.read_json_lines(spark, str(q)).collect()
    io.write_single_json_lines(spark.range(3), tmp_path / "r.jsonl")
    assert io.read_json_records(spark, str(tmp_path / "r.jsonl"), "id long").agg(F.sum("id")).first()[0] == 3


def test_frozen_artifacts_and_fingerprints(spark, tmp_path):
    p = tmp_path / "m.json"
    io.freeze_json(p, {"b": 1, "a": 2})
    io.freeze_json(p, {"a": 2, "b": 1})
    with pytest.raises(FileExistsError):
        io.freeze_json(p, {"a": 3})
    io.freeze_csv(tmp_path / "t.csv", [{"a": 1, "b": "x,y"}], ["a", "b"])
    assert (tmp_path / "t.csv").read_text() == 'a,b\n1,"x,y"\n'
    f = io.fingerprints(spark, str(p)).first()
    assert f.sha256 == io.sha256_file(p) and f.bytes == p.stat().st_size
    with pytest.raises(ValueError):
        io.freeze_json(tmp_path / "n.json", {"a": math.nan})
    assert not (tmp_path / "n.json").exists()


def test_csv_strings(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('\ufeffa,b\n1,\n"x ""q"" \nnext",2\n', encoding="utf-8")
    rows = io.read_csv_strings(spark, str(p), required=["a"]).collect()
    assert [tuple(r) for r in rows] == [("1", ""), ('x "q" \nnext', "2")]
    with pytest.raises(KeyError):
        io.read_csv_strings(spark, str(p), required=["c"])


def test_registry_and_gate(tmp_path):
    r = tmp_path / "r.toml"
    data = tmp_path / "d.txt"
    data.write_text("abc")
    r.write_text(f'[[sources]]\nid = "s"\nkind = "manual"\nlicense = "CC0"\nmax_bytes = 10\nsha256 = "{io.sha256_file(data)}"\n')
    spec = io.load_registry(r)["s"]
    assert io.accept_source(spec, data, {"CC0"}) == data
    with pytest.raises(PermissionError):
        io.accept_source(spec, data, set())
    data.write_text("abcd")
    with pytest.raises(ValueError, match="digest"):
        io.accept_source(spec, data, {"CC0"})
    r.write_text('[[sources]]\nid = "s"\nkind = "x"\n')
    with pytest.raises(ValueError, match="license"):
        io.load_registry(r)


def test_lock(tmp_path):
    with io.run_lock(tmp_path), pytest.raises(BlockingIOError):
        with io.run_lock(tmp_path):
            pass
    with io.run_lock(tmp_path):
        pass


def counts(a):
    return {r.reason: r.n for r in a.exclusions.collect()}


def test_entity_questions(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text("id\tsubj\tprop\tobj\tsubj_id\tprop_id\tobj_id\ts_pop\tquestion\tpossible_answers\n1\tA\tborn\tB\tq1\tp1\tq2\t12.5\tWhere?\t[\"B\", \"b\", \"C\"]\n2\tA\tborn\t\tq1\tp1\tq2\tx\tWhere?\t\n")
    a = adapters.adapt_popqa(spark, str(p))
    e = a.examples.first()
    assert (e.example_id, e.accepted_answers, e.group_label) == ("popqa:1", ["B", "C"], "R2=medium|R4=unambiguous|R5=one_hop|R6=general")
    assert json.loads(e.metadata)["source_fact_id"] == ["popqa:fact:q1:p1:q2"]
    assert a.seeds.first().proxy == 12.5 and counts(a) == {"missing_question_or_answer": 1}
    assert a.workloads.first().dimensions["R5"].level == "one_hop"


def test_relation_chains(spark, tmp_path):
    p = tmp_path / "s.csv"
    head = ["uid", "e1.wikidata_qid", "e2.wikidata_qid", "e3.wikidata_qid", "e2.value", "e3.value", "e2.minimal_aliases", "r1(e1).prompt", "r2(e2).prompt", "r2(r1(e1)).prompt", "wimbd.dolma17(e1,e2)"]
    p.write_text(",".join(f'"{h}"' for h in head) + '\nu1,q1,q2,q3,X,Y,"[""XX""]",a?,b?,c?,7\nu2,q1,q2,q3,X,Y,,a?,b?,,\n', encoding="utf-8")
    a = adapters.adapt_socrates(spark, str(p))
    got = {r.example_id: r for r in a.workloads.collect()}
    assert {k: v.dimensions["R5"].raw for k, v in got.items()} == {"socrates:u1:r1": "1", "socrates:u1:r2": "1", "socrates:u1:composed": "2"}
    assert got["socrates:u1:composed"].constituent_example_ids == ["socrates:u1:r1", "socrates:u1:r2"] and got["socrates:u1:r1"].accepted_answers == ["X", "XX"]
    assert counts(a) == {"missing_question_or_answer": 1}


def test_dated_questions(spark, tmp_path):
    p = tmp_path / "q.jsonl.gz"
    with gzip.open(p, "wt") as f:
        f.write(json.dumps({"qa_id": "1", "question": "q?", "answers": ["a"], "evidence_ts": 1577836800, "question_ts": 1577836800}) + "\n{bad\n[1]\n" + json.dumps({"qa_id": "2", "question": "", "answers": ["a"]}) + "\n")
    a = adapters.adapt_streamingqa(spark, str(p))
    assert a.seeds.first().event_date == "2020-01-01" and a.examples.count() == 1
    assert counts(a) == {"malformed_json": 1, "non_object_row": 1, "missing_question_or_answer": 1}


def composed(i, hops, **over):
    steps = [{"id": f"{i}-{k}", "question": f"s{k}?", "answer": "a", "paragraph_support_idx": k} for k in range(hops)]
    paras = [{"idx": k, "title": f"T{k}", "paragraph_text": "x", "is_supporting": True} for k in range(hops)]
    return {"id": f"{hops}hop__{i}", "question": "q?", "answer": "A", "answer_aliases": ["a", "B"], "question_decomposition": steps, "paragraphs": paras} | over


def test_decomposed_questions(spark, tmp_path):
    p = tmp_path / "m.zip"
    bad = [
        composed(5, 2, question_decomposition=[]), composed(6, 2, id="x"), composed(7, 2, id=""), composed(1, 3), composed(8, 2, paragraphs=None),
        composed(9, 2, paragraphs=[{"idx": 0, "title": "", "is_supporting": True}]), composed(10, 2, question=""),
    ]
    twice = composed(11, 2)
    twice["question_decomposition"][1]["id"] = twice["question_decomposition"][0]["id"]
    with zipfile.ZipFile(p, "w") as z:
        z.writestr(adapters.ARCHIVE_MEMBERS["train"], "\n".join(json.dumps(x) for x in [composed(1, 3), composed(2, 4), *bad, twice]) + "\n{oops\n")
        z.writestr(adapters.ARCHIVE_MEMBERS["dev"], json.dumps(composed(1, 3)) + "\n")
        z.writestr(adapters.ARCHIVE_MEMBERS["test"], '{"id": "t"}\n')
    a = adapters.adapt_musique(spark, str(p))
    assert {r.dimensions["R5"].level for r in a.workloads.collect()} == {"three_hop", "four_plus_hop"}
    assert all(r.accepted_answers == ["A", "B"] for r in a.workloads.collect())
    assert counts(a) == {
        "unlabeled_official_test": 1, "decomposition_hop_mismatch": 1, "invalid_composition_id": 1, "missing_source_id": 1, "duplicate_source_id": 2, "invalid_paragraphs": 1,
        "invalid_decomposition_step": 1, "missing_question_or_answer": 1, "duplicate_decomposition_step": 1, "malformed_json": 1,
    }
    split = run.refine(a, {"chain": "array(get_json_object(metadata, '$.chain_id'))"})
    assert split.count() == 2 and set(split.columns) >= {"component", "split"}


@pytest.fixture(scope="module")
def examples(spark):
    rows = [(f"e{i}", "ab"[i % 2], ["one_hop", "two_hop"][i % 3 == 0], "calibration" if i < 60 else "test", f"question {i}?", [f"mock answer {i % 2}"]) for i in range(120)]
    return spark.createDataFrame(rows, "example_id string, dataset_id string, level string, split string, question string, accepted_answers array<string>")


def test_run_from_plan_to_decisions(spark, examples, tmp_path):
    fit = run.RunConfig("r1", "model", "Q: {question}", "calibration", seed=3)
    planned = run.plan(examples, fit)
    assert planned.count() == 60 and run.plan_cost(planned, fit).first().requests == 60
    provider = run.MockProvider()
    io.append_rows(run.generate(planned.limit(20), None, fit, provider), str(tmp_path / "log"))
    schema = "generation_id string, run_id string, example_id string, model_snapshot_id string, raw_text string, score double, score_kind string, score_source string"
    read = lambda: io.read_json_records(spark, str(tmp_path / "log"), schema)
    assert {r.problem for r in run.completeness(planned, read()).collect()} == {"missing"}
    io.append_rows(run.generate(planned, read(), fit, provider), str(tmp_path / "log"))
    assert run.completeness(planned, read()).isEmpty() and read().count() == 60
    scored = run.score(read(), examples)
    assert run.score_differences(scored, read(), examples).isEmpty()
    tampered = scored.withColumn("correct", F.when(F.col("example_id") == "e1", 1 - F.col("correct")).otherwise(F.col("correct")))
    assert [r.example_id for r in run.score_differences(tampered, read(), examples).collect()] == ["e1"]
    model = run.fit_calibrator(scored, fit, str(tmp_path / "cal.json"))
    assert run.fit_calibrator(scored.repartition(3), fit, str(tmp_path / "cal.json"))["calibrator_id"] == model["calibrator_id"]
    test = run.RunConfig("r2", "model", "Q: {question}", "test", seed=3)
    target = run.score(run.generate(run.plan(examples, test), None, test, provider), examples)
    out = run.calibrate(target, model, test)
    assert out.where("not calibration_supported").isEmpty() and out.where("confidence < 0 or confidence > 1").isEmpty()
    strange = run.calibrate(target.withColumn("dataset_id", F.lit("new")), model, test)
    assert strange.where("confidence is not null").isEmpty()
    d = run.decisions(out)
    assert d.count() == 300 and d.where("action = 'answer' and confidence < threshold").isEmpty()
    with pytest.raises(ValueError, match="differ"):
        run.calibrate(target, model, run.RunConfig("r3", "other", "Q: {question}", "test"))
    with pytest.raises(ValueError, match="calibration split"):
        run.fit_calibrator(target, test)
    assert run.run_report(scored).count() == 1 + 2 + 4


def test_plan_limits_and_settings(examples):
    c = run.RunConfig("r", "m", "{question}", "test", limit_per_level=5)
    assert run.plan(examples, c).count() == 20
    with pytest.raises(ValueError, match="budget"):
        run.plan(examples, run.RunConfig("r", "m", "{question}", "test", max_requests=3))
    for bad in ({"prompt": "no slot"}, {"run_id": " "}):
        with pytest.raises(ValueError):
            run.RunConfig(**({"run_id": "r", "model_snapshot_id": "m", "prompt": "{question}", "split": "test"} | bad))


def test_scoring_refuses_unknown_and_repeated_examples(spark, examples):
    log_ = spark.createDataFrame([("g", "r", "nobody", "x", 0.5)], "generation_id string, run_id string, example_id string, raw_text string, score double")
    with pytest.raises(KeyError):
        run.score(log_, examples)
    with pytest.raises(ValueError):
        run.score(log_, examples.unionAll(examples))


def test_certificates():
    result = {"example_id": "e", "run_id": "r", "generation_id": "g", "threshold": 0.5, "action": "answer", "answer": "x", "calibration_supported": True}
    work, manifest, ok = {"example_id": "e", "track": "finite_label_certified"}, {"run_id": "r", "policy_grid": [0.5]}, {"scoring_rule_fixed": True}
    c = run.certificate(result, work, manifest, ok, "marginal")
    assert c["guarantee_status"] == "finite_label_marginal_under_recorded_assumptions"
    run.validate_certificate(c, result, work, manifest)
    with pytest.raises(ValueError, match="content_hash"):
        run.validate_certificate(c | {"content_hash": "0"}, result, work, manifest)
    assert run.certificate(result, work, manifest, {"a": False}, "marginal")["guarantee_status"] == "none_assumptions_not_satisfied"
    for kw in (dict(result=result | {"threshold": 0.6}), dict(result=result | {"run_id": "q"}), dict(result=result | {"calibration_supported": False}), dict(work=work | {"track": "open_ended_stress"})):
        with pytest.raises(ValueError):
            run.certificate(kw.get("result", result), kw.get("work", work), manifest, ok, "marginal")


BASE = {"run_id": "r", "model_snapshot_id": "m", "evaluation_track": "t", "condition_table_hash": "c", "calibration_object_hash": "o", "condition_hash": "h", "score_kind": "probability", "score_source": "s", "calibrator_id": "k", "normalization_contract": ""}


def rows_of(spark, pairs_, **over):
    rows = [BASE | over | {"example_id": str(i), "confidence": str(c), "correct": y, "R4": "ab"[i % 2]} for i, (c, y) in enumerate(pairs_)]
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in rows[0]))


PAIRS = [(0.9, "1"), (0.8, "true"), (0.4, "No"), (0.2, "0")]


def test_report(spark):
    r = evaluate(rows_of(spark, PAIRS), ["R4"], [["R4", "R7"]], expected_levels={"R4": ["a", "b"]})
    assert r.overall.first().accuracy == 0.5 and r.overall.first().auroc == 1.0
    assert r.interactions["R4*R7"].count() == 10 and r.interactions["R4*R7"].agg(F.max("total")).first()[0] == 2
    assert {x.R4: x.n for x in r.groups["R4"].collect()} == {"a": 2, "b": 2} and r.frontier.count() == 5


def test_raw_scores_withhold_probability_metrics(spark):
    r = evaluate(rows_of(spark, [(7.5, "1"), (3, "1"), (-2, "0"), (0, "0")], score_kind="raw", calibrator_id=""), ["R4"])
    o = r.overall.first()
    assert (o.brier, o.log_loss, o.ece, o.ace) == (None,) * 4 and o.auroc == 1.0 and r.frontier is None
    with pytest.raises(ValueError, match="contract"):
        evaluate(rows_of(spark, PAIRS, score_kind="raw", calibrator_id=""), ["R7"])
    assert evaluate(rows_of(spark, PAIRS, score_kind="raw", calibrator_id="", normalization_contract="unit")).frontier is not None


def test_reports_fail_closed(spark):
    good = rows_of(spark, PAIRS)
    cases = [
        (good.withColumn("run_id", F.col("example_id")), {}, ValueError), (good.withColumn("calibrator_id", F.lit("")), {}, ValueError), (good, {"groups": ["R9"]}, KeyError),
        (good.withColumn("example_id", F.lit("1")), {}, ValueError), (good, {"expected_levels": {"R4": ["a", "b", "c"]}}, ValueError), (good, {"expected_levels": {"R4": ["a"]}, "least_level": 3}, ValueError),
        (good.withColumn("correct", F.lit("perhaps")), {}, ValueError), (good.withColumn("confidence", F.lit("nan")), {}, ValueError), (good.limit(0), {}, ValueError), (good.withColumn("R4", F.lit(" ")), {"groups": ["R4"]}, ValueError),
        (good, {"thresholds": [0.9, 0.5]}, ValueError),
    ]
    for df, kw, error in cases:
        with pytest.raises(error):
            evaluate(df, **kw)
    assert identity_of(good.select("example_id", "confidence", "correct"), legacy=True)["score_kind"] == "legacy_probability_assumption"
    assert [r[0] for r in spark.createDataFrame([("YES",), ("0",), ("maybe",), (None,)], "c string").select(outcome(F.col("c"))).collect()] == [1, 0, None, None]


def test_streamed_log(spark, tmp_path):
    rows = [{"generation_id": f"g{i % 4}", "run_id": "r", "example_id": f"e{i % 2}", "raw_text": "x", "candidates": ["The A!"], "score": 0.5, "created_at": f"2025-01-01T0{i}:00:00"} for i in range(6)]
    src = tmp_path / "in"
    src.mkdir()
    io.write_json_lines(rows, src / "a.jsonl")
    ex = spark.createDataFrame([("e0", ["a"]), ("e1", ["b"])], "example_id string, accepted_answers array<string>")
    stream = log.scored_stream(log.read_log(spark, str(src)), ex)
    log.write_scored(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    io.write_json_lines([rows[0] | {"generation_id": "g9"}], src / "b.jsonl")
    log.write_scored(log.scored_stream(log.read_log(spark, str(src)), ex), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.generation_id, r.correct) for r in out.collect()} == {("g0", True), ("g1", False), ("g2", True), ("g3", False), ("g9", True)} and out.count() == 5
    assert log.accuracy_windows(out).count() == 4


def test_sql_functions(spark):
    from lucidra.sql import register

    assert "normalize_answer" in register(spark)
    assert spark.sql("select normalize_answer('The MÜNCHEN!') a, exact_match('x', array('X')) b").first() == ("münchen", True)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from lucidra import cli

    monkeypatch.setattr(cli, "get_session", lambda: spark)
    assert cli.main(["list"]) == 0 and "group_report" in capsys.readouterr().out
    p = tmp_path / "e.csv"
    df = rows_of(spark, PAIRS)
    io.freeze_csv(p, [r.asDict() for r in df.collect()], df.columns)
    assert cli.main(["evaluate", str(p), "--group-column", "R4", "--interaction", "R4*R7"]) == 0
    assert json.loads(capsys.readouterr().out)["overall"][0]["n"] == 4
    assert cli.main(["evaluate", str(p), "--group-column", "R9"]) == 2
