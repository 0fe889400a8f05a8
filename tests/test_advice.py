"""Whole jobs of the registered queries, on small tables of their own."""

import hashlib
import inspect
import json
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lucidra.operators import resample
from lucidra.plans import domain_queries, metric_queries


def read_results(path, n, models=7):
    """Read results with ``n`` scores of three decimals, and their (track, score, correct, model)."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "open_ended_stress"]), round(rng.random(), 3), rng.random(), f"m{rng.randrange(models)}") for _ in range(n)]
    rows = [(t, c, r < c, m) for t, c, r, m in rows]
    same = ["example_id", "generation_id", "action", "score_kind", "answer"]
    t = {"row_id": list(range(n)), "track": [r[0] for r in rows], "score": [r[1] for r in rows], "correct": [r[2] for r in rows], "model_snapshot_id": [r[3] for r in rows]}
    t |= dict.fromkeys(same, ["x"] * n) | {"threshold": [0.5] * n, "candidates": [["x"]] * n}
    pq.write_table(pa.table(t), path / "read_result_record.parquet")
    return rows


def test_guarantees_need_every_assumption(spark, tmp_path):
    names = domain_queries.ASSUMPTIONS
    held = dict.fromkeys(names, True)
    base = {"evaluation_track": "finite_label_certified", "calibration_supported": True, "coverage_scope": "marginal"}
    status = [
        held, {k: "Yes" for k in names}, [{"name": k, "holds": True} for k in names], json.dumps(held), {k: {"value": 1} for k in names},
        held | {names[0]: False}, held | {names[1]: None}, {k: True for k in names[1:]}, held | {"other": "no"}, [], None, "n/a",
    ]
    payloads = [base | {"assumption_status": a} for a in status] + [base, base | {"coverage_scope": None, "assumption_status": held}, base | {"coverage_scope": None, "assumption_status": {}}]
    payloads += [base | {"calibration_supported": False, "assumption_status": {}}, base | {"evaluation_track": "open_ended_stress", "assumption_status": {}}]
    pq.write_table(pa.table({"row_id": list(range(len(payloads) + 1)), "payload": [*map(json.dumps, payloads), "{broken"]}), tmp_path / "read_certificate.parquet")
    got = {r.status: r.n for r in domain_queries.certificates(spark, str(tmp_path)).collect()}
    assert got == {
        "finite_label_marginal_under_recorded_assumptions": 5, "none_assumptions_not_satisfied": 9, "none_not_claimed": 1,
        "none_unsupported_calibration": 1, "none_open_ended_generated_candidates": 1,
    }


def test_isotonic_fits_the_scores_themselves(spark, tmp_path):
    rows = read_results(tmp_path, 900)
    sums = {}
    for track, c, y, _ in rows:
        n, k = sums.setdefault(track, {}).get(c, (0, 0))
        sums[track][c] = (n + 1, k + y)
    want = {}
    for track, by in sums.items():
        cs = sorted(by)
        cum = [(0, 0)]
        for c in cs:
            cum.append((cum[-1][0] + by[c][0], cum[-1][1] + by[c][1]))
        mean = lambda i, j: (cum[j + 1][1] - cum[i][1]) / (cum[j + 1][0] - cum[i][0])  # noqa: E731, B023
        low = [[0.0] * len(cs) for _ in cs]
        for i in range(len(cs)):
            worst = float("inf")
            for j in range(len(cs) - 1, i - 1, -1):
                worst = low[i][j] = min(worst, mean(i, j))
        for x, c in enumerate(cs):
            want[track, c] = max(low[i][x] for i in range(x + 1))
    got = {(r.track, r.s): r.v for r in metric_queries.isotonic_fit(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    for r in metric_queries.isotonic_apply(spark, str(tmp_path)).collect():
        mine = [(c, y, want[r.track, c]) for t, c, y, _ in rows if t == r.track]
        assert r.n == len(mine)
        assert r.before == pytest.approx(sum((c - y) ** 2 for c, y, _ in mine) / r.n, abs=1e-8)
        assert r.after == pytest.approx(sum((v - y) ** 2 for _, y, v in mine) / r.n, abs=1e-8)


def test_registered_intervals_have_2000_replicates(spark, tmp_path):
    rows = read_results(tmp_path, 400)
    sums = {}
    for _, _, y, m in rows:
        n, k = sums.get(m, (0, 0))
        sums[m] = (n + 1, k + y)
    parts = [sums[m] for m in sorted(sums)]
    draw = lambda rep, i: math.floor(int(hashlib.sha256(f"0:{rep}:{i}".encode()).hexdigest()[:16], 16) / 2.0**64 * len(parts))
    means = []
    for rep in range(2000):
        drawn = [parts[draw(rep, i)] for i in range(len(parts))]
        means.append(sum(k for _, k in drawn) / sum(n for n, _ in drawn))
    means.sort()
    at = lambda q: means[math.floor(q * 1999)] + (q * 1999 % 1) * (means[math.floor(q * 1999) + 1] - means[math.floor(q * 1999)])
    got = {r.metric: r for r in metric_queries.ratio_bootstrap(spark, str(tmp_path)).collect()}["accuracy"]
    assert (got.lower, got.upper) == (pytest.approx(at(0.025), abs=1e-8), pytest.approx(at(0.975), abs=1e-8))
    for f in (resample.cluster_bootstrap, resample.ratio_bootstrap, resample.two_sample_difference, resample.paired_aurc):
        assert inspect.signature(f).parameters["replicates"].default == 2000


def test_facts_compare_trimmed_and_in_any_case(spark, tmp_path):
    facts = ["fact-1", " FACT-1 ", "Unknown", " unknown ", "N/A", "n/a", "", " ", "other-7", "Other-7", "fact-9", None]
    questions = ["who?", "who?", "what?", "what?", "when?", "when?", "how?", "how?", "why?", "why?", "whom?", "whom?"]
    splits = ["development", " Test "] * 6
    rows = {"row_id": list(range(12)), "question": questions, "split": splits, "metadata": [json.dumps({"source_fact_id": f}) for f in facts]}
    pq.write_table(pa.table(rows), tmp_path / "example_record.parquet")
    assert [tuple(r) for r in domain_queries.exclude_crossing(spark, str(tmp_path)).collect()] == [(1, 4)]


def test_closure_starts_from_every_workload_with_constituents(spark, tmp_path):
    rows = {"example_id": ["a", "B ", "c", "d", None], "constituent_example_ids": [["x"], ["y", "z"], ["x", "y", "w"], [], ["v"]]}
    t = pa.table(rows, schema=pa.schema([("example_id", pa.string()), ("constituent_example_ids", pa.list_(pa.string()))]))
    pq.write_table(t, tmp_path / "workload_record.parquet")
    assert {tuple(r) for r in domain_queries.closure(spark, str(tmp_path)).collect()} == {(0, 3), (1, 4)}
