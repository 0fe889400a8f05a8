"""Golden values and laws of the metric operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lucidra.operators import metrics as m


def pairs(spark, rows, schema="c double, y int"):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


def test_brier_and_bins(spark):
    df = pairs(spark, [(0.0, 0), (0.5, 1), (1.0, 1)])
    assert one(m.score_histogram(df, "c", "y", []).agg(m.brier().alias("b")))["b"] == pytest.approx(1 / 12)
    bins = m.reliability_bins(pairs(spark, [(0.0, 0), (0.499, 0), (0.5, 1), (1.0, 1)]), "c", "y", n_bins=2).orderBy("bin").collect()
    assert [(r.n, r.lower, r.upper) for r in bins] == [(2, 0.0, 0.5), (2, 0.5, 1.0)]
    assert one(m.ece(pairs(spark, [(0.2, 0), (0.8, 1)]), "c", "y", n_bins=2))["ece"] == pytest.approx(0.2)


def test_bin_edge_uses_double_arithmetic(spark):
    assert m.reliability_bins(pairs(spark, [(0.29, 1)]), "c", "y", n_bins=100).first().bin == 28


def test_selective_without_accepted_rows(spark):
    r = m.selective(pairs(spark, [(0.1, 0), (0.2, 1)]), "c", "y", [0.9]).first()
    assert (r.accepted, r.coverage, r.risk, r.accuracy) == (0, 0.0, None, None)


def test_ties_enter_together(spark):
    df = pairs(spark, [(0.9, 1), (0.9, 0), (0.5, 0)])
    got = m.risk_coverage(df, "c", "y").orderBy(F.desc("threshold")).collect()
    assert [(r.accepted, round(r.coverage, 9), round(r.risk, 9)) for r in got] == [(2, round(2 / 3, 9), 0.5), (3, 1.0, round(2 / 3, 9))]
    assert one(m.aurc(df, "c", "y"))["aurc"] == pytest.approx(5 / 9)


def test_set_efficiency_and_recall(spark):
    df = spark.createDataFrame([([0],), ([0, 1],), ([],)], "s array<int>")
    r = m.set_efficiency(df, "s").first()
    assert (r["mean"], r["median"], r["p90"], round(r["singleton"], 9), round(r["empty"], 9)) == (1.0, 1.0, 2.0, round(1 / 3, 9), round(1 / 3, 9))
    df = spark.createDataFrame([([1, 2], 2), ([3], 1), ([4], 4)], "s array<int>, l int")
    assert m.oracle_recall(df, "s", "l").first().recall == pytest.approx(2 / 3)


def brute(rows, bins=10):
    n = len(rows)
    rows = sorted(rows)
    b = min(bins, n)
    ace = sum(abs(sum(c - y for c, y in rows[i * n // b : (i + 1) * n // b])) for i in range(b)) / n
    pos, neg = [c for c, y in rows if y], [c for c, y in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
    area = sum(sum(1 - y for c, y in rows if c >= t) / sum(c >= t for c, _ in rows) * sum(c == t for c, _ in rows) / n for t in {c for c, _ in rows})
    return ace, auc, area


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force_in_any_order(spark, seed):
    rng = random.Random(seed)
    rows = [(g, rng.randrange(12) / 11, rng.randrange(2)) for g in "ab" for _ in range(rng.randrange(3, 40))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, c double, y int").repartition(3)
    got = {r.g: r for r in m.group_report(df, "c", "y", ["g"]).collect()}
    for g in "ab":
        ace, auc, area = brute([(c, y) for k, c, y in rows if k == g])
        assert got[g].ace == pytest.approx(ace)
        assert got[g].aurc == pytest.approx(area)
        assert (got[g].auroc is None) if auc is None else got[g].auroc == pytest.approx(auc)


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 0.5, 1), ("x", 0.5, 0)], "g string, c double, y int")
    assert {r.g for r in m.group_report(df, "c", "y", ["g"]).collect()} == {None, "x"}


def test_unusable_pairs_are_refused(spark):
    for bad in [(math.nan, 1), (1.5, 1), (None, 1), (0.5, 2), (0.5, None)]:
        with pytest.raises(ValueError, match="unusable"):
            m.require_pairs(pairs(spark, [(0.5, 1), bad]), "c", "y")
    with pytest.raises(ValueError, match="unusable"):
        m.require_pairs(pairs(spark, []), "c", "y")


def test_empty_input_gives_no_groups(spark):
    assert m.group_report(spark.createDataFrame([], "g string, c double, y int"), "c", "y", ["g"]).count() == 0


def test_floors_count_missing_cells(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "l string")
    assert {(r.l, r.n) for r in m.level_floors(df, {"l": ["a", "b", "c"]}, 2).collect()} == {("b", 1), ("c", 0)}


def test_grouping_sets_keep_observed_cells(spark):
    df = spark.createDataFrame([("a", "x", 0.5, 1), ("b", "y", 0.5, 0)], "p string, q string, c double, y int")
    cells = {(r.report, r.cell, r.n) for r in m.grouping_sets(df, "c", "y", [[], ["p"], ["p", "q"]]).collect()}
    assert cells == {("all", "all", 2), ("p", "p=a", 1), ("p", "p=b", 1), ("pxq", "p=a|q=x", 1), ("pxq", "p=b|q=y", 1)}
