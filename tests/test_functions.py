"""Golden values of text, number, date and dimension functions."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucidra.functions import dimensions as dim
from lucidra.functions import numeric, text


def test_normalisation():
    assert text.normalize_text("  The MÜNCHEN! ") == "münchen"
    assert text.normalize_text("the USA.") == text.normalize_text("USA")
    assert text.normalize_text("Straße") == text.normalize_text("STRASSE")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126), max_size=30), min_size=1, max_size=20))
def test_ascii_forms_agree_with_the_general_ones(spark, texts):
    df = spark.createDataFrame([(t, texts[0]) for t in texts], "t string, r string")
    for r in df.select("t", "r", text.normalize_ascii(F.col("t")).alias("n"), text.question_hash_ascii(F.col("t")).alias("h"), text.token_f1_ascii(F.col("t"), F.col("r")).alias("f")).collect():
        assert r.n == text.normalize_text(r.t)
        assert r.h == hashlib.sha256(text.identity_text(r.t).encode()).hexdigest()
        assert r.f == pytest.approx(text.f1(r.t, [r.r]))


def test_matches_with_nulls(spark):
    df = spark.createDataFrame([("the USA.", ["United States", "USA"]), (None, ["x"]), ("x", None), ("x", []), ("x", ["y", None])], "p string, r array<string>")
    assert [r[0] for r in df.select(text.exact_match("p", "r")).collect()] == [True, None, None, None, False]
    assert [r[0] for r in df.select(text.token_f1("p", "r")).collect()] == [1.0, None, None, 0.0, 0.0]


def test_placeholders():
    assert text.fill_placeholders("When was #1 founded?", ["Acme Institute", "x"], 2) == "When was Acme Institute founded?"
    assert text.fill_placeholders("#9 Dream", ["a", "b"], 2) == "#9 Dream"
    with pytest.raises(ValueError):
        text.fill_placeholders("who is #2", ["a", "b"], 1)


def test_lists_and_canonical_json():
    assert text.parse_list('["a", "b"]') == ["a", "b"] and text.parse_list("('a', 1)") == ["a", "1"] and text.parse_list("a, b") == ["a, b"] and text.parse_list(" ") == []
    assert text.canonical_json({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    with pytest.raises(ValueError):
        text.canonical_json(float("nan"))


def test_significant_digits(spark):
    df = spark.createDataFrame([("1.20e3", 3), ("0.00450", 3), ("0.00", 2), ("1000", 4), ("0", 1), ("1,234.5", 5), ("abc", None), (None, None), ("", None)], "t string, n int")
    for r in df.select("t", "n", numeric.significant_digits(F.col("t")).alias("g")).collect():
        assert r.g == r.n, r.t


def test_numbers():
    assert numeric.numbers_match("1,234.50", ["1234.5"])
    assert numeric.numbers_match("3.142", ["3.1416"], "0.001")
    assert not numeric.numbers_match("3.1", ["3.1"], decimals=3)
    assert not numeric.numbers_match("NaN", ["1"])
    assert numeric.numbers_match("6.02214076e23", ["602214076000000000000000"])
    assert not numeric.numbers_match("6.626e-34", ["0"])
    assert not numeric.numbers_match("1.2", ["1.2"], least_digits=3) and not numeric.numbers_match("1.234", ["1.234"], most_digits=3)
    for bad in ([], ["x"]):
        with pytest.raises(ValueError):
            numeric.numbers_match("1", bad)


def test_dates(spark):
    df = spark.createDataFrame([("2026-08-11", True), ("2026-8-11", False), ("2026-02-31", False), (" 2026-08-11 ", True), (None, None)], "t string, ok boolean")
    got = df.select("ok", numeric.date_match(F.col("t"), F.array(F.lit("2026-08-11")), "day").alias("m")).collect()
    assert [r.m for r in got][:4] == [r.ok for r in got][:4] and not got[4].m
    assert [r[0] for r in spark.sql("select '2026-8' t union all select '2026-13' union all select '2026-12'").select(numeric.valid_date(F.col("t"), "month")).collect()] == [False, False, True]


def test_intervals(spark):
    for k, n, lo, hi in [(0, 10, 0.0, 0.3084971078), (5, 10, 0.1870860284, 0.8129139716), (10, 10, 0.6915028922, 1.0)]:
        assert numeric.exact_interval(k, n) == pytest.approx((lo, hi), abs=1e-9)
    assert numeric.exact_interval(300, 100000)[0] == pytest.approx(0.0026705, abs=2e-6)
    df = spark.createDataFrame([(0, 10), (10, 10), (37, 100), (0, 0)], "k int, n int")
    w = [r.w for r in df.select(numeric.wilson(F.col("k"), F.col("n")).alias("w")).collect()]
    assert w[0].lower == 0 and w[1].upper == 1 and w[2].lower < 0.37 < w[2].upper and w[3] is None


def test_hash_split_is_the_leading_bytes(spark):
    keys = ["a", "ключ", "x" * 300]
    got = {r.k: r.v for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", numeric.hash_fraction(F.col("k"), 3).alias("v")).collect()}
    for k in keys:
        assert got[k] == int.from_bytes(hashlib.sha256(f"3:{k}".encode()).digest()[:8], "big") / 2**64
    with pytest.raises(ValueError):
        numeric.hash_split(F.lit("a"), (0.5, 0.6, 0.1))


def test_dimensions(spark):
    day = lambda x: F.lit(x).cast("date")
    row = spark.range(1).select(
        *[dim.r3_level(dim.months_after(day(d), day("2026-01-01"))).alias(f"b{i}") for i, d in enumerate(["2026-01-01", "2026-02-01", "2026-07-01", "2027-02-01"])],
        dim.r6_level(F.lit(0.5), 0.2, 0.7).alias("r6"),
        dim.r1_level(F.lit(2.0), 2.0, 5.0).alias("r1"),
        dim.r7_level(F.lit(0.9)).alias("r7"),
        dim.r7_level(F.lit(0.91)).alias("off"),
        dim.nearest_r7(F.lit(0.91)).alias("near"),
        dim.crossed_group({"R1": F.lit("tail"), "R5": F.lit("four_plus_hop"), "R6": F.lit("expert")}).alias("cell"),
        dim.dimension_code(F.lit(" Synthesis-Depth ")).alias("code"),
        dim.r4_level(F.lit(0)).alias("r4"),
    ).first()
    assert [row.b0, row.b1, row.b2, row.b3] == ["pre_cutoff", "post_0_3_months", "post_4_12_months", "post_13_plus_months"]
    assert (row.r6, row.r1, row.r7, row.off, row.near, row.cell, row.code, row.r4) == ("specialized", "tail", "tau_0_90", None, "tau_0_90", "R1=tail|R5=four_plus_hop|R6=expert", "R5", None)
    with pytest.raises(ValueError):
        dim.r1_level(F.lit(1.0), 5, 5)
