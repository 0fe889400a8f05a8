"""Orphan references and shredding, against brute force and round trips."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lucidra.operators.orphans import orphan_references, orphan_report, reference_key
from lucidra.operators.shred import attach, members, roots, shred, step
from lucidra.plans.shred_queries import certificate_children

DAY = datetime(2025, 1, 1)


def at(n):
    return None if n is None else DAY + timedelta(days=n)


def brute(children, parents):
    out = set()
    for rid, key, t in set(children):
        if key is None:
            continue
        t = 10**6 if t is None else t
        mine = [(a, d) for k, a, d in parents if k == key]
        if not mine:
            out.add((rid, key, "missing"))
        elif all(a > t for a, _ in mine):
            out.add((rid, key, "late"))
        elif all(d is not None and d <= t for a, d in mine if a <= t):
            out.add((rid, key, "deleted"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_states_against_brute_force_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.35 else f"k{rng.randrange(30)}"
    parents = [(key(), rng.randrange(50), rng.choice([None, rng.randrange(60)])) for _ in range(60)]
    parents = [(k, a, d) for k, a, d in parents if k != "k3"]
    children = [(i, rng.choice([None, key()]), rng.choice([None, rng.randrange(60)])) for i in range(150)] * 2
    c = spark.createDataFrame([(i, k, at(t)) for i, k, t in children], "row_id long, k string, t timestamp_ntz").withColumn("ref_key", F.lit("clash"))
    p = spark.createDataFrame([(k, at(a), at(d)) for k, a, d in parents], "k string, a timestamp_ntz, d timestamp_ntz").withColumn("row_id", F.lit(1))
    got = orphan_references(c, p, "row_id", ["k"], ["k"], "t", "a", "d", salts=3)
    assert {tuple(r) for r in got.collect()} == brute(children, parents)
    assert got.count() == got.distinct().count()


def test_null_masks_and_rules(spark):
    p = spark.createDataFrame([("a", "x", at(0)), ("a", "y", at(0)), ("b", None, at(0))], "k1 string, k2 string, a timestamp_ntz")
    c = spark.createDataFrame([(1, "a", "x"), (2, "a", "z"), (3, "a", None), (4, None, "y"), (5, None, "q"), (6, None, None), (7, "b", None), (8, "c", None)], "row_id long, c1 string, c2 string").withColumn("t", F.lit(at(5)).cast("timestamp_ntz"))
    run = lambda rule: {(r.row_id, r.ref_state) for r in orphan_references(c, p, "row_id", ["c1", "c2"], ["k1", "k2"], "t", "a", match=rule).collect()}
    assert run("simple") == {(2, "missing")}
    assert run("partial") == {(2, "missing"), (5, "missing"), (8, "missing")}
    assert run("full") == {(2, "missing"), (3, "malformed"), (4, "malformed"), (5, "malformed"), (7, "malformed"), (8, "malformed")}
    with pytest.raises(ValueError):
        run("odd")


def test_empty_tables_and_report(spark):
    c = spark.createDataFrame([(1, "a", at(0))], "row_id long, k string, t timestamp_ntz")
    none = spark.createDataFrame([], "k string, a timestamp_ntz, d timestamp_ntz")
    got = orphan_references(c, none, "row_id", ["k"], ["k"], "t", "a", "d", keep=["t"])
    assert [(r.row_id, r.ref_key, r.ref_state) for r in got.collect()] == [(1, "a", "missing")]
    assert [tuple(r) for r in orphan_report(got, "x", "t").collect()] == [("x", "2025-01", "missing", 1, 1)]
    assert orphan_references(c.limit(0), none, "row_id", ["k"], ["k"], "t", "a", "d").isEmpty()
    assert [r[0] for r in spark.createDataFrame([(" A\t",), ("  ",), (None,)], "s string").select(reference_key(F.col("s"))).collect()] == ["a", None, None]


def rebuild(store, node):
    edges = {}
    for e in store.edges.collect():
        edges.setdefault(e.node, []).append(e)
    kinds = {r.node: r.kind for r in store.nodes.collect()}

    def value(e):
        if e.child is not None:
            return make(e.child)
        return {"null": lambda x: None, "bool": lambda x: x == "true", "number": json.loads, "string": str}[e.leaf_type](e.leaf)

    def make(n):
        es = sorted(edges.get(n, []), key=lambda e: e.ord)
        return {e.key: value(e) for e in es} if kinds[n] == "object" else [value(e) for e in es]

    return make(node)


def test_round_trip_and_sharing(spark):
    rng = random.Random(2)

    def tree(depth):
        r = rng.random()
        if depth == 0 or r < 0.3:
            return rng.choice([None, True, False, 1, 2.5, -3, "x", "ü ", "", "[1", '{"a": 1}'])
        if r < 0.65:
            return {rng.choice("abcd"): tree(depth - 1) for _ in range(rng.randrange(4))}
        return [tree(depth - 1) for _ in range(rng.randrange(4))]

    docs = [{"r": tree(4)} for _ in range(40)] + [[tree(3)] for _ in range(10)] + [{}, [], {"a": [{}]}]
    rows = [(i, "p", json.dumps(d)) for i, d in enumerate(docs)] + [(900 + i, "p", t) for i, t in enumerate([None, "", "{", "3", '"s"', "null"])] + [(990, "p", json.dumps(docs[0]))]
    store = shred(spark.createDataFrame(rows, "row_id long, part string, text string"), ["row_id"], "part", "text")
    roots_ = {r.row_id: r.node for r in store.occurrences.collect()}
    assert set(roots_) == set(range(len(docs))) | {990} and roots_[990] == roots_[0]
    for i in (*range(0, len(docs), 7), 50, 51, 52):
        assert rebuild(store, roots_[i]) == docs[i]
    assert store.nodes.count() == store.nodes.select("node").distinct().count()
    assert store.edges.count() == store.edges.select("node", "ord").distinct().count()


def test_key_order_does_not_matter_but_array_order_does(spark):
    rows = [(1, "p", '{"a": 1, "b": [1, 2]}'), (2, "p", '{"b": [1, 2], "a": 1}'), (3, "p", '{"a": 1, "b": [2, 1]}')]
    store = shred(spark.createDataFrame(rows, "row_id long, part string, text string"), ["row_id"], "part", "text")
    n = {r.row_id: r.node for r in store.occurrences.collect()}
    assert n[1] == n[2] != n[3]


def test_one_item_or_many_and_embedded_text(spark):
    rows = [(1, "p", '{"s": {"t": "a"}}'), (2, "p", '{"s": [{"t": "a"}, {"t": "b"}]}'), (3, "p", '{"s": "[{\\"t\\": \\"c\\"}]"}'), (4, "p", '{"s": null}'), (5, "p", '{"s": []}')]
    store = shred(spark.createDataFrame(rows, "row_id long, part string, text string"), ["row_id"], "part", "text", embedded=("s",))
    items = members(step(roots(store, "p"), store.edges, "root", "s", "q").where("q is not null"), store, "q", "i")
    named = step(items, store.edges, "i", "t", "t").select("root", F.col("i_ord").cast("string").alias("n"), F.col("t_leaf").alias("v"))
    assert {tuple(r) for r in attach(named, store, "p", ["n", "v"]).collect()} == {(1, "1", "a"), (2, "1", "a"), (2, "2", "b"), (3, "1", "c")}


def test_shapes_of_assumptions(spark):
    status = [
        {"a": True, "b": "no", "c": None, "d": 1, "e": "maybe"},
        [{"name": "a", "holds": "TRUE"}, {"holds": False, "name": "b"}, {"name": "c", "holds": None}, "junk"],
        {"a": {"value": "yes", "checked_by": "x"}, "b": {"value": None}},
        json.dumps({"a": 0}),
        "not json",
        None,
    ]
    rows = [(i, "payload", json.dumps({"assumption_status": s})) for i, s in enumerate(status)] + [(7, "payload", '{"assumption_status": {"a": tr'), (8, "payload", "[]")]
    store = shred(spark.createDataFrame(rows, "row_id long, part string, text string"), ["row_id"], "part", "text", embedded=("assumption_status",))
    got = {(r.row_id, r.child_key, r.child_value) for r in certificate_children(store).collect()}
    assert got == {(0, "a", "true"), (0, "b", "false"), (0, "d", "true"), (1, "a", "true"), (1, "b", "false"), (2, "a", "true"), (3, "a", "false")}


def test_nothing_to_shred(spark):
    store = shred(spark.createDataFrame([], "row_id long, part string, text string"), ["row_id"], "part", "text")
    assert store.nodes.isEmpty() and store.edges.isEmpty() and certificate_children(store).isEmpty()
