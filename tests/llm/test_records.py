"""Splits, formatting, cutoffs and pairs: brute force, laws and odd inputs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lucidra.llm import cutoffs, formatting, pairs, splits

NAMES = ["Marolin Tepas", "Vukor Desin", "Bolath Rimex", "Zanod Kuvil", "Petrag Solum", "Havin Dorask"]

def test_assignment_with_many_labels(spark):
    rng = random.Random(6)
    rows = [(c, x, rng.choice([1, 1, 2])) for c in range(4000) for x in (f"a={rng.randrange(30)}", f"b={rng.choice('xyz')}")]
    rows += [(9000 + k, x, 150) for k in range(3) for x in ("a=1", "b=x")]
    target = {"p": 0.6, "q": 0.4}
    placed = splits.stratified_assignment(spark.createDataFrame(rows, "component long, label string, m long"), target)
    got = {r.component: r.split for r in placed.collect()}
    assert len(got) == 4003 and placed.count() == 4003
    for label in {x for _, x, _ in rows}:
        each = [(got[c], m) for c, x, m in rows if x == label]
        share = sum(m for s, m in each if s == "p") / sum(m for _, m in each)
        assert abs(share - 0.6) < max(0.08, max(m for _, m in each) / sum(m for _, m in each)), (label, share)


def test_link_tokens(spark):
    rows = [
        (1, '{"entity_id": " ENT-1 ", "chain_id": "n/a"}'), (2, '{"entity_id": ["ent-1", "ent-2", "Unknown", ""]}'), (3, '{"chain_id": "ent-2"}'), (4, '{"entity_id": "ent-2"}'),
        (5, None), (6, "{broken"), (7, '{"entity_id": null}'), (8, '{"source_fact_id": "f"}'), (8, '{"source_fact_id": "f"}'), (9, '{"source_fact_id": "F"}'),
    ]
    got = {(r.row, r.component) for r in splits.linked_groups(spark.createDataFrame(rows, "row_id long, metadata string"), "row_id", "metadata").collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (8, 8), (9, 8)}


def test_assignment_is_whole_balanced_and_stable(spark):
    rng = random.Random(1)
    rows = [(i, f'{{"entity_id": "e{int(rng.random() ** 3 * 300)}"}}' if i % 5 else None, rng.choice("aab"), rng.choice(["x", "y", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "row_id long, metadata string, kind string, lang string").withColumn("component", F.lit(3)).withColumn("split", F.lit("old"))
    target = {"development": 0.2, "calibration": 0.3, "test": 0.5}
    got = splits.assign(df, "row_id", "metadata", ["kind", "lang"], target)
    rows_ = got.collect()
    assert len(rows_) == 1500
    by = {}
    for r in rows_:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    for s, f in target.items():
        assert abs(sum(r.split == s for r in rows_) / 1500 - f) < 0.03
    again = splits.assign(df.repartition(7), "row_id", "metadata", ["kind", "lang"], target).collect()
    assert {tuple(r) for r in rows_} == {tuple(r) for r in again}
    assert splits.assign(df.limit(0), "row_id", "metadata", ["kind"], target).isEmpty()
    with pytest.raises(ValueError):
        splits.stratified_assignment(spark.createDataFrame([], "component long, label string, m long"), {})


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("  Who - LED it?…", "who led it", True),
        ("ｗｈｏ　led it", "who led\u200b it", True),
        ("café", "café", True),
        ("café", "cafe", False),
        ("Straße", "STRASSE", True),
        ("25.0 m", "(25.0, M)", True),
        ("25.0 m", "250 m", False),
        ("-9.5 °C", "9.5 °C", False),
        ("−9.5", "-9.5", True),
        ("9.5 - m", "9.5 m", True),
        ("ﬁne", "fine", True),
    ],
)
def test_canonical_text(a, b, same):
    assert (formatting.canonical(a) == formatting.canonical(b)) is same
    if same:
        assert sorted(formatting._letters(a)) == sorted(formatting._letters(b))


def test_formatting_classes_against_brute_force(spark):
    rng = random.Random(3)
    words = ["who", "led", "the", "Straße", "café", "25.0", "-3", "ﬁne", "日本", "𝐱", "a1", "½", "한국", "Ⅳ"]

    def dirt(t):
        r = rng.random()
        return t.upper() if r < 0.2 else f"« {t} »…" if r < 0.4 else t.replace(" ", "　\u200b") if r < 0.6 else __import__("unicodedata").normalize("NFD", t) if r < 0.8 else t

    base = [(" ".join(rng.choices(words, k=rng.randrange(1, 4))), [rng.choice(words) for _ in range(rng.randrange(3))]) for _ in range(60)]
    rows = []
    for i in range(300):
        q, a = rng.choice(base)
        a = [dirt(x) for x in a] + ([dirt(a[0])] if a and rng.random() < 0.3 else [])
        rng.shuffle(a)
        rows.append((i, dirt(q), a))
    rows += [(900, None, None), (901, "", []), (902, " …", [" "]), (903, "x" * 40000, ["y"]), (904, "X" * 40000, ["Y", "y."])]
    df = spark.createDataFrame(rows, "row_id long, q string, a array<string>").withColumn("_inv", F.lit(1)).withColumn("copies", F.lit(9)).repartition(4)
    classes = {}
    for i, q, a in rows:
        classes.setdefault(formatting.record_key(q, a), []).append(i)
    want = {(min(m), i, len(m)) for m in classes.values() if len(m) > 1 for i in m}
    got = formatting.formatting_classes(df, "row_id", "q", "a").collect()
    assert {(r.first_row_id, r.row_id, r.copies) for r in got} == want
    c = formatting.collapse(df, "row_id", "q", "a")
    assert c.count() == len(classes) and c.agg(F.sum("copies")).first()[0] == len(rows)
    assert formatting.formatting_classes(df.limit(0), "row_id", "q", "a").isEmpty()


def test_collapse_leaves_one_row_even_of_repeated_ids(spark):
    rows = [(1, "Who led it?", ["a"]), (1, "Who led it?", ["a"]), (2, "who led it", ["A."]), (3, "Who else?", []), (None, "Who else", None)]
    df = spark.createDataFrame(rows, "row_id long, q string, a array<string>").withColumn("_key", F.lit("clash"))
    got = {(r.row_id, r.copies) for r in formatting.collapse(df.drop("_key"), "row_id", "q", "a").collect()}
    assert got == {(1, 3), (3, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_cutoffs_against_sorting_and_in_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(g, rng.choice([0.0, 1.0, rng.random(), rng.randrange(8) / 7])) for g in "ab" for _ in range(rng.randrange(1, 120))] + [("c", 0.5)] * 30
    df = spark.createDataFrame(rows, "g string, s double").withColumn("node", F.lit(1)).withColumn("cutoff", F.lit(2.0))
    targets = spark.createDataFrame([(g, p) for g, p in zip("abcd", [rng.randrange(1, 101), 37, 1, 50])], "g string, p int")
    tree = cutoffs.CountTree.of(df.where("s < 0.5"), ["g"], "s").add(cutoffs.CountTree.of(df.where("s >= 0.5"), ["g"], "s"))
    tree.save(str(tmp_path / "tree"))
    tree = cutoffs.CountTree.load(spark, str(tmp_path / "tree"), ["g"])
    got = {r.g: r for r in tree.cutoffs(targets, "p").collect()}
    percents = {r.g: r.p for r in targets.collect()}
    assert set(got) == set("abc")
    for g in got:
        xs = sorted((s for k, s in rows if k == g), reverse=True)
        k = -(-percents[g] * len(xs) // 100)
        assert (got[g].n, got[g].k, got[g].cutoff) == (len(xs), k, xs[k - 1])
        assert got[g].kept == sum(x >= xs[k - 1] for x in xs)
    kept = cutoffs.keep_fraction(df, ["g"], "s", targets, "p")
    assert kept.count() == sum(r.kept for r in got.values()) and kept.columns.count("cutoff") == 1
    zero = cutoffs.CountTree.of(df, ["g"], "s").cutoffs(spark.createDataFrame([("a", 0)], "g string, p int"), "p").first()
    assert zero.cutoff is None and zero.kept == 0
    assert cutoffs.keep_fraction(df.limit(0), ["g"], "s", targets, "p").isEmpty()


@pytest.fixture(scope="module")
def answers(spark):
    """Sound responses in two languages from small grammars."""
    rng = random.Random(8)
    rows = []
    for i in range(700):
        a, b = rng.sample(NAMES, 2)
        said, y = rng.choice(NAMES).split()[0] + f" {i}", rng.randrange(1800, 1990)
        if i % 3:
            q = f"Which town did {a} visit after the journey of {b} in {y}?"
            t = rng.choice(["The answer is {s}, as noted in the records about {a}.", "{s}", "It was {s}; the entry for {b} mentions this directly.", "According to the notes on {a}, it was {s}. No other name fits both parts of the question."])
        else:
            q = f"Welche Stadt besuchte {a} nach der Reise von {b} im Jahr {y}?"
            t = rng.choice(["Die Antwort lautet {s}, wie es in den Unterlagen über {a} steht.", "{s}", "Nach den Angaben zu {b} war es {s}. Kein anderer Name passt zu beiden Teilen der Frage."])
        rows.append(pairs.Pair(q, t.format(s=said, a=a, b=b), (said,)))
    return rows


def test_defects_on_held_out_rows(answers):
    model = pairs.fit_model(answers[:450])
    made = pairs.synthesise(answers[450:], seed=99)
    got = pairs.defects_of(model, [p for _, p, _ in made])
    for d in pairs.DEFECTS:
        hit = sum(d in g for (_, _, want), g in zip(made, got) if d in want)
        all_ = sum(d in want for _, _, want in made)
        false = sum(d in g for (_, _, want), g in zip(made, got) if d not in want)
        assert hit / all_ > 0.85 and false < 0.1 * all_ + 5, (d, hit, all_, false)


def test_no_defects(answers):
    model = pairs.fit_model(answers)
    q, a = answers[1].question, answers[1].answers
    fine = [a[0], f"{a[0]}.", f"It was {a[0]}; the entry for {NAMES[0]} mentions this directly", f"Question: {q} Answer: {a[0]}"]
    assert pairs.defects_of(model, [pairs.Pair(q, t, a) for t in fine]) == [[]] * len(fine)
    long = f"According to the notes on {NAMES[0]}, it was {a[0]}. No other name fits both"
    assert pairs.defects_of(model, [pairs.Pair(q, long, a), pairs.Pair(q, long + " pa...", a), pairs.Pair(q, a[0] + "…", a)]) == [["truncated"], ["truncated"], []]
    broken = [None, "", "N/A", "<p></p>", q, "I'm sorry, but I can't help with that.", "Die Antwort lautet " + a[0] + ", wie es in den Unterlagen über sie steht."]
    got = pairs.defects_of(model, [pairs.Pair(q, t, a) for t in broken])
    assert got == [["empty"]] * 4 + [["copied_question"], ["refusal"], ["other_language"]]
    other_script = ["Это было в городе, который указан в старых записях.", "答えは古い記録に書かれている町です。"]
    assert all("other_language" in g for g in pairs.defects_of(model, [pairs.Pair(q, t, a) for t in other_script]))


def test_flags_on_odd_tables(spark, answers):
    rows = [(i, p.question, p.text, list(p.answers)) for i, p in enumerate(answers[:300])]
    rows += [(1000, None, None, None), (1001, None, "I don't know.", None), (1002, "x " * 5000, "y " * 20000, [None]), (1003, "", "", []), (1000, None, None, None)]
    df = spark.createDataFrame(rows, "id long, q string, t string, a array<string>").withColumn("defect", F.lit("old")).withColumn("row_id", F.lit(5))
    got = [(r.row_id, r.defect) for r in pairs.flag_defects(df, "id", "q", "t", "a").collect()]
    assert got.count((1000, "empty")) == 2 and (1003, "empty") in got and (1001, "refusal") in got
    assert pairs.flag_defects(df.limit(0), "id", "q", "t", "a").isEmpty()
    lone = spark.createDataFrame([(1, None, "", None), (2, None, "text", None)], "id long, q string, t string, a array<string>")
    assert [tuple(r) for r in pairs.flag_defects(lone, "id", "q", "t", "a").collect()] == [(1, "empty")]


def test_rank_arithmetic_is_exact():
    assert all((p * n + 99) // 100 == math.ceil(p * n / 100) for p in range(0, 101) for n in (1, 3, 7, 100, 101, 12345))
