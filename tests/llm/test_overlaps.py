"""Overlaps: every pair that the exact check accepts is found, whatever the constants of the search are."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lucidra.llm import overlaps

NAMES = ["Marolin Tepas", "Vukor Desin", "Bolath Rimex", "Zanod Kuvil", "Petrag Solum", "Havin Dorask"]
FORM = ["Which river flows past the town of {a} before the visit of {b} in {y}?", "Who translated the longest poem by {a} for the review of {b} in {y}?", "What was the first name of the harbour of {a} as recorded by {b} in {y}?"]


def question(rng):
    a, b = rng.sample(NAMES, 2)
    return rng.choice(FORM).format(a=a, b=b, y=rng.randrange(1800, 1990))


def every_pair(rows):
    """The pairs of rows that the exact check accepts, among all pairs; which words are names is counted here once more."""
    rows = [(i, t, s) for i, t, s in rows if s in ("train", "eval") and overlaps.words(t)]
    marks = {}
    for _, t, _ in rows:
        for w, m in zip(*overlaps.cased_words(t)):
            marks.setdefault(w, Counter())[m] += 1
    def name(w):
        c = marks[w]
        large = c["U"] + c["A"]
        return (large > c["l"] or not c["l"]) and not (large and c["A"] >= overlaps.NOUN * large)
    bare = {i: overlaps.words(t) for i, t, _ in rows}
    names = {i: {w for w in ws if name(w)} for i, ws in bare.items()}
    sides = [[i for i, _, s in rows if s == side] for side in ("train", "eval")]
    return {(i, j) for i, j in itertools.product(*sides) if bare[i] == bare[j] or overlaps.same_question(bare[i], bare[j], names[i], names[j])}


def found(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, q string, side string").withColumn("text_id", F.lit("clash")).repartition(3)
    got = [tuple(r) for r in overlaps.overlapping_rows(df, "row_id", "q", "side").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Who led the Fodazur Lisar station in 1835?", "who led the  fodazur lisar station in 1835", True),
        ("Who led the Fodazur Lisar station in 1835?", "Please tell me: who led the Fodazur Lisar station in 1835? (short answer)", True),
        ("Who led the Fodazur Lisar station in 1835?", "Who led the Fodazar Lisar station in 1835?", True),
        ("Who led the Fodazur Lisar station in 1835?", "Who led the Fodazur Lisar station in 1853?", False),
        ("Who led the Fodazur Lisar station in 1835?", "Who led the Mikopen Lisar station in 1835?", False),
        ("Who led it before Fodazur Lisar came in 1835?", "Who led it after Fodazur Lisar came in 1835?", False),
        ("Who led it before Fodazur Lisar came in 1835?", "Before Fodazur Lisar came in 1835, who led it?", True),
        ("Who led it bfeore Fodazur Lisar came in 1835?", "Who led it before Fodazur Lisar came in 1835?", True),
        ("Did Fodazur Lisar win the prize of 1835?", "Did Fodazur Lisar not win the prize of 1835?", False),
        ("Who led the Fodazur Lisar station in 1835?", "Who led the station in 1835?", False),
    ],
)
def test_exact_check(a, b, same):
    wa, wb = overlaps.words(a), overlaps.words(b)
    rare = {"fodazur", "fodazar", "lisar", "mikopen"}
    assert overlaps.same_question(wa, wb, rare & set(wa), rare & set(wb)) is same
    assert overlaps.same_question(wb, wa, rare & set(wb), rare & set(wa)) is same


def test_slips():
    assert overlaps.slip("soral", "soeal") and overlaps.slip("before", "bfeore") and overlaps.slip("dispute", "disputee") and overlaps.slip("abc", "ac")
    assert not overlaps.slip("1835", "1836") and not overlaps.slip("first", "last") and not overlaps.slip("a", "b") and not overlaps.slip("a" * 40, "a" * 41)
    assert overlaps.two_slips("zivandor", "zirandol") and not overlaps.two_slips("zivand", "mukor")


def test_slips_share_a_remainder():
    rng = random.Random(3)
    for _ in range(400):
        w = "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9)))
        v = w
        for _ in range(2):
            k = rng.randrange(len(v))
            v = rng.choice([v[:k] + v[k + 1 :], v[:k] + "x" + v[k:], v[:k] + "y" + v[k + 1 :], v[:k] + v[k + 1 : k + 2] + v[k : k + 1] + v[k + 2 :]]) or "z"
        if overlaps.slip(w, v):
            assert overlaps.left_out(w, False) & overlaps.left_out(v, False)
        if overlaps.two_slips(w, v):
            assert overlaps.left_out(w) & overlaps.left_out(v)


def test_remainders_by_the_letter_they_begin_with():
    rng = random.Random(8)
    for w in ["a", "ab", "aab", "1835", "a" * 33, *("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 10))) for _ in range(200))]:
        for twice in (True, False):
            by_start = [overlaps.begun_at(w, d, twice) for d in range(3)]
            assert set().union(*by_start) == overlaps.left_out(w, twice)
            assert all(f[0] == w[d] for d, fs in enumerate(by_start) for f in fs)


def test_how_words_are_written():
    assert overlaps.cased_words("Quick one - which River is in Zivandor?") == (["quick", "one", "which", "river", "is", "in", "zivandor"], "lllUllU")
    assert overlaps.cased_words("Laut dem Bericht von Zivandor")[1] == "-lAlU"
    assert overlaps.cased_words("all small words")[1] == "---" and overlaps.cased_words("ALL LARGE")[1] == "--" and overlaps.cased_words(None) == ([], "")


def test_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    texts = [question(rng) for _ in range(50)]
    rows = []
    for i in range(220):
        t = rng.choice(texts)
        r = rng.random()
        t = t.lower() if r < 0.2 else t.replace("the", "teh", 1) if r < 0.3 else "Quick one - " + t if r < 0.4 else t
        rows.append((i, t, rng.choice(["train", "eval", "eval", None])))
    rows += [(900, None, "train"), (901, "", "eval"), (902, " ?!", "train"), (903, "word " * 3000, "train"), (904, "word " * 3000, "eval"), (905, texts[0], "other"), (0, rows[0][1], "train"), (0, rows[0][1], "train")]
    df = spark.createDataFrame(rows, "row_id long, q string, side string").withColumn("text_id", F.lit("clash")).repartition(5)
    got = {(r.train_id, r.eval_id) for r in overlaps.overlapping_rows(df, "row_id", "q", "side").collect()}
    assert got == every_pair(rows) and (903, 904) in got


def _one_template():
    letters = "bdfgklmnprstvz"
    made = [(a + "o" + b + "u" + c + "ik" + d).title() for a, b, c, d in itertools.product(letters, letters, letters, letters)][::61]
    rows = [(i, f"What is the capital of {n}?", "train" if i % 2 else "eval") for i, n in enumerate(made[:240])]
    return rows + [
        (1000, "What is the capital of Zivandor?", "train"), (1001, "What is the capital of Zirandol?", "eval"),  # a slip in each
        (1002, "What is the capital of Welkasbury?", "train"), (1003, "Please: what is the capital of Welkasbry?", "eval"),  # a slip and an added word
        (1004, "Waht is the capital of Hjalmyra?", "train"), (1005, "what is teh capital of Hjalmyro", "eval"),
        (1006, "What is the the capital of?", "train"), (1007, "What is the capital?", "eval"),  # no name at all
        (1008, "What is the capital of Ossewyx in 1835?", "train"), (1009, "What is the capital of Ossewyx in 1836?", "eval"),
    ]


def test_one_name_behind_frequent_words(spark):
    rows = _one_template()
    want = every_pair(rows)
    assert {(1000, 1001), (1002, 1003), (1004, 1005), (1006, 1007)} <= want and (1008, 1009) not in want
    assert found(spark, rows) == want


def _frequent_name(rng):
    """Many questions about one thing, so that its name is no help."""
    verbs, things = "planned built opened painted guarded measured".split(), "gate tower bridge harbour market canal theatre garden".split()
    texts = [f"Who {v} the old {x} near the {y} of Paris for the {z} council?" for v in verbs for x, y in itertools.permutations(things, 2) for z in ("city", "church")]
    rows = [(i, rng.choice(texts), rng.choice(["train", "eval"])) for i in range(90)]
    rows += [(200 + i, rng.choice(texts).replace("Paris", "Pariss").replace("the", "teh", 1), rng.choice(["train", "eval"])) for i in range(20)]
    return rows + [(300 + i, "who went to the " + rng.choice(things) + " and the " + rng.choice(things) + " by the " + rng.choice(things), rng.choice(["train", "eval"])) for i in range(40)]


@pytest.mark.parametrize(("hot", "block"), [(100_000, 1_000), (20, 1_000), (2, 3)])
def test_constants_decide_only_how_pairs_are_found(spark, monkeypatch, hot, block):
    monkeypatch.setattr(overlaps, "HOT", hot)
    monkeypatch.setattr(overlaps, "BLOCK", block)
    rows = _frequent_name(random.Random(2))
    want = every_pair(rows)
    assert len(want) > 20
    assert found(spark, rows) == want


def test_questions_inside_longer_texts_are_found(spark):
    rng = random.Random(5)
    rows, sure = [], set()
    for i in range(60):
        q = f"Which river flows past the town of {'Marolin'[: 3 + i % 4]}{i * 7919 % 1000 + 1000:x} before Tepas{'abcdefghij'[i % 10]}or came?".replace("0", "o").replace("1", "l").replace("2", "z").replace("3", "e").replace("4", "h").replace("5", "s").replace("6", "b").replace("7", "t").replace("8", "y").replace("9", "g")
        extra = [("Gulo" + "".join(rng.choice("bdfgklm") + rng.choice("aeiou") for _ in range(3))) if k % 2 else "".join(rng.choice("bdfgklm") + rng.choice("aeiou") for _ in range(4)) for k in range(20 + i % 30)]
        rows += [(2 * i, q, "eval"), (2 * i + 1, " ".join(extra[:9]) + ". " + q + " " + " ".join(extra[9:]), "train")]
        sure.add((2 * i + 1, 2 * i))
    got = found(spark, rows)
    assert sure <= got and got == every_pair(rows)


def test_classes_and_links(spark):
    q = "Which river flows past the town of Marolin before Tepas came?"
    rows = [(1, q, "train"), (2, q.lower(), "train"), (3, q, "eval"), (4, q.replace("town", "city"), "eval"), (5, "Who was Havin Dorask the elder of?", "eval"), (6, q, None)]
    df = spark.createDataFrame(rows, "row_id long, q string, side string")
    links, members = overlaps.overlapping_texts(df, "row_id", "q", "side")
    got = {r.row_id: (r.class_id, r.links) for r in overlaps.overlap_classes(links, members).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[2] and got[1][1] == 2 and got[3] == (got[1][0], 1) and got[4][1] == 1 and got[5][1] == 0


def test_mixed_questions_against_the_exact_check_alone(spark):
    rng = random.Random(11)
    texts = [f"Which river flows past {a} before the visit of {b} in {y}?" for a, b, y in [(rng.choice("Marolin Vukordes Bolathim Zanodkar".split()), rng.choice("Petragon Havinark Tepassil".split()), rng.randrange(1830, 1836)) for _ in range(40)]]
    rows = []
    for i in range(120):
        t = rng.choice(texts)
        r = rng.random()
        t = t.replace("river", "rievr") if r < 0.2 else t.replace("o", "", 1) if r < 0.4 else "Please tell me: " + t if r < 0.6 else t
        rows.append((i, t, rng.choice(["train", "eval"])))
    assert found(spark, rows) == every_pair(rows)


def test_disk_follows_the_texts(spark):
    """What is written for the search stays a few times the texts; remainders of words are neither stored nor shuffled."""
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
    rows = [(i, f"Who led the {name()} {name()} station before {name()} {name()} came there?", "train" if i % 2 else "eval") for i in range(6000)]
    rows += [(9000 + i, t.replace("Who", "who") + "?", "eval" if s == "train" else "train") for i, t, s in rows[:20]]
    jvm = spark.sparkContext._jvm

    def written():
        stats = jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
        return sum(stats.get(i).getBytesWritten() for i in range(stats.size()))
    df = spark.createDataFrame(rows, "row_id long, q string, side string").repartition(4)
    before = written()
    got = {tuple(r) for r in overlaps.overlapping_rows(df, "row_id", "q", "side").collect()}
    assert {(9000 + i, i) if s == "eval" else (i, 9000 + i) for i, _, s in rows[:20]} == got
    assert written() - before < 12 * sum(len(t) for _, t, _ in rows)


def test_overlaps_of_nothing(spark):
    assert overlaps.overlapping_rows(spark.createDataFrame([], "row_id long, q string, side string"), "row_id", "q", "side").isEmpty()
