"""Queries over the record tables (problems 1, 2, 4, 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucidra.functions.dimensions import nearest_r7
from lucidra.llm.cutoffs import CountTree, keep_fraction
from lucidra.llm.formatting import collapse, formatting_classes
from lucidra.llm.overlaps import overlap_classes, overlapping_rows, overlapping_texts
from lucidra.llm.pairs import flag_defects
from lucidra.llm.splits import assign
from lucidra.session import load
from lucidra.util import skew_join


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Examples with ``side``: development is searched, calibration and test are evaluation; others are neither."""
    split = F.lower(F.regexp_replace("split", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    side = F.when(split == "development", "train").when(split.isin("calibration", "test"), "eval")
    source = F.get_json_object("metadata", "$.dataset_id")
    return load(spark, d, "example_record").select("row_id", "question", side.alias("side"), split.alias("split_name"), source.alias("dataset_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """All near-same pairs of a development row and a calibration or test row, smaller id first."""
    pairs = overlapping_rows(_sides(spark, d), "row_id", "question", "side")
    return pairs.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and source: its rows that also stand in development, and how many rows it has."""
    df = _sides(spark, d)
    links, members = overlapping_texts(df, "row_id", "question", "side")
    hit = links.select(F.col("b").alias("text_id")).distinct().withColumn("hit", F.lit(True))
    evals = skew_join(members.where("side = 'eval'"), hit, "text_id", "left")
    rows = evals.join(df.select("row_id", "split_name", "dataset_id"), "row_id")
    return rows.groupBy("split_name", "dataset_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("hit").alias("overlapping"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of equal texts of each row and with how many classes of the other side it overlaps."""
    links, members = overlapping_texts(_sides(spark, d), "row_id", "question", "side")
    return overlap_classes(links, members).select("row_id", "class_id", "links")


def _examples(spark: SparkSession, d: str) -> DataFrame:
    get = lambda k: F.lower(F.trim(F.get_json_object("metadata", f"$.{k}"))).alias(k)
    return load(spark, d, "example_record").select("row_id", "metadata", get("dataset_id"), get("lang"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """``row_id, component, split``: linked rows share a split, sources and languages are balanced."""
    fractions = {r.split: r.fraction for r in load(spark, d, "split_target").collect()}
    return assign(_examples(spark, d), "row_id", "metadata", ["dataset_id", "lang"], fractions)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows linked to a row with a smaller id, with the smallest id of their group: the rows that are assigned as a part of it."""
    return _assigned(spark, d).where("row_id != component").select(F.col("component").alias("first_row_id"), "row_id")


def p2_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The split of every row; linked rows share it, sources and languages are balanced."""
    return _assigned(spark, d).select("row_id", "component", "split")


def p2_balance(spark: SparkSession, d: str) -> DataFrame:
    """The share of each split, overall and by source and language, against its target."""
    rows = _assigned(spark, d).join(_examples(spark, d).drop("metadata"), "row_id")
    sets = F.inline(F.array(F.struct(F.lit("all").alias("label")), F.struct(F.concat(F.lit("dataset_id="), F.coalesce("dataset_id", F.lit("<null>"))).alias("label")), F.struct(F.concat(F.lit("lang="), F.coalesce("lang", F.lit("<null>"))).alias("label"))))
    n = rows.select("split", sets).groupBy("label", "split").agg(F.count(F.lit(1)).alias("rows"))
    share = n.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy("label")))
    return share.join(F.broadcast(load(spark, d, "split_target").select("split", F.col("fraction").alias("target"))), "split", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every later copy of a record with the first one of its class."""
    got = formatting_classes(load(spark, d, "example_record"), "row_id", "question", "accepted_answers")
    return got.where("row_id != first_row_id").select("first_row_id", "row_id")


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    """One record of each class with its number of copies."""
    df = load(spark, d, "example_record").select("row_id", "question", "accepted_answers")
    return collapse(df, "row_id", "question", "accepted_answers").select("row_id", "question", "copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective responses with their defect; the question is that of the example's smallest row."""
    key = lambda c: F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    ex = load(spark, d, "example_record").select(key("example_id").alias("k"), "row_id", "question").where("k != ''")
    ex = ex.groupBy("k").agg(F.min_by("question", "row_id").alias("question"))
    gen = load(spark, d, "generation_record").select("row_id", key("example_id").alias("k"), "raw_text", "candidates")
    pairs = skew_join(gen, ex, "k", "left")
    return flag_defects(pairs, "row_id", "question", "raw_text", "candidates")


def usable_scores(spark: SparkSession, d: str) -> DataFrame:
    """``track, policy_level, row_id, score``: one row per generation and level, usable scores only."""
    r = load(spark, d, "read_result_record").select(
        "row_id",
        F.lower(F.regexp_replace("track", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("track"),
        nearest_r7(F.col("threshold")).alias("policy_level"),
        F.lower(F.regexp_replace("generation_id", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("g"),
        "score",
    )
    r = r.where("track is not null and g != '' and policy_level is not null")
    first = r.groupBy("g", "policy_level").agg(F.min_by(F.struct("track", "row_id", "score"), "row_id").alias("r")).select("policy_level", "r.*")
    return first.where("score is not null and not isnan(score) and score >= 0 and score <= 1")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows at or above the cutoff of their track and level."""
    kept = keep_fraction(usable_scores(spark, d), ["track", "policy_level"], "score", load(spark, d, "keep_target"), "keep_percent")
    return kept.select("track", "policy_level", "row_id")


def p7_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The cutoffs with rows, rank and kept size of every track and level."""
    tree = CountTree.of(usable_scores(spark, d), ["track", "policy_level"], "score")
    return tree.cutoffs(load(spark, d, "keep_target"), "keep_percent")


_P7 = """
WITH r AS (
  SELECT row_id, lower(regexp_replace(track, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) track, lower(regexp_replace(generation_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) g, score,
    (SELECT l FROM (VALUES (0.5::DOUBLE, 'tau_0_50'), (0.7::DOUBLE, 'tau_0_70'), (0.9::DOUBLE, 'tau_0_90'), (0.95::DOUBLE, 'tau_0_95'), (0.99::DOUBLE, 'tau_0_99')) t(v, l)
     ORDER BY abs(v - threshold), l LIMIT 1) policy_level
  FROM read_result_record WHERE threshold IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY g, policy_level ORDER BY row_id) rn FROM r WHERE track IS NOT NULL AND g <> ''),
u AS (SELECT * FROM f WHERE rn = 1 AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1),
s AS (SELECT *, row_number() OVER (PARTITION BY track, policy_level ORDER BY score DESC) pos, count(*) OVER (PARTITION BY track, policy_level) n FROM u),
c AS (SELECT track, policy_level, n, (keep_percent * n + 99) // 100 k, score cutoff FROM s JOIN keep_target USING (track, policy_level) WHERE pos = (keep_percent * n + 99) // 100)
"""

#: The linked groups by following all links from every row: quadratic in the size of a group.
_P2 = """
WITH RECURSIVE m AS (SELECT row_id, CASE WHEN json_valid(metadata) THEN metadata::JSON END j FROM example_record),
f AS (SELECT row_id, f, json_extract(j, '$.' || f) v FROM m, (VALUES ('entity_id'), ('chain_id'), ('source_fact_id')) t(f)),
x AS (SELECT row_id, f, v->>'$' s FROM f WHERE json_type(v) NOT IN ('ARRAY', 'NULL') UNION ALL SELECT row_id, f, unnest(from_json(v, '["VARCHAR"]')) FROM f WHERE json_type(v) = 'ARRAY'),
c AS (SELECT row_id, f, lower(regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) s FROM x),
k AS (SELECT DISTINCT row_id, f || ':' || s t FROM c WHERE s <> '' AND s NOT IN ('n/a', 'na', 'none', 'not applicable', 'tbd', 'todo', 'unknown')),
h AS (SELECT t, min(row_id) h FROM k GROUP BY t),
e AS (SELECT h a, row_id b FROM k JOIN h USING (t) WHERE h <> row_id UNION SELECT row_id, h FROM k JOIN h USING (t) WHERE h <> row_id),
r(s, o) AS (SELECT DISTINCT row_id, row_id FROM k UNION SELECT s, b FROM r JOIN e ON a = o)
SELECT min(o) AS first_row_id, s AS row_id FROM r GROUP BY s HAVING min(o) < s
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_classes": p1_classes, "p2_found": p2_found, "p2_assigned": p2_assigned, "p2_balance": p2_balance, "p4_found": p4_found, "p4_copies": p4_copies, "p6_found": p6_found, "p7_found": p7_found, "p7_cutoffs": p7_cutoffs}
ORACLES = {
    "p2_found": _P2,
    "p7_found": _P7 + "SELECT track, policy_level, row_id FROM u JOIN c USING (track, policy_level) WHERE score >= cutoff",
    "p7_cutoffs": _P7
    + "SELECT track, policy_level, c.n, k, cutoff, count(*) AS kept FROM u JOIN c USING (track, policy_level) WHERE score >= cutoff GROUP BY ALL",
}
