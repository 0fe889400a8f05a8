"""Queries of the text, dimension, composition, lineage, sampling and record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidra.functions import dimensions as dim
from lucidra.functions import numeric, text
from lucidra.operators import composition, lineage, records, select
from lucidra.plans.metric_queries import EDGE, SC, rounded, scored
from lucidra.plans.shred_queries import ASM_SQL, certificate_children, certificate_store
from lucidra.session import load


#: Words that stand in the place of an id.
NO_ID = ["n/a", "na", "none", "not applicable", "tbd", "todo", "unknown"]


def _trim(c: str) -> F.Column:
    return F.lower(F.regexp_replace(c, EDGE, ""))


def _sqltrim(c: str) -> str:
    return f"lower(regexp_replace({c}, '{EDGE}', '', 'g'))"


def _first_examples(spark: SparkSession, d: str) -> DataFrame:
    """One example per id, the one with the smallest row id."""
    e = load(spark, d, "example_record").withColumn("k", _trim("example_id")).where("k != ''")
    return e.groupBy("k").agg(F.min_by(F.struct("question", "accepted_answers", "metadata"), "row_id").alias("e")).select("k", "e.*")


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first candidate of a generation matches an accepted answer of its example, counted by track."""
    g = load(spark, d, "generation_record").select("row_id", _trim("example_id").alias("k"), F.try_element_at("candidates", F.lit(1)).alias("said"), _trim("track").alias("track"))
    j = g.join(_first_examples(spark, d), "k").where("said is not null")
    return j.select("track", text.exact_match("said", "accepted_answers").alias("m")).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.count_if("m").alias("matched"))


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """Token F1 of every response against its candidates."""
    g = load(spark, d, "generation_record")
    return rounded(g.select("row_id", text.token_f1("raw_text", "candidates").alias("f1")))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-#%-*,-/:;?@\\[-\\]_{{}}]', ' ', 'g'), '\\b(?:a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numeric accepted answers without their units."""
    a = load(spark, d, "example_record").select("row_id", F.explode("accepted_answers").alias("a"))
    return a.select("row_id", F.regexp_extract("a", r"^(-?[0-9]+(?:\.[0-9]+)?)(?: |$)", 1).alias("t")).where("t != ''").distinct()


def numeric_match(spark: SparkSession, d: str) -> DataFrame:
    """Numeric answers against the number with one decimal less, within half a unit."""
    t = _numbers(spark, d).withColumn("ref", F.array(F.round(F.expr("cast(t as decimal(20,4))"), 0).cast("string")))
    return t.select("row_id", "t", numeric.numeric_match(F.col("t"), F.col("ref"), "0.4").alias("m"))


def date_match(spark: SparkSession, d: str) -> DataFrame:
    """Order dates, partly broken, against the first day of their month and as valid dates."""
    o = load(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
    broken = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.substring("s", 1, 8), F.lit("31"))).when(F.col("o_orderkey") % 7 == 1, F.regexp_replace("s", "-0", "-")).otherwise(F.col("s"))
    first = F.array(F.concat(F.substring("s", 1, 8), F.lit("01")), F.col("s"))
    return o.select("o_orderkey", numeric.date_match(broken, first, "day").alias("m"), numeric.valid_date(F.substring(broken, 1, 7), "month").alias("month_ok"))


def _workload_dims(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "workload_record").withColumn("_d", records.dimensions_of("dimensions"))


def dimension_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels by dimension, and whether they are the ones their raw values imply (R4 and R5)."""
    w = _workload_dims(spark, d).select(F.explode(F.map_entries("_d")).alias("e")).select(F.col("e.key").alias("code"), F.col("e.value.level").alias("level"), F.expr("try_cast(e.value.raw as int)").alias("n"))
    implied = F.when(F.col("code") == "R4", dim.r4_level(F.col("n"))).when(F.col("code") == "R5", dim.r5_level(F.col("n")))
    return w.groupBy("code", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(implied.isNotNull() & F.col("level").isNotNull() & (implied != F.col("level"))).alias("inconsistent"))


def crossed_groups(spark: SparkSession, d: str) -> DataFrame:
    w = _workload_dims(spark, d).select(*[F.expr(f"try_element_at(_d, '{k}').level").alias(k) for k in ("R4", "R5")])
    return w.select(dim.crossed_group({"R5": F.col("R5"), "R4": F.col("R4")}).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def r3_bands(spark: SparkSession, d: str) -> DataFrame:
    months = dim.months_after(F.to_date("o_orderdate"), F.lit("1995-06-17").cast("date"))
    return load(spark, d, "orders").select(dim.r3_level(months).alias("band"), months.alias("m")).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 9).alias("months"))


def _popularity(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).cast("double").alias("f"))


def r1_tertiles(spark: SparkSession, d: str) -> DataFrame:
    """Parts by tertile of their number of line items."""
    p = _popularity(spark, d)
    tail, middle = select.tertiles(p, "f")
    return p.select(dim.r1_level(F.col("f"), tail, middle).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("tail_max", F.round(F.lit(tail), 9)).withColumn("middle_max", F.round(F.lit(middle), 9))


def r6_levels(spark: SparkSession, d: str) -> DataFrame:
    """Specificity levels of the raw R6 values of the workloads."""
    w = _workload_dims(spark, d).select(F.expr("try_cast(try_element_at(_d, 'R6').raw as double)").alias("x"))
    return w.select(dim.r6_level(F.col("x")).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Orders as chains of their line items: right, conf arrays and the outcome of the chain; orders without items are no chains."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != "R").cast("int").alias("right"), (((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 101) / F.lit(100.0)).alias("conf"))
    a = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "right", "conf"))).alias("a"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") != "P").cast("int").alias("chain_right"))
    return a.join(o, "l_orderkey").select("l_orderkey", F.col("a.right").alias("right"), F.col("a.conf").alias("conf"), "chain_right", F.size("a").alias("depth"))


_CH = """ch AS (SELECT l_orderkey, count(*) d, sum(r) k, min(r) every, exp(sum(ln(greatest(c, 1e-300)))) pr, min(c) mc, greatest(0, 1 - sum(1 - c)) ub, any_value(y) y FROM (
  SELECT l_orderkey, (l_returnflag <> 'R')::INT r, ((l_orderkey * 31 + l_linenumber * 17) % 101) / 100.0::DOUBLE c, (o_orderstatus <> 'P')::INT y FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY l_orderkey)"""


def chain_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Scored constituents of the workloads in their order: how many of each depth are complete, and their mean accuracy."""
    w = load(spark, d, "workload_record").select("row_id", F.transform("constituent_example_ids", lambda c: F.lower(F.trim(c))).alias("atoms")).where(F.size("atoms") > 0)
    s = scored(spark, d).select(_trim("example_id").alias("key"), "y").groupBy("key").agg(F.max("y").alias("y"))
    got = composition.chain_atoms(w, "row_id", "atoms", s, "key", ["y"])
    mean = F.aggregate("y", F.lit(0.0), lambda a, x: a + x) / F.col("depth")
    return rounded(got.groupBy("depth").agg(F.count(F.lit(1)).alias("chains"), F.avg(mean).alias("accuracy")))


def missing_atoms(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "workload_record").select("row_id", F.transform("constituent_example_ids", lambda c: F.lower(F.trim(c))).alias("atoms")).where(F.size("atoms") > 0)
    s = scored(spark, d).select(_trim("example_id").alias("key")).distinct()
    return composition.missing_atoms(w, "row_id", "atoms", s, "key").groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("chains"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "example_record").withColumn("fact", F.array(F.lower(F.get_json_object("metadata", "$.source_fact_id")))).withColumn("qhash", F.array(F.lower(F.get_json_object("metadata", "$.question_hash"))))
    return lineage.lineage_tokens(e, "row_id", {"source_fact_id": "fact", "question_hash": "qhash"})


def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that occur in more than one declared split, by kind and number of splits."""
    splits = load(spark, d, "example_record").select(F.col("row_id").alias("row"), _trim("split").alias("split")).where("split is not null")
    return lineage.split_leakage(_tokens(spark, d), splits).groupBy("key", F.size("splits").alias("splits")).agg(F.count(F.lit(1)).alias("n"))


def assign_splits(spark: SparkSession, d: str) -> DataFrame:
    """Split of every example that has a lineage value, linked by fact and question hash."""
    tokens = _tokens(spark, d)
    rows = tokens.select(F.col("row").alias("row_id")).distinct()
    return lineage.assign_splits(rows, "row_id", tokens).select("row", "component", "split")


def closure(spark: SparkSession, d: str) -> DataFrame:
    """Examples reachable from the workloads with constituents, by number of steps."""
    w = load(spark, d, "workload_record").select(_trim("example_id").alias("parent"), "constituent_example_ids")
    edges = w.select("parent", F.explode("constituent_example_ids").alias("c")).select("parent", F.lower(F.trim("c")).alias("child")).where("parent is not null and child != ''").distinct()
    start = w.where(F.size("constituent_example_ids") > 0).select(F.col("parent").alias("id")).where("id is not null")
    return lineage.closure(start, edges).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def exclude_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Examples excluded because their question, in its most frequent wording per fact, crosses splits; blanks and placeholder words are no facts."""
    e = load(spark, d, "example_record").withColumn("fact", F.get_json_object("metadata", "$.source_fact_id"))
    e = e.select(_trim("fact").alias("step"), F.col("row_id").alias("parent"), _trim("split").alias("split"), F.lower("question").alias("question"))
    known = (F.col("step") != "") & ~F.col("step").isin(NO_ID)
    return lineage.exclude_crossing(e.where(known & F.col("split").isNotNull() & F.col("question").isNotNull())).groupBy("round").agg(F.count(F.lit(1)).alias("n"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Count, accuracy and mean score by source and depth of the example's workload, with totals."""
    w = _workload_dims(spark, d).select(_trim("example_id").alias("k"), "row_id", F.expr("try_element_at(_d, 'R5').level").alias("r5")).groupBy("k").agg(F.min_by("r5", "row_id").alias("r5"))
    e = _first_examples(spark, d).select("k", F.get_json_object("metadata", "$.dataset_id").alias("dataset"))
    s = scored(spark, d).withColumn("k", _trim("example_id")).join(e, "k").join(w, "k")
    return rounded(s.rollup("dataset", "r5").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("accuracy"), F.avg("conf").alias("mean_score"), F.grouping_id().alias("g")))


def r1r5_cells(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by popularity tertile of the part and depth of the order, and whether the cell has 75 rows."""
    p = _popularity(spark, d)
    tail, middle = select.tertiles(p, "f")
    pop = p.select("l_partkey", dim.r1_level(F.col("f"), tail, middle).alias("r1"))
    depth = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("m")).select("l_orderkey", dim.r5_level(F.col("m")).alias("r5"))
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_returnflag") != "R").cast("int").alias("y")).join(pop, "l_partkey").join(depth, "l_orderkey")
    return rounded(li.groupBy("r1", "r5").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("accuracy")).withColumn("supported", F.col("n") >= 75))


#: What a certificate must record as true before it may claim coverage.
ASSUMPTIONS = ["calibration_test_exchangeable", "calibration_only_fitting", "scoring_rule_fixed", "true_label_in_fixed_candidate_universe", "coverage_procedure_valid_for_r7_policy"]


def _assumptions_hold(spark: SparkSession, d: str) -> DataFrame:
    """``row_id, hold`` of every certificate with recorded assumptions: all required ones are true and no recorded one is false."""
    a = certificate_children(certificate_store(spark, d))
    yes = F.count_distinct(F.when((F.col("child_value") == "true") & F.col("child_key").isin(ASSUMPTIONS), F.col("child_key")))
    return a.groupBy("row_id").agg(((yes == len(ASSUMPTIONS)) & ~F.bool_or(F.col("child_value") == "false")).alias("hold"))


def certificates(spark: SparkSession, d: str) -> DataFrame:
    """What the certificates may claim, by their recorded fields and assumptions; an assumption that is not recorded does not hold."""
    p = load(spark, d, "read_certificate").select("row_id", F.try_parse_json("payload").alias("j"))
    get = lambda k, t: F.try_variant_get("j", f"$.{k}", t)
    c = p.where("j is not null").select("row_id", get("evaluation_track", "string").alias("track"), get("calibration_supported", "boolean").alias("ok"), get("coverage_scope", "string").alias("scope"))
    c = c.join(_assumptions_hold(spark, d), "row_id", "left")
    return c.select(records.guarantee_status(F.col("track"), F.col("ok"), F.col("hold"), F.col("scope")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def linkage(spark: SparkSession, d: str) -> DataFrame:
    """Problems between read results, generations and workloads, counted."""
    first = lambda t, k: load(spark, d, t).where(f"{k} is not null").groupBy(k).agg(F.min_by(F.struct("*"), "row_id").alias("r")).select("r.*")
    bad = records.linkage(load(spark, d, "read_result_record"), first("generation_record", "generation_id"), first("workload_record", "example_id"))
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def domain_transfer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(composition.domain_transfer(scored(spark, d), "conf", "y", F.col("track") == "finite_label_certified"))


def transfer_gain(spark: SparkSession, d: str) -> DataFrame:
    t = scored(spark, d).withColumn("shrunk", 0.5 + (F.col("conf") - 0.5) / 2)
    return rounded(composition.transfer_gain(t, "conf", "shrunk", "y", F.col("track") == "finite_label_certified"))


_CHAIN_PARTS = f"""atm AS (SELECT row_id, o - 1 AS pos, len(cs) d, lower(trim(cs[o])) k FROM (SELECT row_id, constituent_example_ids cs, unnest(range(1, len(constituent_example_ids) + 1)) o FROM workload_record)),
 sk AS (SELECT {_sqltrim('example_id')} k, max(y) y FROM sc GROUP BY 1)"""
_DIMS = """dm AS (SELECT row_id, example_id, c, arg_min(v, o) v FROM (SELECT row_id, example_id, o, v, CASE regexp_replace(lower(trim(k)), '[\\s-]+', '_', 'g') WHEN 'r1' THEN 'R1' WHEN 'r2' THEN 'R2' WHEN 'precision_requirement' THEN 'R2' WHEN 'r3' THEN 'R3'
  WHEN 'r4' THEN 'R4' WHEN 'query_ambiguity' THEN 'R4' WHEN 'r5' THEN 'R5' WHEN 'synthesis_depth' THEN 'R5' WHEN 'r6' THEN 'R6' WHEN 'domain_specificity' THEN 'R6' END c
  FROM (SELECT row_id, example_id, unnest(range(len(map_keys(dimensions)))) o, unnest(map_keys(dimensions)) k, unnest(map_values(dimensions)) v FROM workload_record)) WHERE c IS NOT NULL GROUP BY row_id, example_id, c),
 dl AS (SELECT row_id, example_id, c, regexp_replace(lower(trim(v.level)), '[ -]', '_', 'g') l, try_cast(v.raw AS INT) n, try_cast(v.raw AS DOUBLE) x FROM dm)"""
_TERT = """pf AS (SELECT l_partkey, count(*)::DOUBLE f FROM lineitem GROUP BY 1), so AS (SELECT list_sort(list(f)) s, count(*) n FROM pf),
 ct AS (SELECT (s[((n-1)//3)+1] * (3 - (n-1)%3) + s[least((n-1)//3+1, n-1)+1] * ((n-1)%3)) / 3 a, (s[(2*(n-1)//3)+1] * (3 - 2*(n-1)%3) + s[least(2*(n-1)//3+1, n-1)+1] * (2*(n-1)%3)) / 3 b FROM so),
 pl AS (SELECT l_partkey, CASE WHEN f <= a THEN 'tail' WHEN f <= b THEN 'middle' ELSE 'head' END r1, a, b FROM pf, ct)"""
_PANEL = "count(*) FILTER ({0}) AS {1}_n, round(avg(y) FILTER ({0}), 9) AS {1}_accuracy"

QUERIES = {
    "normalize_ascii": lambda s, d: load(s, d, "part").select("p_partkey", text.normalize_ascii(F.concat_ws(" - the ", "p_name", "p_type")).alias("t")),
    "token_f1_ascii": lambda s, d: rounded(load(s, d, "part").select("p_partkey", text.token_f1_ascii(F.concat_ws(" ", "p_type", "p_name"), F.col("p_type")).alias("f1"))),
    "question_hash_ascii": lambda s, d: load(s, d, "part").select("p_partkey", text.question_hash_ascii(F.concat_ws("  ", "p_name", "p_brand")).alias("h")),
    "normalize_answer": lambda s, d: load(s, d, "example_record").select("row_id", text.normalized(F.col("question")).alias("t")),
    "unique_answers": lambda s, d: load(s, d, "example_record").select("row_id", F.array_join(text.unique_strings("accepted_answers"), "|").alias("answers")),
    "condition_hashes": lambda s, d: load(s, d, "read_certificate").select("row_id", text.canonical_hash("payload").alias("h")),
    "exact_match": exact_match,
    "token_f1": token_f1,
    "question_hash": lambda s, d: load(s, d, "example_record").select("row_id", text.question_hash("question").alias("h")),
    "sig_digits": lambda s, d: _numbers(s, d).select("row_id", "t", numeric.significant_digits(F.col("t")).alias("digits")),
    "numeric_match": numeric_match,
    "date_match": date_match,
    "hash_split": lambda s, d: load(s, d, "example_record").where("example_id is not null").select("row_id", numeric.hash_split(F.col("example_id"), seed=7).alias("split")),
    "dimension_levels": dimension_levels,
    "crossed_groups": crossed_groups,
    "r1_tertiles": r1_tertiles,
    "r3_bands": r3_bands,
    "r6_levels": r6_levels,
    "ambiguity": lambda s, d: rounded(composition.agreement(load(s, d, "events"), "user_id", "event_type", ["view", "click", "purchase"])),
    "composition": lambda s, d: rounded(composition.composition_report(_chains(s, d), "right", "chain_right", "conf", ["depth"])),
    "factorized": lambda s, d: rounded(composition.factorized(_chains(s, d), "right", "chain_right")),
    "chain_atoms": chain_atoms,
    "missing_atoms": missing_atoms,
    "domain_transfer": domain_transfer,
    "transfer_gain": transfer_gain,
    "rater_agreement": lambda s, d: rounded(composition.rater_agreement(load(s, d, "reading_label"), "doc_id", "band")),
    "preferred_variant": lambda s, d: composition.preferred(load(s, d, "example_record").where("split is not null").withColumn("k", _trim("split")), "k", "split"),
    "split_leakage": split_leakage,
    "assign_splits": assign_splits,
    "closure": closure,
    "exclude_crossing": exclude_crossing,
    "anti_missing": lambda s, d: lineage.id_difference(load(s, d, "example_record").select("example_id").where("example_id is not null"), load(s, d, "workload_record").select("example_id").where("example_id is not null"), "example_id").groupBy("side").agg(F.count(F.lit(1)).alias("n")),
    "run_summary": run_summary,
    "r1r5_cells": r1r5_cells,
    "topk_hash_sample": lambda s, d: select.top_per_level(load(s, d, "customer"), ["c_mktsegment"], "c_name", 20, 7).select("c_custkey", "c_mktsegment", "rank"),
    "quota_sample": lambda s, d: select.quota_sample(load(s, d, "customer"), "c_mktsegment", "c_name", 52).select("c_custkey", "c_mktsegment"),
    "round_robin_sample": lambda s, d: select.round_robin_sample(load(s, d, "orders").withColumn("k", F.col("o_orderkey").cast("string")), "o_orderstatus", ["P", "O", "F"], "k", 50).select("o_orderkey", "o_orderstatus", "turn"),
    "workload_violations": lambda s, d: records.violation_counts(records.workload_violations(load(s, d, "workload_record"))),
    "generation_violations": lambda s, d: records.violation_counts(records.generation_violations(load(s, d, "generation_record"))),
    "result_violations": lambda s, d: records.violation_counts(records.result_violations(load(s, d, "read_result_record"))),
    "linkage": linkage,
    "certificate_guarantee": certificates,
}

_E1 = f"e1 AS (SELECT {_sqltrim('example_id')} k, arg_min(accepted_answers, row_id) aa, arg_min(metadata, row_id) m FROM example_record WHERE {_sqltrim('example_id')} <> '' GROUP BY 1)"
_NUMS = "nu AS (SELECT DISTINCT row_id, regexp_extract(a, '^(-?[0-9]+(?:\\.[0-9]+)?)(?: |$)', 1) t FROM (SELECT row_id, unnest(accepted_answers) a FROM example_record) WHERE regexp_extract(a, '^(-?[0-9]+(?:\\.[0-9]+)?)(?: |$)', 1) <> '')"
_ECE2 = "ep AS (SELECT p, sum(n * abs(c - a)) / sum(n) v FROM (SELECT {p} p, least(floor({c} * 10), 9) b, count(*) n, avg({c}) c, avg(y) a FROM sc GROUP BY ALL) GROUP BY p)"
_SHARED = ["run_id", "example_id", "model_snapshot_id", "condition_hash", "track", "score", "score_kind", "score_source", "calibrator_id", "normalization_contract"]
_SCORE_BAD = [
    ("score", "score IS NULL OR isnan(score) OR isinf(score)"),
    ("score_kind", "score_kind IS NULL OR score_kind NOT IN ('raw', 'probability', 'legacy_probability')"),
    ("probability_range", "coalesce(score_kind = 'probability', false) AND NOT coalesce(score BETWEEN 0 AND 1 AND NOT isnan(score), false)"),
    ("calibrator_id", "coalesce(score_kind = 'probability', false) AND coalesce(trim(calibrator_id), '') = ''"),
]


def _counts(table: str, checks: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{v}' AS violation, count(*) FILTER ({sql}) AS n FROM {table}" for v, sql in checks) + ") WHERE n > 0"


_BAD_ACTIONS = "coalesce(len(allowed_actions), 0) = 0 OR len(list_distinct(allowed_actions)) <> len(allowed_actions) OR len(list_filter(allowed_actions, lambda x: x NOT IN ('answer', 'set', 'abstain'))) > 0 OR NOT list_contains(allowed_actions, 'abstain')"

ORACLES = {
    "normalize_ascii": f"SELECT p_partkey, {_NORM.format("p_name || ' - the ' || p_type")} AS t FROM part",
    "token_f1_ascii": f"""WITH g AS (SELECT p_partkey, list_filter(string_split({_NORM.format("p_type || ' ' || p_name")}, ' '), lambda x: x <> '') p, list_filter(string_split({_NORM.format('p_type')}, ' '), lambda x: x <> '') r FROM part),
 b AS (SELECT p_partkey, len(p) lp, len(r) lr, coalesce(list_sum([least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda x: x = t))) FOR t IN list_distinct(list_intersect(p, r))]), 0) o FROM g)
 SELECT p_partkey, CASE WHEN o > 0 THEN round(2.0::DOUBLE * o / (lp + lr), 9) ELSE 0 END AS f1 FROM b""",
    "question_hash_ascii": "SELECT p_partkey, sha256(trim(regexp_replace(lower(p_name || '  ' || p_brand), '\\s+', ' ', 'g'))) AS h FROM part",
    "sig_digits": f"WITH {_NUMS} SELECT row_id, t, CASE WHEN length(ltrim(replace(replace(t, '-', ''), '.', ''), '0')) > 0 THEN length(ltrim(replace(replace(t, '-', ''), '.', ''), '0')) ELSE greatest(1, length(split_part(t, '.', 2))) END AS digits FROM nu",
    "numeric_match": f"WITH {_NUMS} SELECT row_id, t, abs(t::DECIMAL(20,4) - round(t::DECIMAL(20,4), 0)) <= 0.4 AS m FROM nu",
    "date_match": """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') s FROM orders), b AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN substr(s, 1, 8) || '31' WHEN o_orderkey % 7 = 1 THEN replace(s, '-0', '-') ELSE s END b FROM o)
 SELECT o_orderkey, regexp_full_match(b, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(b AS DATE) IS NOT NULL AND (b = s OR b = substr(s, 1, 8) || '01') AS m, regexp_full_match(substr(b, 1, 7), '\\d{4}-\\d{2}') AND try_cast(substr(b, 1, 7) || '-01' AS DATE) IS NOT NULL AS month_ok FROM b""",
    "hash_split": "SELECT row_id, CASE WHEN x < 0.2::DOUBLE THEN 'development' WHEN x < 0.5::DOUBLE THEN 'calibration' ELSE 'test' END AS split FROM (SELECT row_id, ('0x' || substr(sha256('7:' || example_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 x FROM example_record WHERE example_id IS NOT NULL)",
    "dimension_levels": f"""WITH {_DIMS} SELECT c AS code, l AS level, count(*) AS n, count(*) FILTER (l IS NOT NULL AND l <> CASE WHEN c = 'R4' THEN CASE WHEN n = 1 THEN 'unambiguous' WHEN n = 2 THEN 'two_way' WHEN n >= 3 THEN 'three_plus' END
 WHEN c = 'R5' THEN CASE WHEN n = 1 THEN 'one_hop' WHEN n = 2 THEN 'two_hop' WHEN n = 3 THEN 'three_hop' WHEN n >= 4 THEN 'four_plus_hop' END END) AS inconsistent FROM dl GROUP BY ALL""",
    "crossed_groups": f"WITH {_DIMS} SELECT 'R5=' || a.l || '|R4=' || b.l AS cell, count(*) AS n FROM dl a JOIN dl b ON a.row_id = b.row_id AND a.c = 'R5' AND b.c = 'R4' WHERE a.l IS NOT NULL AND b.l IS NOT NULL GROUP BY 1",
    "r1_tertiles": f"WITH {_TERT} SELECT r1 AS level, count(*) AS n, round(any_value(a), 9) AS tail_max, round(any_value(b), 9) AS middle_max FROM pl GROUP BY 1",
    "r3_bands": "SELECT CASE WHEN m <= 0 THEN 'pre_cutoff' WHEN m <= 3 THEN 'post_0_3_months' WHEN m <= 12 THEN 'post_4_12_months' ELSE 'post_13_plus_months' END AS band, count(*) AS n, round(avg(m), 9) AS months FROM (SELECT date_diff('day', DATE '1995-06-17', o_orderdate::DATE) / (365.2425::DOUBLE / 12) m FROM orders) GROUP BY 1",
    "r6_levels": f"WITH {_DIMS} SELECT CASE WHEN x < 0 OR x > 1 THEN NULL WHEN x <= 0.33::DOUBLE THEN 'general' WHEN x <= 0.66::DOUBLE THEN 'specialized' WHEN x IS NOT NULL THEN 'expert' END AS level, count(*) AS n FROM workload_record w LEFT JOIN (SELECT row_id, x FROM dl WHERE c = 'R6') USING (row_id) GROUP BY 1",
    "ambiguity": """WITH c AS (SELECT user_id, event_type, count(*) c FROM events GROUP BY ALL) SELECT user_id, sum(c)::BIGINT AS n, round(sum(c) FILTER (event_type IN ('view', 'click', 'purchase')) / sum(c), 9) AS valid_rate, count(*) AS classes,
 CASE WHEN sum(c) > 1 THEN round(sum(c * (c - 1) // 2) / (sum(c) * (sum(c) - 1) / 2), 9) END AS idempotency FROM c GROUP BY user_id""",
    "composition": f"""WITH {_CH} SELECT d::INT AS depth, count(*) AS n, round(avg(y), 9) AS chain_accuracy, round(avg(every), 9) AS all_atoms_correct, round(avg(y) FILTER (every = 1), 9) AS accuracy_given_atoms, round(avg(CASE WHEN mc <= 0 THEN 0 ELSE pr END), 9) AS mean_product,
 round(avg(ub), 9) AS mean_union_bound, round(1 - avg(y) FILTER (every = 1), 9) AS synthesis_loss, round(avg(CASE WHEN mc <= 0 THEN 0 ELSE pr END) - avg(y), 9) AS product_gap FROM ch GROUP BY 1""",
    "factorized": f"""WITH {_CH}, a AS (SELECT sum(k) / sum(d)::DOUBLE acc, avg(d) dep, 1 - avg(y) err FROM ch), e AS (SELECT avg(1 - acc ** d) ex, avg(least(1, d * (1 - acc))) ub FROM ch, a)
 SELECT round(acc, 9) AS atomic_accuracy, round(dep, 9) AS mean_depth, round(err, 9) AS chain_error, round(ex, 9) AS expected_error, round(ub, 9) AS union_bound_error, round(err - ex, 9) AS residual, abs(err - ex) <= 0.05 AS within_band FROM a, e""",
    "chain_atoms": f"WITH {SC}, {_CHAIN_PARTS}, f AS (SELECT row_id, d, count(y) c, avg(y) m FROM atm LEFT JOIN sk USING (k) GROUP BY ALL) SELECT d::INT AS depth, count(*) AS chains, round(avg(m), 9) AS accuracy FROM f WHERE c = d GROUP BY 1",
    "missing_atoms": f"WITH {SC}, {_CHAIN_PARTS} SELECT pos::INT AS pos, count(*) AS n, count(DISTINCT row_id) AS chains FROM atm WHERE k NOT IN (SELECT k FROM sk WHERE k IS NOT NULL) OR k IS NULL GROUP BY 1",
    "domain_transfer": f"""WITH {SC}, {_ECE2.format(p="track = 'finite_label_certified'", c='conf')}, z AS (SELECT {_PANEL.format("track = 'finite_label_certified'", 'source')}, avg((conf-y)**2) FILTER (track = 'finite_label_certified') sb,
 {_PANEL.format("track <> 'finite_label_certified'", 'target')}, avg((conf-y)**2) FILTER (track <> 'finite_label_certified') tb, (SELECT v FROM ep WHERE p) se, (SELECT v FROM ep WHERE NOT p) te FROM sc)
 SELECT source_n, source_accuracy, round(se, 9) AS source_ece, round(sb, 9) AS source_brier, target_n, target_accuracy, round(te, 9) AS target_ece, round(tb, 9) AS target_brier, round(te - se, 9) AS ece_increase, round(tb - sb, 9) AS brier_increase FROM z""",
    "transfer_gain": f"""WITH {SC}, w AS (SELECT track = 'finite_label_certified' p, y, conf b, 0.5::DOUBLE + (conf - 0.5::DOUBLE) / 2 k FROM sc),
 eb AS (SELECT p, sum(n * abs(c - a)) / sum(n) v FROM (SELECT p, least(floor(b * 10), 9) i, count(*) n, avg(b) c, avg(y) a FROM w GROUP BY ALL) GROUP BY p),
 ek AS (SELECT p, sum(n * abs(c - a)) / sum(n) v FROM (SELECT p, least(floor(k * 10), 9) i, count(*) n, avg(k) c, avg(y) a FROM w GROUP BY ALL) GROUP BY p),
 g AS (SELECT p, count(*) n, any_value(eb.v) - any_value(ek.v) e, avg((b - y) ** 2) - avg((k - y) ** 2) r FROM w JOIN eb USING (p) JOIN ek USING (p) GROUP BY p)
 SELECT i.n AS within_n, round(i.e, 9) AS within_ece_gain, round(i.r, 9) AS within_brier_gain, x.n AS cross_n, round(x.e, 9) AS cross_ece_gain, round(x.r, 9) AS cross_brier_gain, round(i.e - x.e, 9) AS ece_advantage, round(i.r - x.r, 9) AS brier_advantage
 FROM g i, g x WHERE i.p AND NOT x.p""",
    "linkage": f"""WITH g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY generation_id ORDER BY row_id) rn FROM generation_record WHERE generation_id IS NOT NULL) WHERE rn = 1),
 w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY row_id) rn FROM workload_record WHERE example_id IS NOT NULL) WHERE rn = 1),
 j AS (SELECT r.*, g.generation_id gid, w.example_id wid, w.track wt, {', '.join(f'g.{c} g_{c}' for c in _SHARED)} FROM read_result_record r LEFT JOIN g ON g.generation_id = r.generation_id LEFT JOIN w ON w.example_id = r.example_id)
 SELECT * FROM (SELECT 'generation missing' AS problem, count(*) FILTER (gid IS NULL) AS n FROM j UNION ALL SELECT 'workload missing', count(*) FILTER (wid IS NULL) FROM j
 UNION ALL SELECT 'workload: track', count(*) FILTER (wid IS NOT NULL AND track IS DISTINCT FROM wt) FROM j
 {' '.join(f"UNION ALL SELECT 'generation: {c}', count(*) FILTER (gid IS NOT NULL AND {c} IS DISTINCT FROM g_{c}) FROM j" for c in _SHARED)}) WHERE n > 0""",
    "rater_agreement": """WITH g AS (SELECT doc_id, count(*) n, count(DISTINCT band) k FROM reading_label GROUP BY 1 HAVING count(*) > 1), s AS (SELECT doc_id, sum(c * (c - 1) // 2) s FROM (SELECT doc_id, band, count(*) c FROM reading_label GROUP BY ALL) GROUP BY 1)
 SELECT count(*) AS items, round(avg((k = 1)::INT), 9) AS unanimous, round(avg(s / (n * (n - 1) / 2)), 9) AS pairwise FROM g JOIN s USING (doc_id)""",
    "preferred_variant": f"WITH c AS (SELECT {_sqltrim('split')} k, split, count(*) n FROM example_record WHERE split IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(split), lower(split), split) o, count(*) OVER (PARTITION BY k) variants FROM c) SELECT k, split AS preferred, variants FROM r WHERE o = 1",
    "split_leakage": f"""WITH t AS (SELECT 'source_fact_id' key, lower(metadata->>'$.source_fact_id') v, {_sqltrim('split')} s FROM example_record UNION ALL SELECT 'question_hash', lower(metadata->>'$.question_hash'), {_sqltrim('split')} FROM example_record),
 l AS (SELECT key, trim(v) v, count(DISTINCT s) s FROM t WHERE trim(v) <> '' AND s IS NOT NULL GROUP BY ALL HAVING count(DISTINCT s) > 1) SELECT key, s::INT AS splits, count(*) AS n FROM l GROUP BY ALL""",
    "closure": f"""WITH RECURSIVE w AS (SELECT {_sqltrim('example_id')} p, constituent_example_ids c FROM workload_record), e AS (SELECT DISTINCT p, lower(trim(x)) x FROM (SELECT p, unnest(c) x FROM w) WHERE p IS NOT NULL AND lower(trim(x)) <> ''),
 r(id, d) AS (SELECT DISTINCT p, 0 FROM w WHERE len(c) > 0 AND p IS NOT NULL UNION SELECT e.x, d + 1 FROM r JOIN e ON e.p = r.id WHERE d < 50 AND NOT EXISTS (SELECT 1 FROM w w2 WHERE len(w2.c) > 0 AND w2.p = e.x))
 SELECT depth, count(*) AS n FROM (SELECT id, min(d)::INT AS depth FROM r GROUP BY id) GROUP BY depth""",
    "anti_missing": """SELECT 'missing' AS side, count(*) AS n FROM (SELECT DISTINCT example_id FROM example_record WHERE example_id IS NOT NULL AND example_id NOT IN (SELECT example_id FROM workload_record WHERE example_id IS NOT NULL))
 UNION ALL SELECT 'unexpected', count(*) FROM (SELECT DISTINCT example_id FROM workload_record WHERE example_id IS NOT NULL AND example_id NOT IN (SELECT example_id FROM example_record WHERE example_id IS NOT NULL)) HAVING count(*) > 0""",
    "run_summary": f"""WITH {SC}, {_DIMS}, {_E1}, w AS (SELECT {_sqltrim('w.example_id')} k, arg_min(coalesce(l, '\x01'), w.row_id) l FROM workload_record w LEFT JOIN (SELECT row_id, l FROM dl WHERE c = 'R5') USING (row_id) GROUP BY 1),
 j AS (SELECT e1.m->>'$.dataset_id' dataset, nullif(w.l, '\x01') r5, y, conf FROM sc JOIN e1 ON e1.k = {_sqltrim('sc.example_id')} JOIN w ON w.k = e1.k)
 SELECT dataset, r5, count(*) AS n, round(avg(y), 9) AS accuracy, round(avg(conf), 9) AS mean_score, grouping(dataset, r5) AS g FROM j GROUP BY ROLLUP (dataset, r5)""",
    "r1r5_cells": f"""WITH {_TERT}, o AS (SELECT l_orderkey, count(*) m FROM lineitem GROUP BY 1) SELECT r1, CASE m WHEN 1 THEN 'one_hop' WHEN 2 THEN 'two_hop' WHEN 3 THEN 'three_hop' ELSE 'four_plus_hop' END AS r5, count(*) AS n, round(avg((l_returnflag <> 'R')::INT), 9) AS accuracy, count(*) >= 75 AS supported
 FROM lineitem JOIN pl USING (l_partkey) JOIN o USING (l_orderkey) GROUP BY 1, 2""",
    "topk_hash_sample": "SELECT c_custkey, c_mktsegment, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_name), c_name) r FROM customer) WHERE r <= 20",
    "quota_sample": """WITH l AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 i, count(*) OVER () k FROM (SELECT DISTINCT c_mktsegment FROM customer)),
 r AS (SELECT c.*, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_name), c_name) <= 52 // k + (i < 52 % k)::INT inq FROM customer c JOIN l USING (c_mktsegment)) SELECT c_custkey, c_mktsegment FROM r ORDER BY inq DESC, sha256(c_name), c_name LIMIT 52""",
    "round_robin_sample": "SELECT o_orderkey, o_orderstatus, turn::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey::VARCHAR) turn FROM orders WHERE o_orderstatus IN ('P', 'O', 'F')) ORDER BY turn, list_position(['P', 'O', 'F'], o_orderstatus) LIMIT 50",
    "generation_violations": _counts(
        "generation_record",
        [(c, f"coalesce(trim({c}), '') = ''") for c in ("generation_id", "run_id", "example_id", "model_snapshot_id", "score_source")]
        + [("condition_hash", "NOT coalesce(regexp_full_match(lower(condition_hash), '[0-9a-f]{64}'), false)"), ("track", "track IS NULL OR track NOT IN ('finite_label_certified', 'open_ended_stress')")]
        + _SCORE_BAD,
    ),
    "result_violations": _counts(
        "read_result_record",
        _SCORE_BAD
        + [
            ("policy_level", "NOT coalesce(policy_level = CASE WHEN abs(threshold - 0.5) <= 1e-12 THEN 'tau_0_50' WHEN abs(threshold - 0.7) <= 1e-12 THEN 'tau_0_70' WHEN abs(threshold - 0.9) <= 1e-12 THEN 'tau_0_90' WHEN abs(threshold - 0.95) <= 1e-12 THEN 'tau_0_95' WHEN abs(threshold - 0.99) <= 1e-12 THEN 'tau_0_99' END, false)"),
            ("normalization_contract", "coalesce(score_kind = 'raw', false) AND coalesce(trim(normalization_contract), '') = ''"),
            ("raw_range", "coalesce(score_kind = 'raw', false) AND NOT coalesce(score BETWEEN 0 AND 1 AND NOT isnan(score), false)"),
            ("allowed_actions", _BAD_ACTIONS),
            ("action", "NOT coalesce(list_contains(allowed_actions, action), false)"),
            ("answer", "coalesce(action = 'answer', false) AND (coalesce(trim(answer), '') = '' OR NOT coalesce(list_contains(candidates, answer), false))"),
            ("answer_ambiguity", "coalesce(action = 'answer', false) AND NOT coalesce(ambiguity_complete, false)"),
            ("set", "coalesce(action = 'set', false) AND coalesce(len(candidates), 0) = 0"),
            ("correctness_rule", "coalesce(trim(correctness_rule), '') = ''"),
        ],
    ),
    "certificate_guarantee": f"""WITH {ASM_SQL},
 held AS (SELECT row_id, count(DISTINCT k) FILTER (t IN ('true','yes','1','1.0') AND k IN ({', '.join(f"'{a}'" for a in ASSUMPTIONS)})) = {len(ASSUMPTIONS)} AND NOT bool_or(t IN ('false','no','0','0.0')) hold
  FROM asm WHERE k <> '' AND t IN ('true','yes','1','1.0','false','no','0','0.0') GROUP BY row_id),
 j AS (SELECT row_id, payload::JSON j FROM read_certificate WHERE json_valid(payload)) SELECT CASE WHEN j->>'$.evaluation_track' = 'open_ended_stress' THEN 'none_open_ended_generated_candidates'
 WHEN NOT coalesce(try_cast(j->>'$.calibration_supported' AS BOOLEAN), false) THEN 'none_unsupported_calibration' WHEN NOT coalesce(hold, false) THEN 'none_assumptions_not_satisfied'
 WHEN j->>'$.coverage_scope' IS NULL THEN 'none_not_claimed' WHEN j->>'$.coverage_scope' = 'marginal' THEN 'finite_label_marginal_under_recorded_assumptions'
 ELSE 'finite_label_group_marginal_under_recorded_assumptions' END AS status, count(*) AS n FROM j LEFT JOIN held USING (row_id) GROUP BY 1""",
}
