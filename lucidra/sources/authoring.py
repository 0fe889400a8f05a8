"""Hand-written records: validation row by row, quarantine of the rest, and the gates a collection must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucidra.functions.dimensions import DIMENSIONS
from lucidra.operators.composition import rater_agreement

SCHEMA = (
    "example_id string, family_id string, dimension string, question string, accepted_answers array<string>, interpretation_answers map<string,array<string>>, adjudicated_level string, "
    "adjudication_status string, independent_labels map<string,string>, adjudicator_id string, author_id string, contributor_consent boolean, domain_name string, template_id string, "
    "expertise_prerequisite string, expertise_rationale string, precision_answer_type string, numeric_tolerance double, entity_id array<string>, source_fact_id array<string>, source_urls array<string>, source_licenses array<string>"
)
REQUIRED = ["example_id", "family_id", "question", "author_id", "template_id", "domain_name", "expertise_rationale", "expertise_prerequisite"]


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _error() -> Column:
    """The first rule a record breaks, in a fixed order."""
    d, level = F.col("dimension"), F.col("adjudicated_level")
    accepted = F.coalesce(F.col("adjudication_status") == "accepted", F.lit(False))
    answers, interp = F.col("accepted_answers"), F.coalesce(F.col("interpretation_answers"), F.create_map().cast("map<string,array<string>>"))
    union = F.array_distinct(F.flatten(F.map_values(interp)))
    many = F.size(interp)
    levels = F.when(d == "R2", F.array(*map(F.lit, DIMENSIONS["R2"][1]))).when(d == "R4", F.array(*map(F.lit, DIMENSIONS["R4"][1]))).otherwise(F.array(*map(F.lit, DIMENSIONS["R6"][1])))
    implied = F.when(many == 1, "unambiguous").when(many == 2, "two_way").otherwise("three_plus")
    labels = F.coalesce(F.col("independent_labels"), F.create_map().cast("map<string,string>"))
    rules = [
        (~F.coalesce(d.isin("R2", "R4", "R6"), F.lit(False)), "dimension"),
        (~F.coalesce(F.col("adjudication_status").isin("draft", "accepted", "rejected"), F.lit(False)), "adjudication_status"),
        *[(_blank(F.col(c)), c) for c in REQUIRED],
        (F.coalesce(F.size(answers), F.lit(0)) < 1, "accepted_answers"),
        ((F.size(F.array_except(union, answers)) > 0) | (F.size(F.array_except(answers, union)) > 0), "interpretation_union"),
        (~F.coalesce(F.array_contains(levels, level), F.lit(False)), "adjudicated_level"),
        ((d == "R4") & (level != implied), "level_against_interpretations"),
        ((d != "R4") & (many != 1), "one_interpretation"),
        (accepted & (F.size(labels) < 2), "independent_labels"),
        (F.exists(F.map_values(labels), lambda x: ~F.array_contains(levels, x)), "independent_labels"),
        (accepted & _blank(F.col("adjudicator_id")), "adjudicator_id"),
        (accepted & F.coalesce(F.map_contains_key(labels, F.coalesce("adjudicator_id", F.lit(""))), F.lit(False)), "adjudicator_independence"),
        (accepted & ~F.coalesce(F.col("contributor_consent"), F.lit(False)), "contributor_consent"),
        (F.coalesce(F.size("source_urls"), F.lit(0)) != F.coalesce(F.size("source_licenses"), F.lit(0)), "urls_and_licenses"),
        (F.exists(F.coalesce("source_urls", F.array().cast("array<string>")), lambda u: ~u.rlike("^https?://")), "source_urls"),
        ((d == "R6") & (level != "general") & F.lower("domain_name").isin("general", "general_knowledge", "general knowledge"), "named_domain"),
        (F.coalesce(F.col("numeric_tolerance") < 0, F.lit(False)) | ((d == "R2") & F.coalesce(F.col("precision_answer_type") == "numeric", F.lit(False)) & F.col("numeric_tolerance").isNull()), "numeric_tolerance"),
    ]
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in rules])


def load_authored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid records, quarantine with ``line_text, error``) of JSON lines; of equal ids only one is valid."""
    lines = spark.read.text(path).select(F.col("value").alias("line_text"))
    v = F.try_parse_json("line_text")
    broken = F.when(F.trim("line_text") == "", "blank_line").when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "no_object")
    t = lines.select("line_text", broken.alias("_broken"), F.from_json("line_text", SCHEMA).alias("_r")).select("line_text", "_broken", "_r.*")
    t = t.withColumn("error", F.coalesce("_broken", _error()))
    again = F.row_number().over(W.partitionBy("example_id", F.col("error").isNull()).orderBy("line_text"))
    t = t.withColumn("_n", again).withColumn("error", F.when(F.col("error").isNull() & (F.col("_n") > 1), "duplicate_example_id").otherwise(F.col("error"))).drop("_n", "_broken")
    return t.where("error is null").drop("error", "line_text"), t.where("error is not null").select("line_text", "error")


def gates(valid: DataFrame, quarantine: DataFrame) -> DataFrame:
    """``gate, passed``: no errors, something accepted, every level present, families matched across levels, domains complete."""
    ok = valid.where("adjudication_status = 'accepted'")
    rows = [("no_validation_errors", quarantine.isEmpty()), ("has_accepted_rows", not ok.isEmpty())]
    for code in ("R2", "R4", "R6"):
        mine, want = ok.where(F.col("dimension") == code), F.array(*map(F.lit, DIMENSIONS[code][1]))
        seen = mine.agg(F.coalesce(F.size(F.array_except(want, F.collect_set("adjudicated_level"))), F.lit(9)).alias("k")).first().k
        rows.append((f"{code.lower()}_all_levels", seen == 0))
        per = mine.groupBy("domain_name" if code == "R6" else "family_id").agg(F.collect_set("adjudicated_level").alias("s"))
        whole = F.array_contains("s", "unambiguous") & F.arrays_overlap("s", F.array(F.lit("two_way"), F.lit("three_plus"))) if code == "R4" else F.size(F.array_except(want, "s")) == 0
        rows.append((f"{code.lower()}_{'domains' if code == 'R6' else 'families'}_complete", not per.isEmpty() and per.where(~whole).isEmpty()))
    return valid.sparkSession.createDataFrame(rows, "gate string, passed boolean")


def label_agreement(valid: DataFrame) -> DataFrame:
    """Agreement of the independent labels of accepted records."""
    t = valid.where("adjudication_status = 'accepted'").select("example_id", F.explode("independent_labels").alias("rater", "label"))
    return rater_agreement(t, "example_id", "label")


def audit_approved(audit: DataFrame) -> bool:
    """Whether every row of a nonempty audit sample is marked approved and its ids are nonblank and unique."""
    r = audit.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.lower(F.trim("review_status")), F.lit("")) != "approved").alias("open"), F.countDistinct(F.when(F.trim("example_id") != "", F.trim("example_id"))).alias("ids")
    ).first()
    return r.n > 0 and r.open == 0 and r.ids == r.n
