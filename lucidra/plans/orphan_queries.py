"""Queries of problem 3 over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidra.operators.orphans import orphan_references, orphan_report, reference_key
from lucidra.session import load


KEYS = ["example_key", "generation_key"]


def _references(spark: SparkSession, d: str) -> DataFrame:
    """The references of all three child tables as one composite key, of which each table fills its part."""

    def part(table: str, example: Column | None, generation: Column | None, rows: DataFrame | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        keys = [(none if c is None else reference_key(c)).alias(k) for c, k in zip((example, generation), KEYS)]
        rows = load(spark, d, table) if rows is None else rows
        return rows.select(F.struct(F.lit(table).alias("child_table"), "row_id").alias("child"), "created_at", "ingested_at", *keys)

    parts = load(spark, d, "workload_record").select("row_id", "created_at", "ingested_at", F.explode("constituent_example_ids").alias("k"))
    return (
        part("workload_record", F.col("k"), None, parts)
        .unionByName(part("generation_record", F.col("example_id"), None))
        .unionByName(part("read_result_record", None, F.col("generation_id")))
    )


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """What they refer to: examples and generations, each by its own part of the key."""
    none = F.lit(None).cast("string")
    ex = load(spark, d, "example_record").select(reference_key(F.col("example_id")).alias(KEYS[0]), none.alias(KEYS[1]), "ingested_at", "deleted_at")
    gen = load(spark, d, "generation_record").select(none.alias(KEYS[0]), reference_key(F.col("generation_id")).alias(KEYS[1]), "ingested_at", "deleted_at")
    return ex.unionByName(gen)


def _found(spark: SparkSession, d: str) -> DataFrame:
    """``child_table, row_id, created_at, ref_key, ref_state`` of every unresolved reference."""
    got = orphan_references(_references(spark, d), _targets(spark, d), "child", KEYS, KEYS, "ingested_at", "ingested_at", "deleted_at", match="partial", keep=["created_at", *KEYS])
    return got.select("row_id.child_table", "row_id.row_id", "created_at", F.coalesce(*KEYS).alias("ref_key"), "ref_state")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every unresolved reference of the three child tables."""
    return _found(spark, d).select("child_table", "row_id", "ref_key", "ref_state")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """The same per table, month of creation and state."""
    return orphan_report(_found(spark, d), F.col("child_table"), "created_at")


def p3_composite(spark: SparkSession, d: str) -> DataFrame:
    """Read results against generations by (generation_id, example_id, run_id), nulls matching anything (partial rule)."""
    cols = ["generation_id", "example_id", "run_id"]
    child = load(spark, d, "read_result_record").select("row_id", "ingested_at", *[reference_key(F.col(c)).alias(c) for c in cols])
    parent = load(spark, d, "generation_record").select("ingested_at", "deleted_at", *[reference_key(F.col(c)).alias(c) for c in cols])
    return orphan_references(child, parent, "row_id", cols, cols, "ingested_at", "ingested_at", "deleted_at", match="partial")


def _key(col: str) -> str:
    return f"nullif(lower(regexp_replace({col}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"


P3_SQL = f"""
WITH ex AS (SELECT {_key('example_id')} k, ingested_at i, deleted_at x FROM example_record),
ge AS (SELECT {_key('generation_id')} k, ingested_at i, deleted_at x FROM generation_record),
ch AS (
  SELECT DISTINCT * FROM (
    SELECT 'workload_record' child_table, row_id, created_at, ingested_at t, {_key('u')} k, 'e' p
      FROM (SELECT row_id, created_at, ingested_at, unnest(constituent_example_ids) u FROM workload_record)
    UNION ALL SELECT 'generation_record', row_id, created_at, ingested_at, {_key('example_id')}, 'e' FROM generation_record
    UNION ALL SELECT 'read_result_record', row_id, created_at, ingested_at, {_key('generation_id')}, 'g' FROM read_result_record)
  WHERE k IS NOT NULL),
ta AS (SELECT 'e' p, * FROM ex UNION ALL SELECT 'g', * FROM ge),
keys AS (SELECT p, k, min(i) first FROM ta WHERE k IS NOT NULL GROUP BY p, k),
st AS (
  SELECT ch.*, CASE WHEN keys.k IS NULL THEN 'missing' WHEN keys.first > ch.t THEN 'late'
    WHEN NOT EXISTS (SELECT 1 FROM ta WHERE ta.p = ch.p AND ta.k = ch.k AND ta.i <= ch.t AND (ta.x IS NULL OR ta.x > ch.t)) THEN 'deleted' END ref_state
  FROM ch LEFT JOIN keys ON keys.p = ch.p AND keys.k = ch.k)
"""

#: Read results against generations by three columns, of which those that are null match anything.
P3_COMPOSITE_SQL = f"""
WITH ch AS (SELECT row_id, ingested_at t, {_key('generation_id')} g, {_key('example_id')} e, {_key('run_id')} r FROM read_result_record),
pa AS (SELECT ingested_at i, deleted_at x, {_key('generation_id')} g, {_key('example_id')} e, {_key('run_id')} r FROM generation_record),
hit AS (SELECT ch.row_id, min(pa.i) first, bool_or(pa.i <= ch.t AND (pa.x IS NULL OR pa.x > ch.t)) alive
  FROM ch JOIN pa ON (ch.g IS NULL OR ch.g = pa.g) AND (ch.e IS NULL OR ch.e = pa.e) AND (ch.r IS NULL OR ch.r = pa.r) GROUP BY 1)
SELECT ch.row_id, to_json([g, e, r]) AS ref_key, CASE WHEN first IS NULL THEN 'missing' WHEN first > t THEN 'late' ELSE 'deleted' END AS ref_state
FROM ch LEFT JOIN hit USING (row_id) WHERE (g IS NOT NULL OR e IS NOT NULL OR r IS NOT NULL) AND NOT coalesce(alive, false)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_composite": p3_composite}
ORACLES = {
    "p3_composite": P3_COMPOSITE_SQL,
    "p3_found": P3_SQL + "SELECT child_table, row_id, k AS ref_key, ref_state FROM st WHERE ref_state IS NOT NULL",
    "p3_report": P3_SQL
    + "SELECT child_table, strftime(created_at, '%Y-%m') AS period, ref_state, count(*) AS refs, count(DISTINCT row_id) AS rows FROM st WHERE ref_state IS NOT NULL GROUP BY ALL",
}
