"""Queries of problem 5 over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidra.functions.dimensions import dimension_code
from lucidra.operators.shred import Store, attach, members, roots, shred, slug, step
from lucidra.session import load
from lucidra.util import blank_to_null

COLS = ["child_kind", "child_key", "child_value"]


def workload_store(spark: SparkSession, d: str) -> Store:
    """The nested parts of the workload records as one store."""
    keep = {"ignoreNullFields": "false"}
    w = load(spark, d, "workload_record").select(
        "row_id",
        F.inline(
            F.array(
                F.struct(F.lit("dimensions").alias("part"), F.to_json("dimensions", keep).alias("text")),
                F.struct(F.lit("interpretation_answers").alias("part"), F.to_json("interpretation_answers", keep).alias("text")),
                F.struct(F.lit("provenance").alias("part"), F.col("provenance").alias("text")),
            )
        ),
    )
    return shred(w, ["row_id"], "part", "text", embedded=("question_decomposition", "support"))


def certificate_store(spark: SparkSession, d: str) -> Store:
    """The payloads of the read certificates as one store."""
    p = load(spark, d, "read_certificate").select("row_id", F.lit("payload").alias("part"), F.col("payload").alias("text"))
    return shred(p, ["row_id"], "part", "text", embedded=("assumption_status",))


def _rows(df: DataFrame, kind: str, key: Column, value: Column) -> DataFrame:
    return df.select("root", F.lit(kind).alias("child_kind"), key.alias("child_key"), value.alias("child_value"))


def workload_children(store: Store) -> DataFrame:
    """``row_id`` and the four kinds of children of a workload record."""
    e = store.edges
    dims = step(step(roots(store, "dimensions"), e, "root", None, "d"), e, "d", "level", "l")
    dims = _rows(dims, "dimension", dimension_code(F.col("d_key")), slug(F.col("l_leaf")))
    dims = dims.where("child_value is not null and child_key in ('R2', 'R4', 'R5', 'R6')").distinct()

    answers = step(step(roots(store, "interpretation_answers"), e, "root", None, "i"), e, "i", None, "a")
    answers = _rows(answers, "interpretation_answer", F.concat_ws("/", "i_key", F.col("a_ord").cast("string")), F.col("a_leaf"))

    steps = members(step(roots(store, "provenance"), e, "root", "question_decomposition", "q"), store, "q", "s")
    steps = steps.where("s is not null").select("root", "s", "s_ord")
    steps = step(steps, e, "s", "position", "p", "left")
    steps = steps.select("root", "s", F.coalesce(blank_to_null(F.col("p_leaf")), F.col("s_ord").cast("string")).alias("pos"))
    ids = _rows(step(steps, e, "s", "source_step_id", "x", "left"), "decomposition_step", F.col("pos"), F.col("x_leaf"))
    support = members(step(steps, e, "s", "support", "u"), store, "u", "t")
    support = step(support.select("root", "pos", "t", "t_ord").where("t is not null"), e, "t", "title", "h", "left")
    support = _rows(support, "step_support", F.concat_ws("/", "pos", F.col("t_ord").cast("string")), F.col("h_leaf"))
    return (
        attach(dims, store, "dimensions", COLS)
        .unionByName(attach(answers, store, "interpretation_answers", COLS))
        .unionByName(attach(ids.unionByName(support), store, "provenance", COLS))
    )


def truth(c: Column) -> Column:
    """Yes or no as ``true`` or ``false`` from its spellings; null for anything else."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "yes", "1", "1.0"), "true").when(t.isin("false", "no", "0", "0.0"), "false")


def certificate_children(store: Store) -> DataFrame:
    """``row_id`` and the assumptions of a certificate: a map, a list of named objects, or values wrapped in objects."""
    e = store.edges
    status = step(roots(store, "payload"), e, "root", "assumption_status", "a").select("root", "a").where("a is not null")
    inner = step(status, e, "a", None, "v").select("root", "v", "v_key", "v_leaf")
    plain = inner.where("v is null").select("root", F.col("v_key").alias("name"), F.col("v_leaf").alias("held"))
    nested = step(inner.where("v is not null"), e, "v", None, "m")
    nested = nested.groupBy("root", "v", "v_key").agg(
        F.max(F.when(F.lower("m_key") == "name", F.col("m_leaf"))).alias("own"),
        F.max(F.when(F.lower("m_key").isin("value", "holds"), F.col("m_leaf"))).alias("held"),
    )
    nested = nested.select("root", F.when(F.col("v_key") == "", F.col("own")).otherwise(F.col("v_key")).alias("name"), "held")
    rows = _rows(plain.unionByName(nested), "assumption", F.trim("name"), truth(F.col("held")))
    return attach(rows.where("child_value is not null and child_key != ''").distinct(), store, "payload", COLS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every child row of both record kinds."""
    w = workload_children(workload_store(spark, d)).select(F.lit("workload").alias("record_kind"), "row_id", *COLS)
    c = certificate_children(certificate_store(spark, d)).select(F.lit("certificate").alias("record_kind"), "row_id", *COLS)
    return w.unionByName(c)


def p5_sharing(spark: SparkSession, d: str) -> DataFrame:
    """How far storing identical subtrees once goes: occurrences and distinct roots per part."""
    out = []
    for kind, store in (("workload", workload_store(spark, d)), ("certificate", certificate_store(spark, d))):
        out.append(
            store.occurrences.groupBy(F.lit(kind).alias("record_kind"), "part").agg(
                F.count(F.lit(1)).alias("occurrences"), F.countDistinct("node").alias("distinct_roots")
            )
        )
    return out[0].unionByName(out[1])


_STEP = """
 steps AS (
  SELECT row_id, s.o, s.j j FROM (
    SELECT row_id, CASE json_type(q) WHEN 'ARRAY' THEN q WHEN 'OBJECT' THEN json_array(q) END arr FROM (
      SELECT row_id, CASE WHEN json_type(q) = 'VARCHAR' AND json_valid(q->>'$') THEN (q->>'$')::JSON ELSE q END q FROM (
       SELECT row_id, json_extract(CASE WHEN json_valid(provenance) THEN provenance::JSON END, '$.question_decomposition') q FROM workload_record))) z,
    LATERAL (SELECT unnest(range(json_array_length(arr)::BIGINT)) o) u, LATERAL (SELECT u.o o, json_extract(arr, '$[' || u.o || ']') j) s
  WHERE json_type(s.j) = 'OBJECT'),
 named AS (SELECT *, coalesce(nullif(trim(json_extract_string(j, '$.position')), ''), (o + 1)::VARCHAR) pos FROM steps),
 sup AS (SELECT row_id, pos, CASE json_type(u) WHEN 'ARRAY' THEN u WHEN 'OBJECT' THEN json_array(u) END arr
  FROM (SELECT row_id, pos, json_extract(j, '$.support') u FROM named))"""
_NAME = "regexp_replace(lower(trim(k)), '[\\s-]+', '_', 'g')"
#: The recorded assumptions of the certificates: row_id, k (name), t (value in lower case).
ASM_SQL = """st AS (SELECT row_id, CASE WHEN json_type(a) = 'VARCHAR' AND json_valid(a->>'$') THEN (a->>'$')::JSON ELSE a END a
  FROM (SELECT row_id, json_extract(CASE WHEN json_valid(payload) THEN payload::JSON END, '$.assumption_status') a FROM read_certificate)),
 obj AS (SELECT row_id, k, json_extract(a, '$."' || k || '"') v FROM (SELECT row_id, a, unnest(json_keys(a)) k FROM st WHERE json_type(a) = 'OBJECT')),
 lst AS (SELECT row_id, json_extract(a, '$[' || o || ']') v FROM (SELECT row_id, a, unnest(range(json_array_length(a)::BIGINT)) o FROM st WHERE json_type(a) = 'ARRAY')),
 asm AS (
  SELECT row_id, trim(k) k, lower(trim(CASE WHEN json_type(v) = 'OBJECT' THEN coalesce(v->>'$.value', v->>'$.holds') ELSE v->>'$' END)) t FROM obj
  UNION ALL SELECT row_id, trim(v->>'$.name'), lower(trim(coalesce(v->>'$.value', v->>'$.holds'))) FROM lst WHERE json_type(v) = 'OBJECT')"""
P5_SQL = f"""
WITH {_STEP.strip()},
 dims AS (SELECT row_id, unnest(map_keys(dimensions)) k, unnest(map_values(dimensions)) v FROM workload_record),
 ia AS (SELECT row_id, unnest(map_keys(interpretation_answers)) k, unnest(map_values(interpretation_answers)) v FROM workload_record),
 {ASM_SQL}
SELECT DISTINCT 'workload' AS record_kind, row_id, 'dimension' AS child_kind,
  CASE {_NAME} WHEN 'r2' THEN 'R2' WHEN 'precision_requirement' THEN 'R2' WHEN 'r4' THEN 'R4' WHEN 'query_ambiguity' THEN 'R4'
   WHEN 'r5' THEN 'R5' WHEN 'synthesis_depth' THEN 'R5' WHEN 'r6' THEN 'R6' WHEN 'domain_specificity' THEN 'R6' END AS child_key,
  regexp_replace(lower(trim(v.level)), '[\\s-]+', '_', 'g') AS child_value
 FROM dims WHERE v.level IS NOT NULL AND {_NAME} IN ('r2','precision_requirement','r4','query_ambiguity','r5','synthesis_depth','r6','domain_specificity')
UNION ALL SELECT 'workload', row_id, 'interpretation_answer', k || '/' || o, v[o] FROM (SELECT row_id, k, v, unnest(range(1, len(v) + 1)) o FROM ia)
UNION ALL SELECT 'workload', row_id, 'decomposition_step', pos, json_extract_string(j, '$.source_step_id') FROM named
UNION ALL SELECT 'workload', row_id, 'step_support', pos || '/' || (o + 1), json_extract_string(arr, '$[' || o || '].title')
 FROM (SELECT row_id, pos, arr, unnest(range(json_array_length(arr)::BIGINT)) o FROM sup)
UNION ALL SELECT DISTINCT 'certificate', row_id, 'assumption', k, CASE WHEN t IN ('true','yes','1','1.0') THEN 'true' ELSE 'false' END
 FROM asm WHERE t IN ('true','yes','1','1.0','false','no','0','0.0') AND k <> ''
"""

QUERIES = {"p5_found": p5_found, "p5_sharing": p5_sharing}
ORACLES = {"p5_found": P5_SQL}
