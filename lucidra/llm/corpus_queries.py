"""Queries over the documents (problems 8, 9 and 10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidra.llm.mixing import mix
from lucidra.llm.packing import pack
from lucidra.llm.reading import reading_bands
from lucidra.llm.tokens import count_tokens
from lucidra.session import load
from lucidra.util import cut, spread


def source_name(c: Column) -> Column:
    """Sources compare trimmed and in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _placements(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame, list]]:
    docs = cut(count_tokens(spread(load(spark, d, "documents").select("doc_id", "text")), ["doc_id"], "text"))
    specs = sorted((r.capacity_tokens, r.container_kind) for r in load(spark, d, "container_spec").collect())
    return [(kind, cap, *pack(docs, "doc_id", "n_tokens", cap)) for cap, kind in specs]


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every piece of every document, for each capacity, with the fill of that container."""
    return reduce(
        DataFrame.unionByName,
        [
            placed.select(
                F.lit(kind).alias("container_kind"),
                "container",
                F.col("item").alias("doc_id"),
                "piece",
                "start",
                "length",
                (F.col("used") / F.lit(cap)).alias("fill"),
            )
            for kind, cap, placed, _ in _placements(spark, d)
        ],
    )


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, fill and the least number of containers possible, for each capacity."""
    parts = []
    for kind, cap, placed, _ in _placements(spark, d):
        sums = placed.groupBy("container").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("pieces"))
        parts.append(
            sums.agg(
                F.lit(kind).alias("container_kind"),
                F.lit(cap).alias("capacity"),
                F.count(F.lit(1)).alias("containers"),
                F.sum("pieces").alias("pieces"),
                F.sum("used").alias("tokens"),
                F.ceil(F.sum("used") / F.lit(cap)).alias("least_containers"),
                (F.sum("used") / (F.count(F.lit(1)) * F.lit(cap))).alias("fill"),
                F.max("used").alias("most_used"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = load(spark, d, "documents").select("doc_id", "text", source_name(F.col("source")).alias("source"))
    docs = count_tokens(spread(raw), ["doc_id", "source"], "text")
    targets = load(spark, d, "mix_target").withColumn("source", source_name(F.col("source")))
    return mix(docs, "doc_id", "source", "n_tokens", targets)


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often each document of the targeted sources is used."""
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The actual shares of the sources."""
    return _mixed(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The reading band of every prose document."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return reading_bands(docs, "doc_id", "text", load(spark, d, "reading_label")).select("doc_id", "band")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and band; null source and null band (no prose) are groups of their own."""
    docs = load(spark, d, "documents").select("doc_id", source_name(F.col("source")).alias("source"))
    return docs.join(p10_found(spark, d), "doc_id", "left").groupBy("source", "band").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p9_copies": p9_copies, "p9_shares": p9_shares, "p10_found": p10_found, "p10_profile": p10_profile}
ORACLES: dict = {}
