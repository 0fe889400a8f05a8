"""A synthetic end-to-end run: generated rows, conformal sets per group, metrics and the policy frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidra.functions.numeric import hash_fraction
from lucidra.operators import conformal, metrics


def synthetic(spark: SparkSession, split: str, n: int, seed: int = 7) -> DataFrame:
    """``row, split, grp, probs, label, conf, correct``: three classes, the tail group noisier than the head."""
    u = lambda k: hash_fraction(F.concat_ws(":", F.lit(split), F.col("row").cast("string"), F.lit(k)), seed)
    t = spark.range(n).withColumnRenamed("id", "row").withColumn("grp", F.when(F.col("row") % 3 == 0, "tail").otherwise("head"))
    sharp = F.when(F.col("grp") == "head", 0.75).otherwise(0.5) + u("s") * 0.2
    top = F.floor(u("t") * 3).cast("int")
    t = t.withColumn("top", top).withColumn("sharp", sharp)
    probs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("top"), F.col("sharp")).otherwise((1 - F.col("sharp")) / 2))
    label = F.when(u("y") < F.col("sharp"), F.col("top")).otherwise((F.col("top") + 1) % 3)
    return t.select("row", F.lit(split).alias("split"), "grp", probs.alias("probs"), label.alias("label"), F.col("sharp").alias("conf"), (label == F.col("top")).cast("int").alias("correct"))


def demo(spark: SparkSession, calibration: int = 240, test: int = 120, alpha: float = 0.2) -> dict[str, DataFrame]:
    """Tables by name: coverage, efficiency, report, frontier."""
    cal, out = synthetic(spark, "calibration", calibration), synthetic(spark, "test", test)
    fitted = conformal.thresholds(cal.withColumn("nc", conformal.nonconformity(F.col("probs"), F.col("label"))), "nc", alpha, ["grp"], 10)
    sets = conformal.apply_sets(out, "probs", fitted, ["grp"])
    return {
        "coverage": conformal.coverage(sets, "prediction_set", "label", ["grp"]),
        "efficiency": metrics.set_efficiency(sets, "prediction_set", ["grp"]),
        "report": metrics.group_report(out, "conf", "correct", ["grp"]),
        "frontier": metrics.selective(out, "conf", "correct", [0.5, 0.7, 0.9, 0.95, 0.99]),
    }
