"""The generation log as a stream: an extension for logs that grow while they are scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lucidra.functions.text import normalize_ascii

LOG_SCHEMA = "generation_id string, run_id string, example_id string, raw_text string, candidates array<string>, score double, created_at timestamp"


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """The log folder as a stream of rows."""
    return spark.readStream.schema(schema).json(path)


def scored_stream(log: DataFrame, examples: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each generation once (first delivery within ``delay``), with whether its first candidate matches an accepted answer.

    ``examples`` is static: example_id, accepted_answers. Rows later than ``delay`` behind the newest are dropped as
    late, which bounds the state; choose it beyond the longest redelivery.
    """
    once = log.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["generation_id"])
    said = normalize_ascii(F.try_element_at("candidates", F.lit(1)))
    j = once.join(examples.select("example_id", "accepted_answers"), "example_id", "left")
    return j.withColumn("correct", F.exists("accepted_answers", lambda a: normalize_ascii(a) == said))


def accuracy_windows(scored: DataFrame, window: str = "1 hour") -> DataFrame:
    """``window, n, correct`` per tumbling window of ``created_at``."""
    return scored.groupBy(F.window("created_at", window)).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"))


def write_scored(scored: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append scored rows to a folder; with ``once`` all that is there is taken and the query ends."""
    w = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
