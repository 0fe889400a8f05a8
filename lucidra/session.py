"""Session factory and table loader."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: str | int = "*", partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are tested under.

    Intermediate tables go to ``LUCIDRA_SHARED``, by default a folder of this machine, since the session is local.
    On a cluster pass your own session instead: no operator depends on this one.
    """
    n = partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lucidra")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", os.environ.get("LUCIDRA_SHARED", f"{tempfile.gettempdir()}/lucidra-local"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
