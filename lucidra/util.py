"""Helpers shared by operators: lineage cuts that survive lost executors, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session, which all executors share.

    Only where that setting is absent and the master is local (other people's test sessions) a folder of this machine is used.
    Each application writes below its own subfolder, which is removed when the interpreter ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"{tempfile.gettempdir()}/lucidra-local"
        _FOLDERS[app] = f"{root.rstrip('/')}/lucidra-{app}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage by writing ``df`` as a table in the shared folder and reading it back.

    The table survives the loss of any executor. The path is kept on the result as ``cut_path`` so
    that loops can drop generations they no longer need with :func:`drop_cut`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out.cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a result of :func:`cut`."""
    path = getattr(df, "cut_path", None)
    if path:
        _remove(df.sparkSession, path)


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys that hold at least ``share`` of the rows; at most ``1 / share`` of them exist, so the list is bounded."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    if not total:
        return []
    return [r[0] for r in counts.where(F.col("n") >= F.lit(max(2, int(share * total)))).select(key).collect()]


def counted_hot(counts: DataFrame, key: str, n: str, share: float = 0.01) -> list:
    """:func:`hot_keys` where the rows per key are counted already."""
    total = counts.agg(F.sum(n)).first()[0]
    return [r[0] for r in counts.where(F.col(n) >= max(2, int(share * total))).select(key).collect()] if total else []


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = 0.01, hot: list | None = None) -> DataFrame:
    """Equi-join where a few values of ``key`` may hold a large part of ``left``; ``right`` has unique keys.

    The right rows of the hot keys (at most ``1 / share`` rows) are broadcast, so that hot left rows stay
    where they are; all other keys take the ordinary shuffle join. No row is dropped or sampled.
    ``how`` is inner, left, left_semi or left_anti; null keys match nothing. A caller that has counted the
    keys already passes the ``hot`` ones.
    """
    hot = hot_keys(left, key, share) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    cold = left.where(~is_hot).join(right.where(~is_hot), key, how)
    return warm.unionByName(cold)


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)


def spread(df: DataFrame) -> DataFrame:
    """A scan as it is, unless it has fewer splits than the cluster has cores.

    Only then, for inputs below cores times the size of a split, its rows are spread for stages that are heavy on CPU per
    row. Larger inputs are never shuffled for it: their splits follow ``spark.sql.files.maxPartitionBytes``.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= n else df.repartition(n)
