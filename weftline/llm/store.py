"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set: the one of ``spark.checkpoint.dir``; without it a local one will do in local mode alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder; a lost executor loses nothing of it."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def batched(df: DataFrame, bytes_: int = 8 << 20) -> DataFrame:
    """``df``, its session's Arrow batches bounded to about ``bytes_`` unless the session has a bound of its own: texts can be long, and a worker
    and the JVM beside it hold several batches at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(bytes_))
    return df


def partitions(spark: SparkSession, bytes_: int = 0, per: int = 64 << 20) -> int:
    """Shuffle partitions for so many bytes: as the session has them, more where they would be larger than ``per``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // per))


#: Small rows that a partition of a trimmed table holds.
TRIM = 200_000


def trim(df: DataFrame, per: int = TRIM) -> DataFrame:
    """``cut``, read back in one partition for ``per`` rows, so that a small table is no burden of empty tasks and files."""
    kept = cut(df)
    return kept.coalesce(max(1, -(-kept.count() // per)))


def small(keys: DataFrame, bound: int = 200_000) -> DataFrame:
    """``keys`` (a checkpointed table of small rows) to be broadcast if they are at most ``bound`` (about 20 MB)."""
    return F.broadcast(keys) if keys.limit(bound + 1).count() <= bound else keys


def pick(rows: DataFrame, keys: DataFrame, on: str, bound: int = 200_000) -> DataFrame:
    """Rows whose ``on`` is in ``keys`` (a checkpointed table), with the columns of both.

    The keys are broadcast if they are at most ``bound``; beyond that both sides are shuffled, and Spark splits partitions that are too large.
    """
    return rows.join(small(keys, bound), on)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again."""
    spark = df.sparkSession
    shared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
