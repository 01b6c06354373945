"""Where iterations keep what they have so far, and in how many parts large tables are grouped."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Rows of a part that a task groups or sorts, at most.
MOST_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, of about so many rows, dealt by columns to parts of ``MOST_ROWS``, where as many parts as the session has would be larger.

    What groups or sorts by these columns next does so within a part, so the memory of a task doesn't grow with the table.
    """
    parts = -(-rows // MOST_ROWS)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *by)


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; without one a local folder will do in local mode alone."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)
