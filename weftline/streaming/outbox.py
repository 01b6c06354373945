"""Streams: an outbox of terminal signals, log tails, and checkpoint histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.readiness import affected


def outbox(spark: SparkSession, path: str, schema: str, state: str = "state") -> DataFrame:
    """Terminal signals of an append-only folder of Parquet files, as a stream; a signal that comes twice within a day counts once."""
    rows = spark.readStream.schema(schema).parquet(path).where(F.col(state).isin("SUCCESS", "FAILED"))
    return rows.withColumn("at", F.col("finished_at").cast("timestamp")).withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["id"])


def maintain(signals: DataFrame, waiting: Callable[[], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """For each batch of signals, write the waiting instances that it affects, keyed by batch; a batch that runs again overwrites its own rows."""
    def batch(rows: DataFrame, number: int) -> None:
        found = affected(rows, waiting()).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return signals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(log: DataFrame, instance: int, after: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(lines after an entry, in order; number of those that are left)."""
    rows = log.where((F.col("instance") == instance) & (F.col("entry") > after))
    return rows.orderBy("entry").limit(limit), rows.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("backlog"))


def history(checkpoints: DataFrame, keep: int, as_of: str, ttl_hours: int) -> DataFrame:
    """Checkpoints with their state after rolling retention, and whether a job may resume from them."""
    place = F.row_number().over(Window.partitionBy("job", "state").orderBy(F.col("ordinal").desc()))
    state = F.when((F.col("state") == "SUCCESS") & (place > keep), "EXPIRED").otherwise(F.col("state"))
    fresh = F.col("at") > F.expr(f"timestamp_ntz '{as_of}' - interval {ttl_hours} hours")
    return checkpoints.withColumn("state", state).withColumn("resumable", (F.col("state") == "SUCCESS") & fresh)


def feed(snapshot: DataFrame, changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """What was known when the stream began, as batch -1, and then each batch of changes, in one folder; a batch that runs again overwrites its own rows."""
    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    keep(snapshot, -1)
    return changes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumed(start: Callable[[], StreamingQuery], state: str, resumable: bool) -> StreamingQuery:
    """Start a stopped stream again where its checkpoint ends; a ValueError if it isn't stopped or suspended, or has no checkpoint to resume from."""
    if state not in ("STOPPED", "SUSPENDED") or not resumable:
        raise ValueError(f"can't resume: {state}, {'a' if resumable else 'no'} resumable checkpoint")
    return start()


def discarded(rows: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
    """A job that computes all of a stream and keeps none of it, unbounded unless the trigger ends it; its progress tells how many rows it has read."""
    return rows.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
