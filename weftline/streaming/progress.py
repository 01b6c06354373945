"""What streams have done: a history that a listener writes, and the panel of long-running jobs over it."""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from weftline.streaming.outbox import history

RECORD = "job string, query string, ordinal long, state string, at timestamp_ntz, rows long, took_ms long, error string"


class Recorder(StreamingQueryListener):
    """Keeps a record of every batch of the session's named streams that read rows, and of every failure, and appends them to a Parquet folder.

    Records are small and held on the driver only until ``flush``, which is called between batches as often as the caller likes, and at the end of ``with``.
    A failed batch has the ordinal after the last one that ended. Streams without a name go by their id.
    """

    def __init__(self, spark: SparkSession, target: str) -> None:
        self.spark, self.target = spark, target
        self.lock, self.changed = threading.Lock(), threading.Condition()
        self.records: list[tuple] = []
        self.names: dict[str, str] = {}
        self.last: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)

    def _keep(self, run: str, *row) -> None:
        with self.lock:
            self.records.append((self.names.get(run, run), run, *row))

    def onQueryProgress(self, event) -> None:
        p, run = event.progress, str(event.progress.runId)
        if p.numInputRows and p.batchId > self.last.get(run, -1):
            self.last[run] = p.batchId
            self._keep(run, p.batchId, "SUCCESS", datetime.fromisoformat(p.timestamp.replace("Z", "")), p.numInputRows, p.batchDuration, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if event.exception:
            self._keep(run, self.last.get(run, -1) + 1, "FAILED", datetime.now(), None, None, event.exception[:500])
        with self.changed:
            self.ended.add(run)
            self.changed.notify_all()

    def wait(self, runs: list[str], seconds: float = 60) -> None:
        """Until the listener has heard of the end of these runs; events come some time after it."""
        with self.changed:
            if not self.changed.wait_for(lambda: self.ended.issuperset(map(str, runs)), seconds):
                raise TimeoutError("the end of a stream was not heard of")

    def flush(self) -> None:
        with self.lock:
            records, self.records = self.records, []
        self.spark.createDataFrame(records, RECORD).coalesce(1).write.mode("append").parquet(self.target)

    def __enter__(self) -> Recorder:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)
        self.flush()


def recorded(spark: SparkSession, target: str) -> DataFrame:
    """The history of a folder. A batch that ran again after a restart counts with its last record."""
    rows = spark.read.schema(RECORD).parquet(target)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("job", "ordinal", "state").orderBy(F.desc("at"), F.desc("query")))).where("_k = 1").drop("_k")


def panel(jobs: DataFrame, workers: DataFrame, checkpoints: DataFrame, now: str, ttl_hours: int, keep: int = 3) -> DataFrame:
    """Long-running jobs with how long they have run, whether their worker is on line, and their last checkpoint.

    ``jobs``: job, state, started_at, finished_at, worker, and whatever else; ``workers``: worker, status; ``checkpoints``: job, ordinal, state, at.
    seconds: from the start to the end, or to ``now``, at least 0; last_ordinal and last_at: the successful checkpoint of the highest ordinal that rolling retention
    keeps; resumable: it isn't older than ``ttl_hours``. Jobs without a worker that is known are off line; without checkpoints they aren't resumable.
    """
    end = F.coalesce("finished_at", F.expr(f"timestamp_ntz '{now}'"))
    took = F.greatest(F.lit(0), F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000000)).alias("seconds")
    kept = history(checkpoints.select("job", "ordinal", "state", "at"), keep, now, ttl_hours).where("state = 'SUCCESS'")
    last = kept.groupBy("job").agg(F.max_by(F.struct("ordinal", "at", "resumable"), "ordinal").alias("_last"))
    on = workers.groupBy("worker").agg(F.bool_or(F.upper("status") == "ONLINE").alias("_on"))
    rows = jobs.join(on, "worker", "left").join(last, "job", "left")
    return rows.select(*jobs.columns, took, F.coalesce("_on", F.lit(False)).alias("online"), F.col("_last.ordinal").alias("last_ordinal"), F.col("_last.at").alias("last_at"), F.coalesce("_last.resumable", F.lit(False)).alias("resumable"))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """A page of the panel: running jobs first, then suspended ones, then others; the latest start first, then the largest job."""
    order = F.when(F.col("state").isin("RUNNING", "DISPATCHED"), 0).when(F.col("state") == "SUSPENDED", 1).otherwise(2)
    size = min(max(1, size), 200)
    return rows.orderBy(order, F.col("started_at").desc_nulls_last(), F.desc("job")).offset(max(0, number) * size).limit(size)
