"""A corpus collected from a stream of documents, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.sources.versions import Versions


class Collector:
    """Documents that pass all gates, each content with its smallest id.

    ``gates`` are looked at in order, cheap ones first. ``clean`` makes of a text what is kept, ``key`` of a clean text what counts as its content. Contents seen so far are a
    versioned table and no stream state, so memory doesn't grow with them, and batches in any order, repeated files, reruns and restarts give the same corpus.
    """

    def __init__(self, spark: SparkSession, root: str, gates: list[Column], key: Callable[[Column], Column], clean: Callable[[Column], Column] = lambda x: x, doc_id: str = "doc_id", text: str = "text") -> None:
        self.gates, self.key, self.clean, self.doc_id, self.text = gates, key, clean, doc_id, text
        self.kept = Versions(spark, f"{root}/kept", ["content"], "content string, doc_id long, text string")
        self.kept.start(spark.createDataFrame([], self.kept.schema))

    def apply(self, docs: DataFrame, batch: int) -> None:
        rows = docs
        for gate in self.gates:
            rows = rows.where(gate)
        rows = rows.select(F.col(self.doc_id).cast("long").alias("doc_id"), self.clean(F.col(self.text)).alias("text")).withColumn("content", self.key(F.col("text"))).where("content is not null and doc_id is not null")
        first = rows.groupBy("content").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", "text")).alias("_x")).select("content", "_x.*")
        before = self.kept.before(batch).select("content", F.col("doc_id").alias("_was"))
        self.kept.put(first.join(before, "content", "left").where("_was is null or doc_id < _was"), batch)

    def corpus(self, batch: int = 2**62) -> DataFrame:
        """(content, doc_id, text) as it stands."""
        return self.kept.before(batch)

    def run(self, docs: DataFrame, checkpoint: str) -> StreamingQuery:
        return docs.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
