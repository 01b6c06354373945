"""Keyed tables that batches change, kept as files that all executors read: a base, and the changes of each batch since."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """The newest row of each key, as it stood before any batch.

    A batch writes its changed rows alone, in a folder of its own, so a batch that runs again replaces what it wrote and reads what it read the
    first time. Every ``every`` batches the rows are written whole as a new base, so what a batch reads doesn't grow with the number of batches.
    A base or a batch has a key once, so rows are only joined with what changed since, and read as they are where nothing did.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: str, every: int = 16) -> None:
        self.spark, self.root, self.key, self.schema, self.every = spark, root, key, schema, every
        self.columns = [x.split()[0] for x in schema.split(", ")]

    def start(self, rows: DataFrame) -> None:
        """The rows before the first batch; a table that has been started stays as it is."""
        rows.select(*self.columns).dropDuplicates(self.key).write.mode("ignore").parquet(f"{self.root}/base/batch=-1")
        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.root}/changes/batch=-1")

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.root}/{name}")

    def before(self, batch: int, base_before: int | None = None) -> DataFrame:
        """One row for each key: the last one that was put before ``batch``, counted on from a base of before ``base_before``."""
        base, changes = self._part("base").where(F.col("batch") < (batch if base_before is None else base_before)), self._part("changes").where(F.col("batch") < batch)
        newest = base.agg(F.max("batch")).first()[0]
        newest = -1 if newest is None else newest  # no base has rows
        rows, changes = base.where(F.col("batch") == newest).select(*self.columns), changes.where(F.col("batch") > newest)
        since = changes.select("batch").distinct().collect()  # at most ``every``, as far as batches came in order
        if not since:
            return rows
        rest = [c for c in self.columns if c not in self.key]
        if len(since) > 1:
            last = changes.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
            changes = last.select(*self.key, *(F.col(f"_row.{c}").alias(c) for c in rest))
        changed = changes.select(*(F.col(c).alias(f"_{c}") for c in self.key))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.key))
        return rows.join(changed, same, "left_anti").unionByName(changes.select(*self.columns))

    def put(self, rows: DataFrame, batch: int) -> DataFrame:
        """Keep the changed rows of a batch, at most one a key, and give them back as they are kept."""
        path = f"{self.root}/changes/batch={batch}"
        rows.select(*self.columns).write.mode("overwrite").parquet(path)
        if batch % self.every == self.every - 1:
            whole = self.before(batch + 1, batch)  # not from the base of this batch, which is there if it runs again
            whole.select(*self.columns).write.mode("overwrite").parquet(f"{self.root}/base/batch={batch}")
        return self.spark.read.schema(self.schema).parquet(path)
