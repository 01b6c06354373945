"""A catalog in layers: what was found lately, what is known, and the source itself, which is asked for the rest alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.versions import Versions


class Layered:
    """Columns of tables by name, from the first layer that has them.

    The cache forgets what is older than ``ttl_hours``; the graph keeps what it is given; ``live`` takes a frame of names and gives (name, columns) of those that exist.
    What the graph or the source knows goes into the cache, and what the source knows into the graph too; that a name wasn't found is kept nowhere, so a new table is
    found by the next call. Both tables are versions by ``turn``, the number of the call: a call that runs again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, live: Callable[[DataFrame], DataFrame] | None, ttl_hours: int = 6) -> None:
        self.live, self.ttl_hours = live, ttl_hours
        self.cache = Versions(spark, f"{root}/cache", ["name"], "name string, columns array<string>, at timestamp_ntz")
        self.graph = Versions(spark, f"{root}/graph", ["name"], "name string, columns array<string>")

    def start(self, cached: DataFrame, known: DataFrame) -> None:
        """What both layers hold before the first turn."""
        self.cache.start(cached)
        self.graph.start(known)

    def resolve(self, names: DataFrame, now: str, turn: int) -> DataFrame:
        """(name, columns, layer) of each different name: cache, graph, live, or null for one that no layer has. Null and blank names are left out."""
        asked = names.select(F.trim("name").alias("name")).where("name <> ''").distinct()
        fresh = F.col("at") > F.expr(f"timestamp_ntz '{now}' - make_dt_interval(0, {self.ttl_hours})")
        near = self.cache.before(turn).where(fresh).select("name", "columns")
        known = self.graph.before(turn)
        by_cache = asked.join(near, "name").withColumn("layer", F.lit("cache"))
        rest = asked.join(near, "name", "left_anti")
        by_graph = rest.join(known, "name").withColumn("layer", F.lit("graph"))
        rest = rest.join(known, "name", "left_anti")
        new = self.graph.put(self.live(rest).join(rest, "name", "left_semi") if self.live else known.limit(0), turn)  # the source is asked once, what it said is read again
        found = by_graph.unionByName(new.withColumn("layer", F.lit("live")))
        self.cache.put(found.select("name", "columns", F.expr(f"timestamp_ntz '{now}'").alias("at")), turn)
        missed = rest.join(new, "name", "left_anti").select("name", F.lit(None).cast("array<string>").alias("columns"), F.lit(None).cast("string").alias("layer"))
        return by_cache.unionByName(found).unionByName(missed)

    def evict(self, names: DataFrame, turn: int) -> None:
        """Forget what the cache holds of some names."""
        self.cache.put(self.cache.before(turn).join(names.select("name").distinct(), "name", "left_semi").withColumn("at", F.lit(None).cast("timestamp_ntz")), turn)
