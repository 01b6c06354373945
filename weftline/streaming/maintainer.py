"""Unmet counts kept up to date from a stream of terminal signals, instead of computed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.readiness import met
from weftline.sources.versions import Versions


class Maintainer:
    """How many needs of each waiting dependent are unmet.

    ``needs``: (dependent, need, strength); a need is met while any instance that it names ended in success, a WEAK one by failure too. ``waiting``: the
    dependents that still wait. Both are read anew for each batch. Signals: (instance, need, state, at), in any order and any number of times: the latest
    ``at`` of an instance counts, so a repeated or late one changes nothing. A batch recounts only waiting dependents of the needs that it touches, and new
    ones; others keep their counts, whatever comes. A batch that runs again after a lost driver gives the same rows, see ``Versions``.
    """

    def __init__(self, spark: SparkSession, root: str, needs: Callable[[], DataFrame], waiting: Callable[[], DataFrame], every: int = 16) -> None:
        self.needs, self.waiting, self.root = needs, waiting, root
        self.ended = Versions(spark, f"{root}/ended", ["instance"], "instance string, need string, state string, at timestamp_ntz", every)
        self.counts = Versions(spark, f"{root}/counts", ["dependent"], "dependent string, unmet long, ready_since long", every)
        nothing = spark.createDataFrame([], self.ended.schema)
        self.ended.start(nothing)
        self.counts.start(self._counted(waiting().select("dependent"), nothing).withColumn("ready_since", F.when(F.col("unmet") == 0, -1).cast("long")))

    def _counted(self, dependents: DataFrame, ended: DataFrame) -> DataFrame:
        """Needs of ``dependents`` that no instance meets. Instances are summed up by need first, so a need is a row."""
        state = ended.groupBy("need").agg(F.max(F.col("state") == "SUCCESS").alias("_good"), F.lit(True).alias("_any"))
        each = self.needs().join(dependents, "dependent", "left_semi").join(state, "need", "left")
        fits = F.coalesce(met(F.when(F.col("_good"), "SUCCESS").when(F.col("_any"), "FAILED"), F.col("strength")), F.lit(False))
        unmet = each.where(~fits).groupBy("dependent").agg(F.count("*").alias("unmet"))
        return dependents.join(unmet, "dependent", "left").select("dependent", F.coalesce("unmet", F.lit(0)).cast("long").alias("unmet"))

    def apply(self, signals: DataFrame, batch: int) -> None:
        """Apply one batch of signals."""
        last = signals.where("state in ('SUCCESS', 'FAILED') and instance is not null").groupBy("instance").agg(F.max_by(F.struct("need", "state", "at"), F.struct("at", "state")).alias("_new"))
        known = self.ended.before(batch)
        held = known.select("instance", F.col("at").alias("_at"), F.col("state").alias("_state"))
        fresh = last.join(held, "instance", "left").where("_at is null or _new.at > _at or (_new.at = _at and _new.state > _state)").select("instance", "_new.*")
        fresh = self.ended.put(fresh, batch)
        waiting, counts = self.waiting().select("dependent").distinct(), self.counts.before(batch)
        touched = self.needs().join(fresh.select("need").distinct(), "need", "left_semi").select("dependent")
        new = waiting.join(counts, "dependent", "left_anti")
        again = waiting.join(touched.union(new).distinct(), "dependent", "left_semi")
        now = self._counted(again, self.ended.before(batch + 1)).join(counts.select("dependent", F.col("unmet").alias("_was"), F.col("ready_since").alias("_since")), "dependent", "left")
        changed = now.where("_was is null or unmet <> _was")
        self.counts.put(changed.withColumn("ready_since", F.when(F.col("unmet") == 0, F.coalesce("_since", F.lit(batch))).cast("long")), batch)

    def current(self, batch: int = 2**62) -> DataFrame:
        """(dependent, unmet, ready_since): counts, and the batch since which a dependent has been ready (-1: from the start)."""
        return self.counts.before(batch)

    def run(self, signals: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply what is there of a stream; started again, it goes on where its checkpoint ends."""
        return signals.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
