"""Freshness tiers, service levels, medians and run progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = ("NEVER", "FRESH", "AGING", "STALE")


def tier(last: Column, as_of: Column) -> Column:
    """FRESH within 6 hours, AGING within 24, else STALE; NEVER without a success."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(last.cast("timestamp"))
    return F.when(last.isNull(), "NEVER").when(age <= 6 * 3600, "FRESH").when(age <= 24 * 3600, "AGING").otherwise("STALE")


def tiers(tasks: DataFrame, instances: DataFrame, as_of: str) -> DataFrame:
    """(id, name, project_id, last_success, tier, age_hours) of every task; age in whole hours, cut off, null for NEVER."""
    now = F.lit(as_of).cast("timestamp_ntz")
    last = instances.groupBy("task_id").agg(F.max(F.when(F.col("state") == "SUCCESS", F.col("finished_at"))).alias("last_success"))
    rows = tasks.join(last, tasks["id"] == last["task_id"], "left").select("id", "name", "project_id", "last_success")
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_success").cast("timestamp"))) / 3600
    return rows.withColumns({"tier": tier(F.col("last_success"), now), "age_hours": F.floor(age).cast("long")})


def tier_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.count_if(F.col("tier") == x).alias(x.lower()) for x in TIERS), F.count("*").alias("total"))


def last_n(rows: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """The n rows of each key that come first."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order, F.col("id").desc()))).where(F.col("_k") <= n).drop("_k")


def whole_median(value: str) -> Column:
    """Exact median in whole units: of an even number, half the sum of the middle two, cut off."""
    return F.floor(F.percentile(value, 0.5)).cast("long")


def progress(state: str = "state") -> dict[str, Column]:
    """Counts of a set of runs; running is what is neither done nor failed."""
    done, failed = F.count_if(F.col(state) == "SUCCESS"), F.count_if(F.col(state) == "FAILED")
    return {"total": F.count("*"), "success": done, "failed": failed, "running": F.count("*") - done - failed}


def overall(total: str = "total", success: str = "success", failed: str = "failed", running: str = "running") -> Column:
    return F.when(F.col(running) > 0, "RUNNING").when(F.col(failed) == 0, "SUCCESS").when(F.col(success) == 0, "FAILED").otherwise("PARTIAL")


def workflow_state(states: str = "state") -> Column:
    """State of a run from those of its rows, as an aggregate: failed and active ones go before stopped, waiting and done."""
    any_ = lambda *s: F.bool_or(F.col(states).isin(*s))
    return (F.when(any_("RUNNING", "DISPATCHED"), "RUNNING").when(any_("FAILED"), "FAILED").when(any_("STOPPED"), "STOPPED")
            .when(any_("SUSPENDED"), "SUSPENDED").when(any_("WAITING"), "WAITING").otherwise("SUCCESS"))
