"""Which work may run: unmet dependencies, affected work, placement, retries and limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def met(state: Column, strength: Column) -> Column:
    """An edge is met by success; a weak one by failure too."""
    return (state == "SUCCESS") | ((strength == "WEAK") & (state == "FAILED"))


def unmet_upstream(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, node, unmet); nodes without edges have none."""
    open_ = edges.where(~met(F.col("src_state"), F.col("strength"))).groupBy("run_id", F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return nodes.join(open_, ["run_id", "node"], "left").select("run_id", "node", F.coalesce("n", F.lit(0)).alias("unmet"))


def unmet_cross_cycle(waiting: DataFrame, instances: DataFrame, earliest: str) -> DataFrame:
    """``waiting`` with unmet: 1 unless the task succeeded the day before, or the date is before the earliest that counts."""
    done = instances.where("state = 'SUCCESS'").select("task_id", F.date_add(F.to_date("biz_date"), 1).cast("string").alias("biz_date")).distinct().withColumn("_met", F.lit(0))
    rows = waiting.join(done, ["task_id", "biz_date"], "left")
    return rows.withColumn("unmet", F.when(F.col("biz_date") < earliest, 0).otherwise(F.coalesce("_met", F.lit(1)))).drop("_met")


def affected(done: DataFrame, waiting: DataFrame) -> DataFrame:
    """Waiting instances of the tasks and dates that just ended, or of the day after."""
    days = done.select("task_id", F.explode(F.array("biz_date", F.date_add(F.to_date("biz_date"), 1).cast("string"))).alias("biz_date")).distinct()
    return waiting.join(days, ["task_id", "biz_date"], "left_semi").select("id").distinct()


def drift(stored: DataFrame, computed: DataFrame, key: list[str], value: str) -> DataFrame:
    """Computed rows that differ from what is stored."""
    return computed.join(stored.withColumnRenamed(value, "_stored"), key).where(~F.col(value).eqNullSafe(F.col("_stored"))).select(*key, value)


def aged(priority: str, waited_s: Column, step_s: int = 86400, test: Column | None = None) -> Column:
    """Declared priority less one for each step waited, and one for test runs, at least 0."""
    return F.greatest(F.lit(0), F.col(priority) - F.floor(waited_s / step_s) - (F.when(test, 1).otherwise(0) if test is not None else 0)).cast("long")


def placed(waiting: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node) by greedy choice: in order of priority and id, each goes to the freest node of its pool, the smallest name of several, whose room falls by one.

    waiting: id, priority, pool; nodes: node, free, pool. As each takes one slot, the choices are known beforehand: a pool's slots in order of what is free when they are
    taken, then of the node. So the k-th to wait takes the k-th slot, which is a join; who has no slot isn't placed.
    """
    slots = nodes.where("free > 0").select("pool", "node", F.explode(F.sequence(F.lit(1), F.col("free").cast("int"))).alias("left"))
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("left"), "node")))
    room = slots.groupBy("pool").agg(F.max("k").alias("room"))
    queue = waiting.select("id", "priority", "pool").withColumn("k", F.row_number().over(Window.partitionBy("pool").orderBy("priority", "id")))
    return queue.join(room, "pool").where("k <= room").join(slots.select("pool", "k", "node"), ["pool", "k"]).select("id", "node")


def backfill(tasks: DataFrame, first: str, last: str, most_days: int = 366) -> DataFrame:
    """(biz_date, task_id) of every task on every date of an inclusive range."""
    days = pd.date_range(first, last)
    if not 0 < len(days) <= most_days:
        raise ValueError(f"{first} to {last} isn't 1 to {most_days} days")
    dates = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return tasks.select(F.explode(F.transform(dates, lambda d: d.cast("string"))).alias("biz_date"), "task_id")


def timed_out(running: DataFrame, limit_ms: str) -> DataFrame:
    took = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return running.where(took > F.col(limit_ms))


def retry(state: Column, attempt: Column, most: Column) -> Column:
    return F.when((state == "FAILED") & (attempt <= most), "REQUEUE").when(state == "FAILED", "FAILED").otherwise("NONE")


def policy(name: Column, rules: list[tuple[str, str]], escalated: Column) -> Column:
    """Level of the first rule whose prefix fits; else REVIEW if escalated, else AUTO."""
    out = F.when(escalated, "REVIEW").otherwise("AUTO")
    for prefix, level in reversed(rules):
        out = F.when(name.startswith(prefix), level).otherwise(out)
    return out
