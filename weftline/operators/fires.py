"""Missed and coming fires of schedules: which points are armed, what comes next, and what becomes of fires that no instance came of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import schedules

POLICIES = ("fire_once", "all", "skip")


def _instant(now: str, seconds: int = 0):
    return F.expr(f"timestamp_ntz '{now}' + make_dt_interval(0, 0, 0, {seconds})")


def _valid(rows: DataFrame, point: str) -> DataFrame:
    """Points within the term of their schedule, where it has one."""
    for bound, sign in (("starts", ">="), ("stops", "<=")):
        if bound in rows.columns:
            rows = rows.where(f"{bound} is null or {point} {sign} {bound}")
    return rows


def due(plans: DataFrame, now: str, ahead_s: int, guards: DataFrame | None = None, key: str = "task_id") -> DataFrame:
    """(key, due, missed): the points that a scheduler arms at ``now``, each once.

    ``plans``: key, last (the last fire), cron, seconds (an interval, where there is no cron), policy, and starts and stops where schedules have a term.
    Points after ``last`` and up to ``now`` were missed: policy all takes each of them, fire_once the first alone, skip the one that was missed if it is the only one.
    Points of the next ``ahead_s`` seconds are armed by any policy. ``guards`` (key, due, status): points that have a guard are left out, unless it is DEAD.
    A null policy is fire_once; schedules without cron or interval, or with a malformed cron, have no points; rows that repeat a schedule count once.
    """
    rows = plans.withColumn("_upto", _instant(now, ahead_s))
    points = _valid(schedules.fires(rows, "last", "_upto", "cron", "seconds", into="due"), "due").withColumn("missed", F.col("due") <= _instant(now))
    points = points.select(key, "due", "missed", F.coalesce("policy", F.lit("fire_once")).alias("policy")).dropDuplicates([key, "due"])
    by = Window.partitionBy(key, "missed")
    placed = points.withColumn("_k", F.row_number().over(by.orderBy("due"))).withColumn("_n", F.count("*").over(by))
    out = placed.where("not missed or policy = 'all' or (policy = 'fire_once' and _k = 1) or (policy = 'skip' and _n = 1)").select(key, "due", "missed")
    if guards is not None:
        out = out.join(guards.where("status is null or status <> 'DEAD'").select(key, "due").distinct(), [key, "due"], "left_anti")
    return out


def advanced(plans: DataFrame, now: str) -> DataFrame:
    """``plans`` with next: the first point after the later of ``now`` and the last fire, null beyond the schedule's term. An interval's points stay in step with the last fire."""
    rows = plans.withColumn("_ref", F.greatest(F.col("last"), _instant(now)))
    gone = F.expr("greatest(0, floor((unix_micros(cast(_ref as timestamp)) - unix_micros(cast(last as timestamp))) / 1000000 / seconds))")
    rows = rows.withColumn("_ref", F.when(F.col("cron").isNull(), F.col("last") + F.make_dt_interval(secs=gone * F.col("seconds"))).otherwise(F.col("_ref")))
    found = schedules.next_fires(rows, "_ref", "cron", "seconds", into="next").drop("_ref")
    if "stops" in plans.columns:
        found = found.withColumn("next", F.expr("if(stops is null or next <= stops, next, null)"))
    return found


def reconciled(guards: DataFrame, online: DataFrame, instances: DataFrame, now: str, grace_s: int, timeout_s: int, key: str = "task_id") -> DataFrame:
    """``guards`` (key, due, made, instance, status) that no instance came of within ``grace_s`` seconds, with an action and the business date, the day before the due one.

    DEAD: made more than ``timeout_s`` seconds ago, or the schedule isn't ``online`` (key); FILLED: ``instances`` (key, due) has one, which takes the guard's
    place; else REPLAY. Guards that have an instance or are DEAD already are left out.
    """
    stale = guards.where(F.col("instance").isNull() & (F.col("status") != "DEAD") & (F.col("made") < _instant(now, -grace_s)))
    rows = stale.join(online.select(key).distinct().withColumn("_on", F.lit(True)), key, "left").join(instances.select(key, "due").distinct().withColumn("_there", F.lit(True)), [key, "due"], "left")
    action = F.when((F.col("made") < _instant(now, -timeout_s)) | F.col("_on").isNull(), "DEAD").when(F.col("_there"), "FILLED").otherwise("REPLAY")
    return rows.withColumn("action", action).withColumn("biz_date", F.date_sub(F.to_date("due"), 1).cast("string")).drop("_on", "_there")
