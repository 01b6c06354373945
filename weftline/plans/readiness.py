"""Readiness, backfill and scheduling rules over runs and their graphs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import fires as fire
from weftline.operators import readiness as r
from weftline.functions import schedules
from weftline.registry import Registry

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_UNMET = "SELECT n.run_id, n.node, count(*) FILTER (WHERE e.src IS NOT NULL AND NOT (e.src_state = 'SUCCESS' OR (e.strength = 'WEAK' AND e.src_state = 'FAILED'))) AS unmet FROM dag_node n LEFT JOIN dag_edge e ON e.run_id = n.run_id AND e.dst = n.node GROUP BY n.run_id, n.node"
_CROSS = "SELECT i.id, CASE WHEN EXISTS (SELECT 1 FROM inst p WHERE p.task_id = i.task_id AND p.state = 'SUCCESS' AND CAST(p.biz_date AS DATE) = CAST(i.biz_date AS DATE) - 1) OR i.biz_date < '2024-01-03' THEN 0 ELSE 1 END AS unmet FROM inst i WHERE i.state = 'WAITING'"


def _unmet(t):
    return r.unmet_upstream(t.dag_node().select("run_id", "node"), t.dag_edge())


def _cross(t):
    inst = t.inst()
    return r.unmet_cross_cycle(inst.where("state = 'WAITING'").select("id", "task_id", "biz_date"), inst, "2024-01-03")


@_r.query("rdy_01_unmet_upstream", _UNMET)
def unmet(t):
    return _unmet(t)


@_r.query("rdy_02_unmet_cross_cycle", _CROSS)
def cross(t):
    return _cross(t).select("id", "unmet")


@_r.query("rdy_03_total_unmet", f"SELECT i.task_id, i.id, greatest(0, c.unmet + coalesce(u.unmet, 0)) AS unmet FROM inst i JOIN ({_CROSS}) c ON c.id = i.id LEFT JOIN (SELECT run_id, sum(unmet)::BIGINT AS unmet FROM ({_UNMET}) GROUP BY 1) u ON u.run_id = i.id")
def total(t):
    inside = _unmet(t).groupBy(F.col("run_id").alias("id")).agg(F.sum("unmet").alias("u"))
    return _cross(t).join(inside, "id", "left").select("task_id", "id", F.greatest(F.lit(0), F.col("unmet") + F.coalesce("u", F.lit(0))).alias("unmet"))


@_r.query("rdy_04_affected", "SELECT DISTINCT w.id FROM inst d JOIN inst w ON w.task_id = d.task_id AND w.state = 'WAITING' AND (w.biz_date = d.biz_date OR CAST(w.biz_date AS DATE) = CAST(d.biz_date AS DATE) + 1) WHERE d.state IN ('SUCCESS', 'FAILED') AND d.biz_date = '2024-01-15'")
def affected(t):
    inst = t.inst()
    return r.affected(inst.where("state in ('SUCCESS', 'FAILED') and biz_date = '2024-01-15'"), inst.where("state = 'WAITING'"))


@_r.query("rdy_06_drift_audit", f"SELECT run_id, node, unmet FROM ({_UNMET}) WHERE unmet <> CASE WHEN run_id % 9 = 0 THEN 1 ELSE unmet END")
def audit(t):
    stored = _unmet(t).withColumn("unmet", F.when(F.col("run_id") % 9 == 0, 1).otherwise(F.col("unmet")))
    return r.drift(stored, _unmet(t), ["run_id", "node"], "unmet")


@_r.query("rdy_07_claimable", f"SELECT i.id, i.priority FROM inst i JOIN ({_CROSS}) c ON c.id = i.id WHERE c.unmet = 0 AND i.node NOT IN ('node-2', 'node-5') ORDER BY i.priority, i.id LIMIT 200")
def claimable(t):
    ready = _cross(t).where("unmet = 0").select("id")
    return t.inst().where("state = 'WAITING' and node not in ('node-2', 'node-5')").join(ready, "id", "left_semi").select("id", "priority").orderBy("priority", "id").limit(200)


_FREE = "SELECT node, 200 - count(*) AS free, CAST(substr(node, 6) AS INTEGER) % 3 AS pool FROM inst WHERE state = 'RUNNING' GROUP BY node"
_QUEUE = "SELECT id, greatest(0, priority - CAST(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(finished_at))) / 86400) AS BIGINT)) AS p, CAST(substr(node, 6) AS INTEGER) % 4 AS pool FROM inst WHERE state = 'WAITING'"


@_r.query("rdy_08_pool_placement", f"WITH q AS (SELECT id, pool, row_number() OVER (PARTITION BY pool ORDER BY p, id) AS k FROM ({_QUEUE})), s AS (SELECT a.pool, a.node, a.l, count(*) AS k FROM (SELECT pool, node, unnest(range(1, free + 1)) AS l FROM ({_FREE})) a JOIN (SELECT pool, node, free FROM ({_FREE}) WHERE free > 0) b ON b.pool = a.pool, LATERAL (SELECT unnest(range(1, b.free + 1)) AS l) c WHERE c.l > a.l OR c.l = a.l AND b.node <= a.node GROUP BY a.pool, a.node, a.l) SELECT q.id, s.node FROM q JOIN s USING (pool, k)")
def pool_placement(t):
    """Pools of several nodes; instances of one more pool, which has no nodes, wait on."""
    number = F.substring("node", 6, 2).cast("int")
    wait = F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) - F.unix_seconds(F.col("finished_at").cast("timestamp"))
    waiting = t.inst().where("state = 'WAITING'").select("id", r.aged("priority", wait).alias("priority"), (number % 4).alias("pool"))
    nodes = t.inst().where("state = 'RUNNING'").groupBy("node").agg((F.lit(200) - F.count("*")).alias("free")).withColumn("pool", number % 3)
    return r.placed(waiting, nodes)


@_r.query("rdy_08_greedy_placement", f"SELECT q.id, 'node-' || q.n AS node FROM (SELECT id, n, row_number() OVER (PARTITION BY n ORDER BY p, id) AS k FROM (SELECT i.id, CAST(substr(i.node, 6) AS INTEGER) AS n, x.p FROM inst i JOIN ({_QUEUE}) x USING (id))) q JOIN ({_FREE}) f ON f.node = 'node-' || q.n WHERE q.k <= f.free")
def placement(t):
    waiting = t.inst().where("state = 'WAITING'").select("id", r.aged("priority", F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) - F.unix_seconds(F.col("finished_at").cast("timestamp"))).alias("priority"), "node")
    nodes = t.inst().where("state = 'RUNNING'").groupBy("node").agg(F.count("*").alias("used"))
    nodes = nodes.select("node", (F.lit(200) - F.col("used")).alias("free")).where("free > 0")
    return r.placed(waiting.withColumn("pool", F.col("node")), nodes.withColumn("pool", F.col("node")))


@_r.query("rdy_09_frozen_nodes", "SELECT n.run_id, n.node, CASE WHEN n.rank >= b.rank THEN 'SKIPPED' WHEN n.worker % 10 = 0 THEN 'SUCCESS' ELSE 'WAITING' END AS state FROM dag_node n LEFT JOIN (SELECT run_id, min(rank) AS rank FROM dag_node WHERE strength = 'WEAK' GROUP BY 1) b ON b.run_id = n.run_id")
def frozen(t):
    first = F.min(F.when(F.col("strength") == "WEAK", F.col("rank"))).over(Window.partitionBy("run_id"))
    return t.dag_node().withColumn("first", first).select("run_id", "node", F.when(F.col("rank") >= F.col("first"), "SKIPPED").when(F.col("worker") % 10 == 0, "SUCCESS").otherwise("WAITING").alias("state"))


@_r.query("rdy_10_backfill_expansion", "SELECT strftime(d, '%Y-%m-%d') AS biz_date, n_nationkey AS task_id FROM (SELECT unnest(generate_series(DATE '2024-02-25', DATE '2024-03-05', INTERVAL 1 DAY)) AS d), nation WHERE n_regionkey IN (1, 2)")
def backfill(t):
    return r.backfill(t.read("nation").where("n_regionkey in (1, 2)").select(F.col("n_nationkey").alias("task_id")), "2024-02-25", "2024-03-05")


@_r.query("rdy_11_preview", "SELECT DISTINCT f.dst AS id, v.name FROM flow f JOIN vertex v ON v.id = f.dst WHERE f.src = 'nation:6'")
def preview(t):
    return t.vertex().join(t.flow().where("src = 'nation:6'").select(F.col("dst").alias("id")), "id", "left_semi").select("id", "name")


@_r.query("rdy_12_timeouts", "SELECT i.id FROM inst i JOIN task t ON t.id = i.task_id WHERE i.state = 'RUNNING' AND epoch_ms(i.finished_at) - epoch_ms(i.started_at) > CASE t.type WHEN 'BUILDING' THEN 20000 ELSE 60000 END AND t.type <> 'MACHINERY'")
def timeouts(t):
    limit = F.when(F.col("type") == "BUILDING", 20000).otherwise(60000)
    tasks = t.task().where("type <> 'MACHINERY'").select(F.col("id").alias("task_id"), limit.alias("limit"))
    return r.timed_out(t.inst().where("state = 'RUNNING'").join(tasks, "task_id"), "limit").select("id")


@_r.query("rdy_13_retries", "SELECT id, CASE WHEN state = 'FAILED' AND priority % 4 <= 2 THEN 'REQUEUE' WHEN state = 'FAILED' THEN 'FAILED' ELSE 'NONE' END AS decision FROM inst")
def retries(t):
    return t.inst().select("id", r.retry(F.col("state"), F.col("priority") % 4, F.lit(2)).alias("decision"))


@_r.query("rdy_14_quarantine", "SELECT node, n AS failures, CASE WHEN n + 1 >= 20 THEN greatest(TIMESTAMP '2024-01-31 00:00:00', last + INTERVAL 1 DAY) END AS until FROM (SELECT node, count(*) AS n, max(finished_at) AS last FROM inst WHERE state = 'FAILED' GROUP BY node)")
def quarantine(t):
    per = t.inst().where("state = 'FAILED'").groupBy("node").agg(F.count("*").alias("failures"), F.max("finished_at").alias("last"))
    until = F.when(F.col("failures") + 1 >= 20, F.greatest(F.expr("timestamp_ntz '2024-01-31 00:00:00'"), F.expr("last + interval 1 day")))
    return per.select("node", "failures", until.alias("until"))


@_r.query("rdy_15_due_schedules", "SELECT DISTINCT task_id, biz_date FROM inst WHERE finished_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11' AND task_id IS NOT NULL")
def due(t):
    return t.inst().where("finished_at between timestamp_ntz '2024-01-10' and timestamp_ntz '2024-01-11' and task_id is not null").select("task_id", "biz_date").dropDuplicates(["task_id", "biz_date"])


@_r.query("rdy_15_due_by_schedule", "SELECT task_id, due, due < TIMESTAMP '2024-01-31 00:00:00' AS missed FROM (SELECT task_id, CASE task_id % 2 WHEN 0 THEN date_trunc('day', max(finished_at)) + INTERVAL 1 DAY ELSE date_trunc('second', max(finished_at)) + INTERVAL 6 HOUR END AS due FROM inst WHERE task_id IS NOT NULL GROUP BY task_id) WHERE due <= TIMESTAMP '2024-01-31 01:00:00'")
def due_by_schedule(t):
    """Next fire of each task after its last, by cron or interval, up to an hour ahead; one row a task and instant."""
    last = t.inst().where("task_id is not null").groupBy("task_id").agg(F.date_trunc("second", F.max("finished_at")).cast("timestamp_ntz").alias("base"))
    last = last.select("task_id", "base", F.when(F.col("task_id") % 2 == 0, "0 0 0 * * ?").alias("cron"), F.lit(6 * 3600).alias("seconds"))
    found = schedules.next_fires(last, "base", "cron", "seconds", into="due").select("task_id", "due").where("due <= timestamp_ntz '2024-01-31 01:00:00'")
    return found.dropDuplicates(["task_id", "due"]).select("task_id", "due", F.expr("due < timestamp_ntz '2024-01-31 00:00:00'").alias("missed"))


#: Crons with seconds 0, and the same rules over a tick of a quarter of an hour, for the SQL.
_CRONS = {
    "0 0 0 * * ?": "hour(d) = 0 AND minute(d) = 0",
    "0 30 */6 * * ?": "hour(d) % 6 = 0 AND minute(d) = 30",
    "0 0 12 ? * MON-FRI/2": "dayofweek(d) IN (1, 3, 5) AND hour(d) = 12 AND minute(d) = 0",
    "0 15,45 8-10 1,15,29 JAN,MAR ?": "month(d) IN (1, 3) AND day(d) IN (1, 15, 29) AND hour(d) BETWEEN 8 AND 10 AND minute(d) IN (15, 45)",
}
_NOW = "2024-01-31 00:00:00"
_FIRED = "SELECT task_id, date_trunc('second', max(finished_at)) AS last, count(*) AS n FROM inst WHERE task_id IS NOT NULL AND finished_at < TIMESTAMP '2024-01-28' GROUP BY task_id"
_PLANNED = f"SELECT *, task_id % 5 AS kind, CASE WHEN task_id % 3 = 0 THEN 'all' WHEN task_id % 3 = 1 THEN 'fire_once' ELSE 'skip' END AS policy, CASE WHEN task_id % 7 = 0 THEN TIMESTAMP '2024-01-29' END AS stops FROM ({_FIRED})"
_TICKS = "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 15 MINUTE)) AS d"
_POINTS = " UNION ALL ".join([f"SELECT p.*, d AS due FROM p, ticks WHERE kind = {k} AND {rule} AND d > last" for k, rule in enumerate(_CRONS.values())] + ["SELECT p.*, last + to_seconds(9000 * k) AS due FROM p, (SELECT unnest(range(1, 800)) AS k) WHERE kind = 4"])
_DUE = f"""WITH p AS ({_PLANNED}), ticks AS ({_TICKS}), points AS (SELECT *, due <= TIMESTAMP '{_NOW}' AS missed FROM ({_POINTS}) WHERE stops IS NULL OR due <= stops),
    placed AS (SELECT *, row_number() OVER (PARTITION BY task_id, missed ORDER BY due) AS k, count(*) OVER (PARTITION BY task_id, missed) AS n_missed FROM points WHERE due <= TIMESTAMP '{_NOW}' + INTERVAL 1 DAY)
    SELECT task_id, due, missed FROM placed WHERE NOT missed OR policy = 'all' OR policy = 'fire_once' AND k = 1 OR policy = 'skip' AND n_missed = 1"""


def _planned(t):
    """Each task with its last fire before three days without a scheduler."""
    rows = t.inst().where("task_id is not null and finished_at < timestamp_ntz '2024-01-28'").groupBy("task_id").agg(F.date_trunc("second", F.max("finished_at")).cast("timestamp_ntz").alias("last"))
    cron = F.element_at(F.array(*map(F.lit, _CRONS), F.lit(None)), (F.col("task_id") % 5 + 1).cast("int"))
    policy = F.element_at(F.array(F.lit("all"), F.lit("fire_once"), F.lit("skip")), (F.col("task_id") % 3 + 1).cast("int"))
    return rows.select("task_id", "last", cron.alias("cron"), F.lit(9000).alias("seconds"), policy.alias("policy"), F.expr("if(task_id % 7 = 0, timestamp_ntz '2024-01-29', null)").alias("stops"))


@_r.query("rdy_15_missed_fires", _DUE)
def missed_fires(t):
    """What a scheduler arms that comes back after three days: points missed by then, as each task's policy says, and those of the day ahead."""
    return fire.due(_planned(t), _NOW, ahead_s=86400).select("task_id", "due", "missed")


@_r.query("rdy_15_next_trigger", f"WITH p AS ({_PLANNED}), ticks AS ({_TICKS}) SELECT task_id, CASE WHEN stops IS NULL OR next <= stops THEN next END AS next FROM p LEFT JOIN (SELECT task_id, min(due) AS next FROM ({_POINTS}) WHERE due > TIMESTAMP '{_NOW}' GROUP BY 1) USING (task_id)")
def next_trigger(t):
    return fire.advanced(_planned(t), _NOW).select("task_id", "next")


_GUARDS = f"SELECT d.task_id, d.due, d.due + to_seconds(o % 90) AS made, o % 4 = 0 AS filled, CASE WHEN o % 11 = 0 THEN 'DEAD' WHEN o % 4 = 0 THEN 'FIRED' ELSE 'PENDING' END AS status FROM (SELECT *, task_id + day(due) AS o FROM ({_DUE}) WHERE missed) d"


@_r.query("rdy_16_reconciled", f"SELECT g.task_id, g.due, CASE WHEN g.made < TIMESTAMP '{_NOW}' - INTERVAL 2 DAY THEN 'DEAD' WHEN t.id IS NULL OR t.type = 'BUILDING' THEN 'DEAD' WHEN EXISTS (SELECT 1 FROM inst i WHERE i.task_id = g.task_id AND i.biz_date = strftime(g.due - INTERVAL 1 DAY, '%Y-%m-%d')) THEN 'FILLED' ELSE 'REPLAY' END AS action, strftime(g.due - INTERVAL 1 DAY, '%Y-%m-%d') AS biz_date FROM ({_GUARDS}) g LEFT JOIN task t ON t.id = g.task_id WHERE NOT g.filled AND g.status <> 'DEAD' AND g.made < TIMESTAMP '{_NOW}' - INTERVAL 1 HOUR")
def reconciled(t):
    """Guards of missed fires that no instance came of in time: instances of the business date fill them, tasks of a type that is off line are given up."""
    o = F.col("task_id") + F.day("due")
    guards = fire.due(_planned(t), _NOW, ahead_s=86400).where("missed").select("task_id", "due", (F.col("due") + F.make_dt_interval(secs=o % 90)).alias("made"), F.when(o % 4 == 0, "i").alias("instance"), F.when(o % 11 == 0, "DEAD").when(o % 4 == 0, "FIRED").otherwise("PENDING").alias("status"))
    online = t.task().where("type <> 'BUILDING'").select(F.col("id").alias("task_id"))
    filled = t.inst().select("task_id", F.expr("cast(biz_date as timestamp_ntz)").alias("day"))
    there = guards.select("task_id", "due").distinct().join(filled.distinct(), [filled["task_id"] == guards["task_id"], F.to_date("day") == F.date_sub(F.to_date("due"), 1)], "left_semi")
    return fire.reconciled(guards, online, there, _NOW, grace_s=3600, timeout_s=2 * 86400).select("task_id", "due", "action", "biz_date")


@_r.query("rdy_16_lost_fires", "SELECT r.id, CASE WHEN i.task_id IS NOT NULL THEN 'FILLED' WHEN r.priority <= 2 THEN 'REPLAY' WHEN r.priority = 3 THEN 'SKIP' ELSE 'DEAD' END AS action FROM run r LEFT JOIN (SELECT DISTINCT task_id FROM inst WHERE state = 'SUCCESS') i ON i.task_id = r.task_id WHERE r.state = 'WAITING'")
def lost(t):
    filled = t.inst().where("state = 'SUCCESS'").select("task_id").distinct().withColumn("filled", F.lit(True))
    action = F.when(F.col("filled"), "FILLED").when(F.col("priority") <= 2, "REPLAY").when(F.col("priority") == 3, "SKIP").otherwise("DEAD")
    return t.run().where("state = 'WAITING'").join(filled, "task_id", "left").select("id", action.alias("action"))


@_r.query("rdy_17_stale_nodes", "SELECT node, max(finished_at) < TIMESTAMP '2024-01-30 12:00:00' AS offline, count(*) FILTER (WHERE state = 'WAITING' AND finished_at < TIMESTAMP '2024-01-20') AS starved FROM inst GROUP BY node")
def stale(t):
    return t.inst().groupBy("node").agg((F.max("finished_at") < F.expr("timestamp_ntz '2024-01-30 12:00:00'")).alias("offline"), F.count_if((F.col("state") == "WAITING") & (F.col("finished_at") < F.expr("timestamp_ntz '2024-01-20'"))).alias("starved"))


@_r.query("rdy_18_policy_level", "SELECT p_partkey AS id, CASE WHEN starts_with(p_type, 'PROMO') THEN 'BLOCK' WHEN starts_with(p_type, 'STANDARD') THEN 'REVIEW' WHEN p_size > 40 THEN 'REVIEW' ELSE 'AUTO' END AS level FROM part")
def policy(t):
    rules = [("PROMO", "BLOCK"), ("STANDARD", "REVIEW"), ("STANDARD POLISHED", "AUTO")]
    return t.read("part").select(F.col("p_partkey").alias("id"), r.policy(F.col("p_type"), rules, F.col("p_size") > 40).alias("level"))


@_r.query("scl_12_aged_priority", "SELECT id, greatest(0, priority - CAST(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(finished_at))) / 86400) AS BIGINT)) AS aged FROM inst")
def aged(t):
    wait = F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) - F.unix_seconds(F.col("finished_at").cast("timestamp"))
    return t.inst().select("id", r.aged("priority", wait).alias("aged"))
