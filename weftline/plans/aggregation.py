"""Freshness, service-level, progress and scheduler-metric queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.adapt import AS_OF
from weftline.operators import filters as flt
from weftline.operators import freshness as f
from weftline.registry import Registry

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_TIER = f"CASE WHEN last_success IS NULL THEN 'NEVER' WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', last_success)) <= 21600 THEN 'FRESH' WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', last_success)) <= 86400 THEN 'AGING' ELSE 'STALE' END"
_TIERS = f"SELECT id, name, project_id, last_success, {_TIER} AS tier, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', last_success))) / 3600) AS BIGINT) AS age_hours FROM task LEFT JOIN (SELECT task_id, max(finished_at) FILTER (WHERE state = 'SUCCESS') AS last_success FROM inst GROUP BY task_id) ON id = task_id"


def _tiers(t):
    return f.tiers(t.task(), t.inst(), AS_OF)


@_r.query("agg_01_freshness_tiers", f"SELECT id, name, tier, last_success FROM ({_TIERS})")
def tiers(t):
    rank = F.when(F.col("tier") == "NEVER", 0).when(F.col("tier") == "STALE", 1).when(F.col("tier") == "AGING", 2).otherwise(3)
    return _tiers(t).orderBy(rank, F.col("last_success").asc_nulls_first(), "id").select("id", "name", "tier", "last_success")


@_r.query("srt_03_worst_first", f"SELECT id, tier FROM ({_TIERS}) ORDER BY CASE tier WHEN 'NEVER' THEN 0 WHEN 'STALE' THEN 1 WHEN 'AGING' THEN 2 ELSE 3 END DESC, last_success DESC NULLS LAST, id LIMIT 60")
def best_first(t):
    rank = F.when(F.col("tier") == "NEVER", 0).when(F.col("tier") == "STALE", 1).when(F.col("tier") == "AGING", 2).otherwise(3)
    return _tiers(t).orderBy(rank.desc(), F.col("last_success").desc_nulls_last(), "id").limit(60).select("id", "tier")


@_r.query("agg_02_tier_distribution", f"SELECT count(*) FILTER (WHERE tier = 'NEVER') AS never, count(*) FILTER (WHERE tier = 'FRESH') AS fresh, count(*) FILTER (WHERE tier = 'AGING') AS aging, count(*) FILTER (WHERE tier = 'STALE') AS stale, count(*) AS total FROM ({_TIERS})")
def distribution(t):
    return f.tier_counts(_tiers(t))


@_r.query("agg_03_day_over_day", "WITH d AS (SELECT CAST(biz_date AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE state = 'SUCCESS') AS good FROM inst GROUP BY 1) SELECT a.day, a.n - b.n AS n_delta, a.good - b.good AS good_delta FROM d a LEFT JOIN d b ON b.day = a.day - 1")
def deltas(t):
    d = t.inst().groupBy(F.to_date("biz_date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "SUCCESS").alias("good"))
    before = d.select(F.date_add("day", 1).alias("day"), F.col("n").alias("n0"), F.col("good").alias("good0"))
    return d.join(before, "day", "left").select("day", (F.col("n") - F.col("n0")).alias("n_delta"), (F.col("good") - F.col("good0")).alias("good_delta"))


@_r.query("agg_04_trend_array", "WITH s AS (SELECT task_id, biz_date, CASE max(CASE state WHEN 'SUCCESS' THEN 4 WHEN 'RUNNING' THEN 3 WHEN 'WAITING' THEN 2 ELSE 1 END) WHEN 4 THEN 4 WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS score FROM inst WHERE biz_date >= '2024-01-24' GROUP BY ALL) SELECT id, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY biz_date), '') AS trend FROM task LEFT JOIN s ON id = task_id GROUP BY id")
def trend(t):
    score = F.max(F.when(F.col("state") == "SUCCESS", 4).when(F.col("state") == "RUNNING", 3).when(F.col("state") == "WAITING", 2).otherwise(1))
    days = t.inst().where("biz_date >= '2024-01-24'").groupBy("task_id", "biz_date").agg(score.alias("score"))
    seven = days.groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("biz_date", "score"))), lambda x: x["score"].cast("string")).alias("a"))
    return t.task().join(seven, F.col("id") == F.col("task_id"), "left").select("id", F.coalesce(F.array_join("a", ","), F.lit("")).alias("trend"))


@_r.query("agg_05_age_hours", f"SELECT id, age_hours FROM ({_TIERS})")
def ages(t):
    return _tiers(t).select("id", "age_hours")


@_r.query("agg_06_dashboard_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE state = 'SUCCESS') AS success, count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) FILTER (WHERE state NOT IN ('SUCCESS', 'FAILED')) AS running FROM run")
def dashboard(t):
    return t.run().agg(*(c.alias(k) for k, c in f.progress().items()))


_PROGRESS = "SELECT task_id, count(*) AS total, count(*) FILTER (WHERE state = 'SUCCESS') AS success, count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) FILTER (WHERE state NOT IN ('SUCCESS', 'FAILED')) AS running FROM run GROUP BY task_id"


def _progress(t):
    return t.run().groupBy("task_id").agg(*(c.alias(k) for k, c in f.progress().items()))


@_r.query("agg_07_progress", _PROGRESS)
def progress(t):
    return _progress(t)


@_r.query("agg_08_distinct_dates", "SELECT task_id, count(DISTINCT CASE WHEN state = 'WAITING' THEN biz_date END) AS active, count(DISTINCT CASE WHEN state = 'FAILED' THEN biz_date END) AS held FROM run GROUP BY task_id")
def distinct_dates(t):
    dates = lambda s: F.count_distinct(F.when(F.col("state") == s, F.col("biz_date")))
    return t.run().groupBy("task_id").agg(dates("WAITING").alias("active"), dates("FAILED").alias("held"))


@_r.query("agg_09_run_state", f"SELECT task_id, CASE WHEN running > 0 THEN 'RUNNING' WHEN failed = 0 THEN 'SUCCESS' WHEN success = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS state FROM ({_PROGRESS})")
def run_state(t):
    return _progress(t).select("task_id", f.overall().alias("state"))


@_r.query("agg_10_workflow_state", "SELECT task_id, CASE WHEN bool_or(state = 'RUNNING') THEN 'RUNNING' WHEN bool_or(state = 'FAILED') THEN 'FAILED' WHEN bool_or(state = 'STOPPED') THEN 'STOPPED' WHEN bool_or(state = 'WAITING') THEN 'WAITING' ELSE 'SUCCESS' END AS state FROM inst WHERE priority < 9 GROUP BY task_id")
def workflow_states(t):
    return t.inst().where("priority < 9").groupBy("task_id").agg(f.workflow_state().alias("state"))


@_r.query("agg_11_completed_counts", "SELECT task_id, count(*) FILTER (WHERE state IN ('SUCCESS', 'STOPPED')) AS completed, count(*) FILTER (WHERE state = 'FAILED') AS failed FROM inst GROUP BY task_id")
def completed(t):
    return t.inst().groupBy("task_id").agg(F.count_if(F.col("state").isin("SUCCESS", "STOPPED")).alias("completed"), F.count_if(F.col("state") == "FAILED").alias("failed"))


@_r.query("agg_12_used_slots", "SELECT node, count(*) AS used FROM inst WHERE state = 'RUNNING' GROUP BY node")
def used_slots(t):
    return t.inst().where("state = 'RUNNING'").groupBy("node").agg(F.count("*").alias("used"))


@_r.query("agg_13_slot_utilisation", "SELECT node, CASE WHEN count(*) = 0 THEN 0 ELSE CAST(count(*) FILTER (WHERE state = 'RUNNING') * 1000 // count(*) AS DOUBLE) / 1000 END AS used_share FROM inst GROUP BY node")
def utilisation(t):
    used, total = F.count_if(F.col("state") == "RUNNING"), F.count("*")
    return t.inst().groupBy("node").agg((F.floor(used * 1000 / total) / 1000).alias("used_share"))


@_r.query("agg_14_fragmented", "SELECT (SELECT count(*) FROM supplier) * 8 - (SELECT count(*) FROM inst WHERE state = 'RUNNING') > 0 AND NOT EXISTS (SELECT 1 FROM inst WHERE state = 'WAITING' AND priority < 0) AS fragmented")
def fragmented(t):
    capacity = t.read("supplier").agg((F.count("*") * 8).alias("slots"))
    load = t.inst().agg(F.count_if(F.col("state") == "RUNNING").alias("used"), F.count_if((F.col("state") == "WAITING") & (F.col("priority") < 0)).alias("waiting"))
    return capacity.join(load).select(((F.col("slots") - F.col("used") > 0) & (F.col("waiting") == 0)).alias("fragmented"))


@_r.query("agg_15_queue_depth", f"SELECT priority, count(*) AS depth, CAST(epoch(TIMESTAMP '{AS_OF}') - min(floor(epoch(finished_at))) AS BIGINT) AS oldest_s FROM inst WHERE state = 'WAITING' GROUP BY priority")
def queue(t):
    now = F.unix_seconds(F.lit(AS_OF).cast("timestamp"))
    return t.inst().where("state = 'WAITING'").groupBy("priority").agg(F.count("*").alias("depth"), (now - F.min(F.unix_seconds(F.col("finished_at").cast("timestamp")))).alias("oldest_s"))


@_r.query("agg_16_conditional_sums", "SELECT coalesce(sum(priority) FILTER (WHERE state = 'FAILED'), 0)::BIGINT AS redispatched, count(*) FILTER (WHERE state = 'STOPPED') AS suspended, count(*) FILTER (WHERE node = 'node-3' AND state = 'FAILED') AS quarantined, coalesce(sum(priority) FILTER (WHERE state = 'NONE'), 0)::BIGINT AS recovering FROM inst")
def conditional(t):
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("priority"))), F.lit(0))
    state = F.col("state")
    return t.inst().agg(total(state == "FAILED").alias("redispatched"), F.count_if(state == "STOPPED").alias("suspended"), F.count_if((F.col("node") == "node-3") & (state == "FAILED")).alias("quarantined"), total(state == "NONE").alias("recovering"))


_MS = "SELECT state, epoch_ms(finished_at) - epoch_ms(started_at) AS ms FROM inst"


def _ms(t):
    return t.inst().select("state", flt.duration_ms("started_at", "finished_at").alias("ms"))


@_r.query("agg_17_timer_percentiles", f"SELECT state, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99, round(avg(ms), 3) AS mean FROM ({_MS}) GROUP BY state")
def percentiles(t):
    return _ms(t).groupBy("state").agg(*(F.percentile("ms", p / 100).alias(f"p{p}") for p in (50, 95, 99)), F.round(F.avg("ms"), 3).alias("mean"))


@_r.query("agg_17_timer_tail", f"SELECT state, quantile_cont(ms, 0.999) AS p999, max(ms) AS longest FROM ({_MS}) GROUP BY state")
def timer_tail(t):
    return _ms(t).groupBy("state").agg(F.percentile("ms", 0.999).alias("p999"), F.max("ms").alias("longest"))


@_r.query("agg_18_timer_buckets", f"SELECT state, count(*) FILTER (WHERE ms <= 100) AS le_100, count(*) FILTER (WHERE ms <= 1000) AS le_1000, count(*) FILTER (WHERE ms <= 5000) AS le_5000, count(*) FILTER (WHERE ms <= 60000) AS le_60000 FROM ({_MS}) GROUP BY state")
def timer_buckets(t):
    return _ms(t).groupBy("state").agg(*(F.count_if(F.col("ms") <= b).alias(f"le_{b}") for b in (100, 1000, 5000, 60000)))


_READY = "SELECT task_id, id, CAST(floor(epoch(finished_at)) AS BIGINT) AS s, row_number() OVER (PARTITION BY task_id ORDER BY biz_date DESC, id DESC) AS k FROM inst WHERE state = 'SUCCESS'"


def _ready(t, n):
    done = t.inst().where("state = 'SUCCESS'").withColumn("s", F.unix_seconds(F.col("finished_at").cast("timestamp")))
    return f.last_n(done, "task_id", F.col("biz_date").desc(), n)


@_r.query("agg_19_median_ready", f"SELECT task_id, CAST(floor(median(s)) AS BIGINT) AS ready_s FROM ({_READY}) WHERE k <= 7 GROUP BY task_id")
def median_ready(t):
    return _ready(t, 7).groupBy("task_id").agg(f.whole_median("s").alias("ready_s"))


_TOOK = "SELECT task_id, median_s FROM (SELECT task_id, CAST(floor(median(ms // 1000)) AS BIGINT) AS median_s FROM (SELECT task_id, epoch_ms(finished_at) - epoch_ms(started_at) AS ms, row_number() OVER (PARTITION BY task_id ORDER BY finished_at DESC, id DESC) AS k FROM inst WHERE state = 'SUCCESS') WHERE k <= 10 AND ms >= 0 GROUP BY task_id)"


def _took(t):
    done = f.last_n(t.inst().where("state = 'SUCCESS'"), "task_id", F.col("finished_at").desc(), 10)
    took = done.withColumn("took", F.expr("(unix_millis(cast(finished_at as timestamp)) - unix_millis(cast(started_at as timestamp))) div 1000")).where("took >= 0")
    return took.groupBy("task_id").agg(f.whole_median("took").alias("median_s"))


@_r.query("agg_20_median_duration", _TOOK)
def median_duration(t):
    return _took(t)


@_r.query("agg_21_sla_breach", f"WITH r AS ({_READY}), m AS (SELECT task_id, CAST(floor(median(s % 86400)) AS BIGINT) AS usual, count(*) AS n FROM r WHERE k BETWEEN 2 AND 8 GROUP BY task_id) SELECT r.task_id, r.s % 86400 AS now_s, usual, n >= 3 AND (r.s % 86400 - usual) > 1800 AS breached FROM r JOIN m USING (task_id) WHERE k = 1")
def breach(t):
    by = Window.partitionBy("task_id").orderBy(F.col("biz_date").desc(), F.col("id").desc())
    done = t.inst().where("state = 'SUCCESS'").select("task_id", "id", (F.unix_seconds(F.col("finished_at").cast("timestamp")) % 86400).alias("s"), F.row_number().over(by).alias("k"))
    per = done.where("k <= 8").groupBy("task_id").agg(F.max(F.when(F.col("k") == 1, F.col("s"))).alias("now_s"), F.floor(F.percentile(F.when(F.col("k") > 1, F.col("s")), 0.5)).cast("long").alias("usual"), F.count_if(F.col("k") > 1).alias("n"))
    return per.where("n > 0").select("task_id", "now_s", "usual", ((F.col("n") >= 3) & (F.col("now_s") - F.col("usual") > 1800)).alias("breached"))


@_r.query("agg_22_latest_eta", f"SELECT i.node, count(*) AS running, count(median_s) AS predicted, CAST(max(greatest(floor(epoch(started_at)) + median_s, epoch(TIMESTAMP '{AS_OF}'))) AS BIGINT) AS eta_s FROM inst i LEFT JOIN ({_TOOK}) m ON i.task_id = m.task_id WHERE state = 'RUNNING' GROUP BY i.node")
def eta(t):
    rows = t.inst().where("state = 'RUNNING'").join(_took(t), "task_id", "left")
    ends = F.unix_seconds(F.col("started_at").cast("timestamp")) + F.col("median_s")
    ends = F.when(F.col("median_s").isNotNull(), F.greatest(ends, F.unix_seconds(F.lit(AS_OF).cast("timestamp"))))
    return rows.groupBy("node").agg(F.count("*").alias("running"), F.count("median_s").alias("predicted"), F.max(ends).alias("eta_s"))


METRICS = {"gmv": ("sum(cents)", "run"), "run_count": ("count(*)", "run"), "failed_share_permille": ("count_if(state = 'FAILED') * 1000 div count(*)", "run")}


@_r.query("agg_23_atomic_metrics", "SELECT CAST(sum(cents) AS BIGINT) AS gmv, count(*) AS run_count, count(*) FILTER (WHERE state = 'FAILED') * 1000 // count(*) AS failed_share_permille FROM run WHERE biz_date >= '1997-01-01' AND biz_date <= '1997-12-31'")
def metrics(t):
    rows = t.run().where("biz_date >= '1997-01-01' and biz_date <= '1997-12-31'")
    return rows.agg(*(F.expr(m).alias(k) for k, (m, _) in METRICS.items()))


@_r.query("agg_24_folder_counts", "SELECT CASE WHEN id % 4 <> 0 THEN project_id END AS folder, count(*) AS n FROM task GROUP BY 1")
def folders(t):
    return t.task().groupBy(F.when(F.col("id") % 4 != 0, F.col("project_id")).alias("folder")).agg(F.count("*").alias("n"))


@_r.query("agg_25_next_ordinal", "SELECT t.id, coalesce(max(i.priority), 0) + 1 AS next FROM task t LEFT JOIN inst i ON i.task_id = t.id AND i.state = 'SUCCESS' GROUP BY t.id")
def ordinal(t):
    top = t.inst().where("state = 'SUCCESS'").groupBy("task_id").agg(F.max("priority").alias("m"))
    return t.task().join(top, F.col("id") == F.col("task_id"), "left").select("id", (F.coalesce("m", F.lit(0)) + 1).alias("next"))


@_r.query("agg_26_rows_synced", "SELECT CAST(sum(l_quantity) AS BIGINT) AS rows_synced FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-05-01' AND l_shipdate < TIMESTAMP '1997-05-02'")
def synced(t):
    return t.read("lineitem").where("l_shipdate >= timestamp_ntz '1997-05-01' and l_shipdate < timestamp_ntz '1997-05-02'").agg(F.sum("l_quantity").cast("long").alias("rows_synced"))


@_r.query("agg_27_failures_by_node", "SELECT task_id, node, count(*) AS failures FROM inst WHERE state = 'FAILED' AND finished_at >= TIMESTAMP '2024-01-24' GROUP BY ALL")
def failures(t):
    return t.inst().where("state = 'FAILED' and finished_at >= timestamp_ntz '2024-01-24'").groupBy("task_id", "node").agg(F.count("*").alias("failures"))


@_r.query("agg_28_table_rollup", "SELECT v.id, count(DISTINCT f.task_id) AS producers, string_agg(DISTINCT CAST(f.task_id AS VARCHAR), ',' ORDER BY CAST(f.task_id AS VARCHAR)) AS producer_list, count(f.src) AS inputs, max(f.confidence) AS top FROM vertex v LEFT JOIN flow f ON f.dst = v.id GROUP BY v.id")
def rollup(t):
    per = t.flow().groupBy("dst").agg(F.count_distinct("task_id").alias("producers"), F.array_join(F.sort_array(F.transform(F.collect_set("task_id"), lambda x: x.cast("string"))), ",").alias("producer_list"), F.count("*").alias("inputs"), F.max("confidence").alias("top"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.vertex().join(per, F.col("id") == F.col("dst"), "left").select("id", zero("producers"), "producer_list", zero("inputs"), "top")


@_r.query("agg_29_min_priority", "SELECT node, min(priority) AS least FROM inst WHERE state = 'WAITING' AND task_id NOT IN (SELECT task_id FROM inst WHERE state = 'FAILED' AND task_id IS NOT NULL) GROUP BY node")
def least_priority(t):
    inst = t.inst()
    return inst.where("state = 'WAITING'").join(inst.where("state = 'FAILED'").select("task_id"), "task_id", "left_anti").groupBy("node").agg(F.min("priority").alias("least"))


@_r.query("agg_30_open_counts", f"SELECT count(*) FILTER (WHERE state = 'FAILED') AS open_n, count(*) FILTER (WHERE biz_date = '2024-01-30') AS today, count(*) FILTER (WHERE state = 'RUNNING') > 0 AS any_running FROM inst WHERE finished_at <= TIMESTAMP '{AS_OF}'")
def open_counts(t):
    rows = t.inst().where(f"finished_at <= timestamp_ntz '{AS_OF}'")
    return rows.agg(F.count_if(F.col("state") == "FAILED").alias("open_n"), F.count_if(F.col("biz_date") == "2024-01-30").alias("today"), (F.count_if(F.col("state") == "RUNNING") > 0).alias("any_running"))


@_r.query("agg_33_cost_projection", "SELECT lang, round(avg(n_chars) / 4, 4) AS mean_tokens, round(avg(n_chars) / 4 * count(*) * CASE lang WHEN 'en' THEN 2 ELSE 3 END / 1000, 3) AS cost FROM documents GROUP BY lang")
def cost(t):
    price = F.when(F.col("lang") == "en", 2).otherwise(3)
    per = t.read("documents").groupBy("lang").agg((F.avg("n_chars") / 4).alias("m"), F.count("*").alias("n"))
    return per.select("lang", F.round("m", 4).alias("mean_tokens"), F.round(F.col("m") * F.col("n") * price / 1000, 3).alias("cost"))


