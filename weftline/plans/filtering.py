"""Filter, projection, order and page queries over tasks and runs."""

from pyspark.sql import functions as F

from weftline.adapt import RUN_AS_OF
from weftline.operators import filters as f
from weftline.registry import Registry

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


@_r.query("src_01_scoped_scan", "SELECT id, name, type FROM task WHERE project_id = 7")
def scoped(t):
    return t.task().where("project_id = 7").select("id", "name", "type")


@_r.query("src_02_derived_scan", "SELECT id, priority FROM run WHERE state = 'FAILED' AND task_id = 1")
def derived(t):
    return t.run().where("state = 'FAILED' and task_id = 1").select("id", "priority")


@_r.query("src_03_shard_scan", "SELECT id, state FROM run WHERE state IN ('WAITING', 'FAILED') AND started_at <= TIMESTAMP '1998-01-01' AND id % 7 = 3")
def shard(t):
    return t.run().where("state in ('WAITING', 'FAILED') and started_at <= timestamp_ntz '1998-01-01' and pmod(id, 7) = 3").select("id", "state")


@_r.query("flt_01_optional_conjuncts", "SELECT id, state, priority FROM run WHERE state IN ('FAILED', 'WAITING') AND biz_date >= '1996-01-01' AND priority = 1")
def conjuncts(t):
    given = {"state": "FAILED, WAITING,", "date_from": "1996-01-01", "date_to": None, "priority": 1, "keyword": None}
    ok = f.every([f.one_of("state", given["state"]), f.between("biz_date", given["date_from"], given["date_to"]), F.col("priority") == given["priority"], f.infix(given["keyword"], "label")])
    return t.run().where(ok).select("id", "state", "priority")


@_r.query("flt_02_csv_in", "SELECT id, type FROM task WHERE type IN ('BUILDING', 'MACHINERY')")
def csv_in(t):
    return t.task().where(f.one_of("type", " BUILDING,MACHINERY ,")).select("id", "type")


@_r.query("flt_03_inclusive_range", "SELECT id, biz_date FROM run WHERE biz_date >= '1997-03-01' AND biz_date <= '1997-03-31' AND started_at >= TIMESTAMP '1997-03-05'")
def inclusive(t):
    ok = f.every([f.between("biz_date", "1997-03-01", "1997-03-31"), f.between("started_at", F.expr("timestamp_ntz '1997-03-05'"))])
    return t.run().where(ok).select("id", "biz_date")


@_r.query("flt_04_infix_like", "SELECT id, name FROM task WHERE name LIKE '%00_1%' OR type LIKE '%00_1%'")
def infix(t):
    return t.task().where(f.infix("00_1", "name", "type")).select("id", "name")


@_r.query("flt_05_infix_on_id", "SELECT id FROM run WHERE CAST(id AS VARCHAR) LIKE '%99%'")
def infix_id(t):
    return t.run().where(f.infix("99", "id")).select("id")


@_r.query("flt_06_any_case_having", "SELECT type, count(*) AS n FROM task GROUP BY type HAVING upper(type) LIKE '%BUILD%'")
def any_case(t):
    return t.task().groupBy("type").agg(F.count("*").alias("n")).where(f.infix_any_case("build", "type"))


@_r.query("flt_07_aggregate_case_filter", "SELECT * FROM (SELECT task_id, CASE WHEN count(*) >= 15 THEN 'BUSY' WHEN count(*) >= 8 THEN 'USUAL' ELSE 'QUIET' END AS level FROM run GROUP BY task_id) WHERE level IN ('BUSY', 'QUIET')")
def aggregate_case(t):
    level = F.when(F.count("*") >= 15, "BUSY").when(F.count("*") >= 8, "USUAL").otherwise("QUIET")
    known = {"BUSY", "USUAL", "QUIET"}
    asked = [x for x in ("BUSY", "QUIET", "NONE") if x in known]
    rows = t.run().groupBy("task_id").agg(level.alias("level"))
    return rows.where(F.col("level").isin(asked)) if asked else rows


@_r.query("flt_08_priority_band", "SELECT id, priority FROM run WHERE priority BETWEEN 0 AND 2")
def band(t):
    return t.run().where(f.priority_band("high")).select("id", "priority")


@_r.query("flt_09_interval_overlap", "SELECT task_id, min(biz_date) AS first, max(biz_date) AS last FROM run GROUP BY task_id HAVING max(biz_date) >= '1995-06-01' AND min(biz_date) <= '1995-06-30'")
def overlap(t):
    spans = t.run().groupBy("task_id").agg(F.min("biz_date").alias("first"), F.max("biz_date").alias("last"))
    return spans.where(f.overlaps("first", "last", "1995-06-01", "1995-06-30"))


@_r.query("flt_10_row_value_in", "SELECT id, task_id, biz_date FROM run WHERE (task_id, biz_date) IN (SELECT task_id, biz_date FROM run WHERE id % 100 = 0)")
def row_values(t):
    run = t.run()
    return f.pairs(run.select("id", "task_id", "biz_date"), run.where("id % 100 = 0"), "task_id", "biz_date")


@_r.query("flt_11_nullable_list", "SELECT src, dst FROM flow WHERE confidence IN ('CONFLICT', 'UNVERIFIED')")
def nullable_list(t):
    asked = {"confidence": "CONFLICT,UNVERIFIED", "task_id": None}
    return t.flow().where(f.every(f.one_of(c, v) for c, v in asked.items())).select("src", "dst")


@_r.query("flt_14_node_available", "SELECT s_suppkey AS node, coalesce(s_acctbal > 0 AND s_nationkey % 5 <> 0 AND NOT s_suppkey % 7 = 0, false) AS available FROM supplier")
def available(t):
    fresh, settled, quarantined = F.col("s_acctbal") > 0, F.col("s_nationkey") % 5 != 0, F.col("s_suppkey") % 7 == 0
    return t.read("supplier").select(F.col("s_suppkey").alias("node"), F.coalesce(fresh & settled & ~quarantined, F.lit(False)).alias("available"))


@_r.query("flt_15_resumable", "SELECT id, state = 'SUCCESS' AND finished_at > TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR AS resumable FROM inst")
def resumable(t):
    ok = (F.col("state") == "SUCCESS") & (F.col("finished_at") > F.expr("timestamp_ntz '2024-01-31' - interval 72 hours"))
    return t.inst().select("id", ok.alias("resumable"))


@_r.query("flt_16_client_filters", "SELECT id, label FROM run WHERE lower(label) LIKE '%urgent%' AND state IN ('FAILED', 'SUCCESS') AND biz_date >= '1996-01-01' AND biz_date <= '1996-12-31'")
def client(t):
    spec = [{"kind": "search", "column": "label", "value": "URGENT"}, {"kind": "multiSelect", "column": "state", "value": ["FAILED", "SUCCESS"]}, {"kind": "select", "column": "priority", "value": ""}, {"kind": "dateRange", "column": "biz_date", "value": {"from": "1996-01-01", "to": "1996-12-31"}}]
    return t.run().where(f.client_filter(spec)).select("id", "label")


@_r.query("flt_17_sql_shape", "SELECT item_id, length(trim(text)) >= 8 AND lower(regexp_extract(trim(text), '^[A-Za-z]+', 0)) IN ('select', 'insert', 'with', 'merge', 'update', 'delete', 'create', 'from') AS sql_like FROM benchmark")
def sql_shape(t):
    text = F.trim("text")
    word = F.lower(F.regexp_extract(text, "^[A-Za-z]+", 0))
    return t.read("benchmark").select("item_id", ((F.length(text) >= 8) & word.isin("select", "insert", "with", "merge", "update", "delete", "create", "from")).alias("sql_like"))


@_r.query("flt_18_task_list", "SELECT id, name, type FROM task WHERE type = 'AUTOMOBILE' AND name LIKE '%5%' AND project_id = 3 AND balance >= 0 AND id IN (SELECT task_id FROM run WHERE state = 'FAILED')")
def task_list(t):
    ok = f.every([F.col("type") == "AUTOMOBILE", f.infix("5", "name"), F.col("project_id") == 3, f.between("balance", 0)])
    failed = t.run().where("state = 'FAILED'").select(F.col("task_id").alias("id"))
    return t.task().where(ok).join(failed, "id", "left_semi").select("id", "name", "type")


@_r.query("prj_01_priority_bucket", "SELECT id, CASE WHEN state = 'FAILED' THEN 0 WHEN state IN ('RUNNING', 'WAITING') THEN 1 ELSE 2 END AS bucket FROM run")
def bucket(t):
    return t.run().select("id", f.state_rank().alias("bucket"))


@_r.query("prj_02_duration_ms", "SELECT id, epoch_ms(finished_at) - epoch_ms(started_at) AS duration_ms FROM inst")
def duration(t):
    return t.inst().select("id", f.duration_ms("started_at", "finished_at").alias("duration_ms"))


@_r.query("prj_03_running_ms", f"SELECT id, greatest(0, epoch_ms(coalesce(CASE WHEN state <> 'WAITING' THEN started_at END, TIMESTAMP '{RUN_AS_OF}')) - epoch_ms(started_at)) AS running_ms FROM run")
def running(t):
    return t.run().withColumn("end", F.when(F.col("state") != "WAITING", F.col("started_at"))).select("id", f.running_ms("started_at", "end", RUN_AS_OF).alias("running_ms"))


@_r.query("prj_04_layer", "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'ODS' WHEN 1 THEN 'ODS' WHEN 2 THEN 'DWD' WHEN 3 THEN 'DWS' WHEN 4 THEN 'ADS' END AS layer FROM supplier")
def layers(t):
    names = F.array(*(F.lit(x) for x in ("db.ods", "ODS_orders", "a.b.dwd_x", "dws_y", "Ads_z", "db.dwd")))
    name = F.element_at(names, (F.col("s_suppkey") % 6 + 1).cast("int"))
    return t.read("supplier").select(F.col("s_suppkey").alias("id"), f.layer(name).alias("layer"))


@_r.query("prj_05_schedule_text", "SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN 'daily 02:30' WHEN 1 THEN 'every 15 min' WHEN 2 THEN 'hourly at minute 5' WHEN 3 THEN 'weekly on MON 06:00' WHEN 4 THEN 'monthly on 1 00:10' WHEN 5 THEN 'every 90 s' ELSE 'manual' END AS schedule FROM supplier")
def schedules(t):
    crons = F.array(*(F.lit(x) for x in ("0 30 2 * * ?", "0 */15 * * * ?", "0 5 * * * ?", "0 0 6 ? * MON", "0 10 0 1 * ?", None, None)))
    k = (F.col("s_suppkey") % 7).cast("int")
    return t.read("supplier").select(F.col("s_suppkey").alias("id"), f.schedule_text(F.when(k == 5, "INTERVAL").otherwise("CRON"), F.element_at(crons, k + 1), F.lit(90)).alias("schedule"))


@_r.query("prj_06_node_view", "SELECT id, coalesce(nullif(name, ''), id) AS name, upper(split_part(id, ':', 1)) AS type FROM vertex")
def node_view(t):
    return t.vertex().select("id", F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"), F.upper(F.substring_index("id", ":", 1)).alias("type"))


@_r.query("srt_01_allowed_sort", "SELECT id, priority FROM run ORDER BY priority DESC NULLS LAST, id DESC LIMIT 50")
def allowed_sort(t):
    return f.ordered(t.run().select("id", "priority"), "priority", True, ("priority", "biz_date")).limit(50)


@_r.query("srt_02_ranked_sort", "SELECT id, state FROM run ORDER BY CASE WHEN state = 'FAILED' THEN 0 WHEN state IN ('RUNNING', 'WAITING') THEN 1 ELSE 2 END, id DESC LIMIT 50")
def ranked_sort(t):
    return t.run().select("id", "state").orderBy(f.state_rank(), F.col("id").desc()).limit(50)


@_r.query("srt_04_streaming_order", "SELECT id, state, started_at FROM inst ORDER BY CASE state WHEN 'RUNNING' THEN 0 WHEN 'STOPPED' THEN 1 ELSE 2 END, started_at DESC NULLS LAST, id LIMIT 40")
def streaming_order(t):
    rank = F.when(F.col("state") == "RUNNING", 0).when(F.col("state") == "STOPPED", 1).otherwise(2)
    return t.inst().select("id", "state", "started_at").orderBy(rank, F.col("started_at").desc_nulls_last(), "id").limit(40)


@_r.query("srt_05_offset_page", "SELECT id, cents FROM run ORDER BY cents DESC, id DESC LIMIT 200 OFFSET 400")
def offset_page(t):
    return f.page(f.ordered(t.run().select("id", "cents"), "cents", True, ("cents",)), 2, 500)


@_r.query("srt_06_keyset_page", "SELECT id, started_at FROM run WHERE started_at > TIMESTAMP '1997-01-01' OR (started_at = TIMESTAMP '1997-01-01' AND id > 100) ORDER BY started_at, id LIMIT 100")
def keyset(t):
    return t.run().select("id", "started_at").where(f.after(t.run(), "started_at", "id", F.expr("timestamp_ntz '1997-01-01'"), 100)).orderBy("started_at", "id").limit(100)


@_r.query("srt_07_newest_ascending", "SELECT * FROM (SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 30) ORDER BY conv_id, turn")
def newest(t):
    return t.read("conversations").select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), F.desc("turn")).limit(30).orderBy("conv_id", "turn")


@_r.query("srt_08_resume_after", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 25")
def resume(t):
    return t.read("events").where("event_id > 500").select("event_id", "event_type").orderBy("event_id").limit(25)


@_r.query("srt_09_held_limit", "SELECT id FROM task ORDER BY id LIMIT 100")
def limits(t):
    return t.task().select("id").orderBy("id").limit(f.held_limit(-5))


@_r.query("srt_10_client_page", "WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM supplier), r AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT id FROM r, n WHERE (k - 1) // 20 + 1 = least(greatest(999, 1), pages)")
def client_page(t):
    rows = t.read("supplier").select(F.col("s_suppkey").alias("id")).orderBy("id")
    pages = max(1, -(-rows.count() // 20))
    return f.page(rows, min(max(999, 1), pages) - 1, 20)


@_r.query("srt_11_capped_count", "SELECT least(count(*), 10000) AS n, count(*) >= 10000 AS lower_bound FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def capped(t):
    return f.capped_count(t.read("lineitem").select("l_orderkey", "l_partkey"))
