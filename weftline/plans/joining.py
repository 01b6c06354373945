"""Joins, set operations and windows over tasks, runs, instances and lineage."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import keyed as k
from weftline.registry import Registry
from weftline.sources.store import dealt

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


@_r.query("jon_01_left_outer", "SELECT r.id, r.state, t.name FROM run r LEFT JOIN task t ON t.id = r.task_id AND t.balance > 0")
def left_outer(t):
    tasks = t.task().where("balance > 0").select(F.col("id").alias("task_id"), "name")
    return t.run().join(tasks, "task_id", "left").select("id", "state", "name")


@_r.query("jon_02_fan_out", "SELECT t.id, i.id AS inst_id, f.dst FROM task t LEFT JOIN inst i ON i.task_id = t.id AND i.state = 'SUCCESS' LEFT JOIN flow f ON f.dst = 'customer:' || t.id")
def fan_out(t):
    done = t.inst().where("state = 'SUCCESS'").select(F.col("id").alias("inst_id"), "task_id")
    rows = t.task().select("id").join(done, F.col("id") == F.col("task_id"), "left")
    return rows.join(t.flow().select("dst"), F.concat(F.lit("customer:"), "id") == F.col("dst"), "left").select("id", "inst_id", "dst")


@_r.query("jon_03_two_versions", "SELECT t.id, coalesce(a.cents, b.cents, 0) AS timeout FROM task t LEFT JOIN (SELECT task_id, max(cents) AS cents FROM run WHERE state = 'FAILED' GROUP BY 1) a ON a.task_id = t.id LEFT JOIN (SELECT task_id, min(cents) AS cents FROM run GROUP BY 1) b ON b.task_id = t.id")
def two_versions(t):
    per = t.run().groupBy("task_id").agg(F.coalesce(F.max(F.when(F.col("state") == "FAILED", F.col("cents"))), F.min("cents")).alias("cents"))
    return t.task().join(per, F.col("id") == F.col("task_id"), "left").select("id", F.coalesce("cents", F.lit(0)).alias("timeout"))


@_r.query("jon_04_waiting_successors", "SELECT e.run_id, e.dst FROM dag_edge e JOIN dag_node n ON n.run_id = e.run_id AND n.node = e.dst WHERE n.state = 'FAILED' AND e.src_state = 'SUCCESS'")
def successors(t):
    waiting = t.dag_node().where("state = 'FAILED'").select("run_id", F.col("node").alias("dst"))
    return t.dag_edge().where("src_state = 'SUCCESS'").select("run_id", "dst").join(waiting, ["run_id", "dst"])


@_r.query("jon_05_two_keys_and_constant", "SELECT a.id, b.id AS other FROM inst a JOIN inst b ON a.task_id = b.task_id AND a.biz_date = b.biz_date WHERE a.state = 'FAILED' AND b.state = 'SUCCESS'")
def two_keys(t):
    inst = t.inst()
    good = inst.where("state = 'SUCCESS'").select("task_id", "biz_date", F.col("id").alias("other"))
    return inst.where("state = 'FAILED'").select("id", "task_id", "biz_date").join(good, ["task_id", "biz_date"]).select("id", "other")


@_r.query("jon_06_never_triggered", "SELECT id, name FROM task t WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.task_id = t.id)")
def never(t):
    return k.without(t.task(), t.run().select(F.col("task_id").alias("id")), "id").select("id", "name")


@_r.query("jon_07_runnable", "SELECT n.run_id, n.node FROM dag_node n WHERE n.state = 'FAILED' AND NOT EXISTS (SELECT 1 FROM dag_edge e WHERE e.run_id = n.run_id AND e.dst = n.node AND e.src_state <> 'SUCCESS')")
def runnable(t):
    blocked = t.dag_edge().where("src_state <> 'SUCCESS'").select("run_id", F.col("dst").alias("node"))
    return k.without(t.dag_node().where("state = 'FAILED'").select("run_id", "node"), blocked, "run_id", "node")


@_r.query("jon_08_semi_tagged", "SELECT id FROM task WHERE id IN (SELECT task_id FROM run WHERE label = '1-URGENT')")
def tagged(t):
    return t.task().select("id").join(t.run().where("label = '1-URGENT'").select(F.col("task_id").alias("id")), "id", "left_semi")


@_r.query("jon_09_semi_roles", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)")
def roles(t):
    return t.read("documents").select("doc_id").join(t.read("labels").where("quality = 0 or toxic = 1"), "doc_id", "left_semi")


@_r.query("jon_10_scalar_lookups", "SELECT id, (SELECT n_name FROM nation WHERE n_nationkey = project_id) AS nation, (SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = project_id) AS region FROM task")
def lookups(t):
    place = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return t.task().select("id", "project_id").join(place, "project_id", "left").select("id", "nation", "region")


@_r.query("jon_11_latest_state", "SELECT t.id, (SELECT state FROM run r WHERE r.task_id = t.id ORDER BY r.id DESC LIMIT 1) AS last_state FROM task t")
def latest(t):
    last = t.run().groupBy("task_id").agg(F.max_by("state", "id").alias("last_state"))
    return t.task().join(last, F.col("id") == F.col("task_id"), "left").select("id", "last_state")


@_r.query("jon_12_coordinates", "SELECT s_suppkey AS id, n_name AS host, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END, 3306) AS port FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def coordinates(t):
    rows = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("host"), F.coalesce(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")), F.lit(3306)).alias("port"))


@_r.query("jon_13_worker_online", "SELECT i.id, coalesce(s_acctbal > 0, false) AS online FROM inst i LEFT JOIN supplier ON 'node-' || s_suppkey = i.node WHERE i.state = 'RUNNING'")
def online(t):
    workers = t.read("supplier").select(F.concat(F.lit("node-"), "s_suppkey").alias("node"), (F.col("s_acctbal") > 0).alias("up"))
    return t.inst().where("state = 'RUNNING'").join(workers, "node", "left").select("id", F.coalesce("up", F.lit(False)).alias("online"))


@_r.query("jon_14_expired_leases", "SELECT i.id FROM inst i JOIN supplier ON 'node-' || s_suppkey = i.node WHERE i.state = 'RUNNING' AND s_acctbal < 5000 AND i.finished_at < TIMESTAMP '2024-01-20' - to_hours(CAST(s_suppkey AS BIGINT))")
def leases(t):
    workers = t.read("supplier").where("s_acctbal < 5000").select(F.concat(F.lit("node-"), "s_suppkey").alias("node"), "s_suppkey")
    rows = t.inst().where("state = 'RUNNING'").join(workers, "node")
    return rows.where("finished_at < timestamp_ntz '2024-01-20' - make_interval(0, 0, 0, 0, cast(s_suppkey as int))").select("id")


@_r.query("jon_15_read_write_pairs", "SELECT DISTINCT a.src AS reads, b.dst AS writes, a.task_id FROM flow a JOIN flow b ON a.task_id = b.task_id WHERE a.src LIKE 'region:%' AND b.dst LIKE 'supplier:%' AND a.src <> b.dst")
def read_write(t):
    flow = t.flow()
    return k.read_write_pairs(flow.where("src like 'region:%'").select("task_id", F.col("src").alias("reads")), flow.where("dst like 'supplier:%'").select("task_id", F.col("dst").alias("writes")))


@_r.query("jon_16_distinct_names", "SELECT DISTINCT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def names(t):
    return t.read("nation").join(t.read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi").select(F.col("n_name").alias("name")).distinct()


_VERSIONS = "SELECT id, CASE WHEN id % 5 = 0 THEN name || '!' ELSE name END AS name, type FROM task WHERE id % 11 <> 0"


@_r.query("jon_17_entity_diff", f"SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN 'added' ELSE 'modified' END AS change FROM (SELECT id, name, type FROM task WHERE id % 13 <> 0) a FULL JOIN ({_VERSIONS}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.name IS DISTINCT FROM b.name OR a.type IS DISTINCT FROM b.type")
def diff(t):
    old = t.task().where("id % 13 <> 0").select("id", "name", "type")
    new = t.task().where("id % 11 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), "type")
    return k.diff(old, new, "id").select("id", "change")


@_r.query("jon_18_positional_zip", "SELECT a.doc_id, a.quality, b.toxic FROM (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS i FROM labels) a JOIN (SELECT toxic, row_number() OVER (ORDER BY doc_id) AS i FROM labels) b USING (i)")
def zipped(t):
    labels = t.read("labels")
    return k.zipped(labels.select("doc_id", "quality"), labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "quality", "toxic")


@_r.query("jon_20_content_priority", "SELECT t.id, coalesce(nullif(trim(CASE WHEN t.id % 3 = 0 THEN ' ' WHEN t.id % 3 = 1 THEN t.type END), ''), r.label, t.name) AS content FROM task t LEFT JOIN (SELECT task_id, arg_max(label, id) AS label FROM run GROUP BY 1) r ON r.task_id = t.id")
def content(t):
    bound = t.run().groupBy("task_id").agg(F.max_by("label", "id").alias("label"))
    override = F.when(F.col("id") % 3 == 0, " ").when(F.col("id") % 3 == 1, F.col("type"))
    return t.task().join(bound, F.col("id") == F.col("task_id"), "left").select("id", k.first_filled(override, F.col("label"), F.col("name")).alias("content"))


@_r.query("jon_20_run_timeouts", "SELECT i.id, i.task_id, i.started_at, 600 + t.id % 7 * 3600 * 24 AS timeout_seconds, i.started_at + to_seconds(600 + t.id % 7 * 3600 * 24) < TIMESTAMP '2024-01-31 00:00:00' AS expired FROM inst i JOIN task t ON i.task_id = t.id WHERE i.state = 'RUNNING' AND i.started_at IS NOT NULL")
def timeouts(t):
    routine = t.task().select(F.col("id").alias("task_id"), (600 + F.col("id") % 7 * 3600 * 24).alias("timeout_seconds"))
    running = t.inst().where("state = 'RUNNING' and started_at is not null").select("id", "task_id", "started_at")
    late = F.expr("started_at + make_dt_interval(0, 0, 0, timeout_seconds) < timestamp_ntz '2024-01-31 00:00:00'")
    return running.join(routine, "task_id").select("id", "task_id", "started_at", "timeout_seconds", late.alias("expired"))


@_r.query("jon_22_workflow_drift", "WITH v AS (SELECT task_id, max(priority) AS newest FROM run GROUP BY 1) SELECT r.id, r.priority AS pinned, v.newest, r.priority < v.newest OR r.state = 'WAITING' AS drifted FROM run r JOIN v USING (task_id)")
def drift(t):
    newest = t.run().groupBy("task_id").agg(F.max("priority").alias("newest"))
    return t.run().join(newest, "task_id").select("id", F.col("priority").alias("pinned"), "newest", ((F.col("priority") < F.col("newest")) | (F.col("state") == "WAITING")).alias("drifted"))


@_r.query("jon_23_baseline_hash", "SELECT project_id, sha256(string_agg(lower(name) || '=' || type, '|' ORDER BY lower(name) || '=' || type)) AS hash FROM task GROUP BY project_id")
def baseline(t):
    return t.task().groupBy("project_id").agg(k.content_hash(F.concat(F.lower("name"), F.lit("="), "type")).alias("hash"))


@_r.query("set_01_union_distinct", "SELECT dst AS id FROM flow WHERE src = 'nation:3' UNION SELECT src FROM flow WHERE dst = 'nation:3' UNION SELECT dst FROM flow WHERE src = 'region:1'")
def union_distinct(t):
    flow = t.flow()
    return flow.where("src = 'nation:3'").select(F.col("dst").alias("id")).union(flow.where("dst = 'nation:3'").select("src")).union(flow.where("src = 'region:1'").select("dst")).distinct()


@_r.query("set_02_merged_search", "SELECT * FROM ((SELECT id, name FROM vertex WHERE id LIKE 'customer:%' AND lower(name) LIKE '%1%' ORDER BY name, id LIMIT 20) UNION ALL (SELECT id, name FROM vertex WHERE id LIKE 'supplier:%' AND lower(name) LIKE '%1%' ORDER BY name, id LIMIT 20) UNION ALL (SELECT id, name FROM vertex WHERE id LIKE 'part:%' AND lower(name) LIKE '%1%' ORDER BY name, id LIMIT 20)) ORDER BY name, id LIMIT 20")
def merged_search(t):
    return k.search(t.vertex(), "1", ("customer", "supplier", "part"), 20)


_ORDERED_SETS = "SELECT l_orderkey AS k, list_sort(list_distinct(list(l_suppkey) FILTER (WHERE l_linenumber <= 3))) AS a, list_sort(list_distinct(list(l_suppkey) FILTER (WHERE l_linenumber >= 3))) AS b FROM lineitem GROUP BY 1"


def _sets(t):
    pick = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("l_suppkey"))))
    return t.read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(pick(F.col("l_linenumber") <= 3).alias("a"), pick(F.col("l_linenumber") >= 3).alias("b"))


@_r.query("set_04_union_and_intersection", f"SELECT k, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS n_union, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS n_both FROM ({_ORDERED_SETS})")
def set_sizes(t):
    return _sets(t).select("k", F.size(F.array_union("a", "b")).alias("n_union"), F.size(F.array_intersect("a", "b")).alias("n_both"))


@_r.query("set_03_voter_intersection", f"SELECT k, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE array_to_string(list_sort(list_intersect(a, b)), ',') END AS agreed FROM ({_ORDERED_SETS})")
def voters(t):
    return _sets(t).withColumn("both", F.sort_array(F.array_intersect("a", "b"))).select("k", F.when((F.size("a") > 0) & (F.size("b") > 0), F.array_join(F.transform("both", lambda x: x.cast("string")), ",")).alias("agreed"))


@_r.query("set_05_reads_minus_writes", f"SELECT k, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS n_only FROM ({_ORDERED_SETS})")
def minus(t):
    return _sets(t).select("k", F.size(F.array_except("a", "b")).alias("n_only"))


@_r.query("set_06_hash_overlap", "SELECT count(*) AS shared FROM (SELECT DISTINCT md5(text) FROM documents WHERE lang = 'en' INTERSECT SELECT md5(text) FROM documents WHERE source IN ('src1', 'src2'))")
def overlap(t):
    docs = t.read("documents")
    return docs.where("lang = 'en'").select(F.md5("text").alias("h")).intersect(docs.where("source in ('src1', 'src2')").select(F.md5("text").alias("h"))).agg(F.count("*").alias("shared"))


_REQUESTED = "SELECT id, l_orderkey, l_linenumber, l_partkey FROM (SELECT l_suppkey AS id, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) WHERE k = 1"


@_r.query("set_07_requested_valid", _REQUESTED)
def requested(t):
    place = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    asked = t.read("lineitem").select(F.col("l_suppkey").alias("id"), place.alias("k"))
    valid = t.read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return k.first_of(asked.join(valid, "id", "left_semi"), "k", "id").select("id", "k.l_orderkey", "k.l_linenumber", "k.l_partkey")


@_r.query("set_08_merged_edges", "SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM flow UNION ALL SELECT src, dst FROM flow WHERE confidence = 'CONFIRMED') GROUP BY ALL HAVING count(*) >= 1")
def merged(t):
    """Confirmed edges count twice, so the union of both tables is one pass over the edges."""
    twice = F.when(F.col("confidence") == "CONFIRMED", 2).otherwise(1)
    return dealt(t.flow().select("src", "dst", twice.alias("n")), t.flow_rows(), "src", "dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


@_r.query("win_01_latest_version", "SELECT label, id FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY coalesce(cents, 0) DESC, id) AS k FROM run) WHERE k = 1")
def version(t):
    return k.top(t.run(), ["label"], [F.coalesce("cents", F.lit(0)).desc(), F.col("id")], 1).select("label", "id")


@_r.query("win_02_latest_run", "SELECT task_id, state, max(id) AS id FROM run GROUP BY ALL")
def latest_run(t):
    return t.run().groupBy("task_id", "state").agg(F.max("id").alias("id"))


@_r.query("win_03_last_n", "SELECT task_id, id FROM (SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY biz_date DESC, id DESC) AS k FROM inst WHERE state = 'SUCCESS') WHERE k <= 3")
def last_n(t):
    return k.top(t.inst().where("state = 'SUCCESS'"), ["task_id"], [F.col("biz_date").desc(), F.col("id").desc()], 3).select("task_id", "id")


@_r.query("win_04_latest_checkpoint", "SELECT task_id, max(id) AS id FROM inst WHERE state = 'SUCCESS' GROUP BY task_id")
def checkpoint(t):
    return t.inst().where("state = 'SUCCESS'").groupBy("task_id").agg(F.max("id").alias("id"))


@_r.query("win_05_rolling_retention", "SELECT id, CASE WHEN state = 'SUCCESS' AND row_number() OVER (PARTITION BY task_id, state ORDER BY id DESC) > 3 THEN 'EXPIRED' ELSE state END AS state FROM inst")
def retention(t):
    place = F.row_number().over(Window.partitionBy("task_id", "state").orderBy(F.col("id").desc()))
    return t.inst().select("id", F.when((F.col("state") == "SUCCESS") & (place > 3), "EXPIRED").otherwise(F.col("state")).alias("state"))


@_r.query("win_06_first_wins", "SELECT text_hash, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_hash, doc_id FROM documents) GROUP BY 1")
def first_wins(t):
    return k.first_of(t.read("documents").select(F.md5("text").alias("text_hash"), "doc_id"), "doc_id", "text_hash")


_RANK = "CASE confidence WHEN 'CONFIRMED' THEN 0 WHEN 'DECLARED' THEN 1 WHEN 'UNVERIFIED' THEN 2 ELSE 3 END"


@_r.query("win_07_priority_wins", f"SELECT dst, src, confidence FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY {_RANK}, src, task_id) AS k FROM flow) WHERE k = 1")
def priority_wins(t):
    return k.top(dealt(t.flow(), t.flow_rows(), "dst"), ["dst"], [k.confidence_rank(), F.col("src"), F.col("task_id")], 1).select("dst", "src", "confidence")


_TIERED = "SELECT priority AS tier, count(*) AS n, count(*) FILTER (WHERE state = 'SUCCESS') AS good FROM run GROUP BY 1"


def _tiered(t):
    return t.run().groupBy(F.col("priority").alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "SUCCESS").alias("good"))


@_r.query("win_08_cumulative_precision", f"SELECT tier, round(CAST(sum(good) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE), 6) AS precision_so_far FROM ({_TIERED}) WINDOW w AS (ORDER BY tier)")
def cumulative(t):
    return k.cumulative(_tiered(t), "tier", "good", "n").select("tier", F.round("precision_so_far", 6).alias("precision_so_far"))


@_r.query("win_09_longest_prefix", f"SELECT tier FROM (SELECT tier, min(CASE WHEN p >= 0.4865 THEN 1 ELSE 0 END) OVER (ORDER BY tier) AS ok FROM (SELECT tier, CAST(sum(good) OVER (ORDER BY tier) AS DOUBLE) / CAST(sum(n) OVER (ORDER BY tier) AS DOUBLE) AS p FROM ({_TIERED}))) WHERE ok = 1")
def prefix(t):
    return k.longest_prefix(k.cumulative(_tiered(t), "tier", "good", "n"), "tier", F.col("precision_so_far") >= 0.4865).select("tier")


@_r.query("win_10_throttle", "SELECT task_id, biz_date, CASE WHEN row_number() OVER (PARTITION BY task_id ORDER BY biz_date) <= 2 THEN 0 ELSE 1 END AS held FROM (SELECT DISTINCT task_id, biz_date FROM run)")
def throttle(t):
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("biz_date"))
    return t.run().select("task_id", "biz_date").distinct().withColumn("held", F.when(place <= 2, 0).otherwise(1))


@_r.query("win_11_promotion", "WITH a AS (SELECT task_id, count(DISTINCT biz_date) AS active FROM run WHERE state = 'SUCCESS' GROUP BY 1), h AS (SELECT task_id, biz_date, dense_rank() OVER (PARTITION BY task_id ORDER BY biz_date) AS k FROM run WHERE state = 'WAITING') SELECT DISTINCT h.task_id, h.biz_date FROM h LEFT JOIN a USING (task_id) WHERE k <= greatest(0, 5 - coalesce(active, 0))")
def promotion(t):
    active = t.run().where("state = 'SUCCESS'").groupBy("task_id").agg(F.count_distinct("biz_date").alias("active"))
    held = t.run().where("state = 'WAITING'").select("task_id", "biz_date", F.dense_rank().over(Window.partitionBy("task_id").orderBy("biz_date")).alias("k"))
    return held.join(active, "task_id", "left").where("k <= greatest(0, 5 - coalesce(active, 0))").select("task_id", "biz_date").distinct()


@_r.query("win_12_top_in_window", "SELECT task_id, arg_max(id, id) AS id FROM inst WHERE state = 'FAILED' AND finished_at >= TIMESTAMP '2024-01-20' GROUP BY task_id")
def top_in_window(t):
    return t.inst().where("state = 'FAILED' and finished_at >= timestamp_ntz '2024-01-20'").groupBy("task_id").agg(F.max("id").alias("id"))


@_r.query("srt_12_least_loaded", "SELECT arg_max(node, 1000000 * free - used) AS node FROM (SELECT node, 1000 - count(*) FILTER (WHERE state = 'RUNNING') AS free, CAST(replace(node, 'node-', '') AS INTEGER) AS used FROM inst GROUP BY node)")
def least_loaded(t):
    per = t.inst().groupBy("node").agg((1000 - F.count_if(F.col("state") == "RUNNING")).alias("free")).withColumn("used", F.replace("node", F.lit("node-"), F.lit("")).cast("int"))
    return per.agg(F.max_by("node", F.struct("free", -F.col("used"))).alias("node"))


@_r.query("srt_13_lowest_victim", "SELECT node, arg_max(id, priority * 1000000000 + id) AS victim FROM inst WHERE state = 'RUNNING' GROUP BY node")
def victim(t):
    return t.inst().where("state = 'RUNNING'").groupBy("node").agg(F.max_by("id", F.struct("priority", "id")).alias("victim"))


@_r.query("snk_03_batch_update", "SELECT r.id, coalesce(u.node, 'none') AS node FROM run r LEFT JOIN (SELECT id, 'w' || id % 5 AS node FROM run WHERE state = 'WAITING' AND priority = 1) u ON u.id = r.id")
def batch_update(t):
    updates = t.run().where("state = 'WAITING' and priority = 1").select("id", F.concat(F.lit("w"), F.col("id") % 5).alias("node"))
    return k.updated(t.run().select("id", F.lit("none").alias("node")), updates, "id", "node")


@_r.query("snk_04_guarded_upsert", "SELECT task_id, biz_date, max(id) AS id FROM run GROUP BY ALL")
def upsert(t):
    run = t.run().select("task_id", "biz_date", "id")
    return k.upserted(run.where("id % 2 = 0"), run.where("id % 2 = 1"), ["task_id", "biz_date"], [F.col("id").desc()])


@_r.query("snk_05_replace_per_task", "SELECT src, dst, task_id FROM flow WHERE task_id NOT IN (3, 4) UNION ALL SELECT src, 'new:' || dst, task_id FROM flow WHERE task_id IN (3, 4)")
def replaced(t):
    flow = t.flow().select("src", "dst", "task_id")
    new = flow.where("task_id in (3, 4)").select("src", F.concat(F.lit("new:"), "dst").alias("dst"), "task_id")
    return k.replaced(flow, new, "task_id")


@_r.query("snk_06_synced_edges", "SELECT l_orderkey AS run_id, l_partkey AS part, CAST(sum(l_quantity) AS BIGINT) AS rows_synced FROM lineitem GROUP BY ALL")
def synced(t):
    return t.read("lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").cast("long").alias("rows_synced"))
