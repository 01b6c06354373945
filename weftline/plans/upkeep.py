"""Queries over state that streams keep up to date."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from weftline.plans.platform import _folder
from weftline.plans.readiness import _CROSS, _UNMET
from weftline.functions import scalar as s
from weftline.plans.corpus import ACQUIRED
from weftline.registry import Registry
from weftline.sources import layered
from weftline.sources.store import cut
from weftline.streaming import corpus, progress
from weftline.streaming.maintainer import Maintainer

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

EARLIEST = "2024-01-03"
SIGNALS = "instance string, need string, state string, at timestamp_ntz"


def _needs(t):
    """A waiting instance needs a success of its task the day before, and every edge of the run that has its number."""
    waiting = t.inst().where("state = 'WAITING'")
    day_before = F.concat(F.col("task_id").cast("string"), F.lit("@"), F.date_sub(F.to_date("biz_date"), 1).cast("string"))
    cross = waiting.where(F.col("biz_date") >= EARLIEST).select(F.col("id").cast("string").alias("dependent"), day_before.alias("need"), F.lit("STRONG").alias("strength"))
    edges = t.dag_edge().join(waiting.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return cross.unionByName(edges.select(F.col("run_id").cast("string").alias("dependent"), F.concat_ws(":", "run_id", "src").alias("need"), "strength"))


def _signals(t):
    ended = t.inst().where("state in ('SUCCESS', 'FAILED')").select(F.concat(F.lit("i"), "id").alias("instance"), F.concat_ws("@", "task_id", "biz_date").alias("need"), "state", F.col("finished_at").alias("at"))
    inside = t.dag_node().select(F.concat_ws(":", "run_id", "node").alias("instance"), F.concat_ws(":", "run_id", "node").alias("need"), "state", F.expr("timestamp_ntz '2024-01-31'").alias("at"))
    return ended.unionByName(inside)


def _maintained(t):
    """Signals in shuffled order and partly twice, half of them before a stop and the rest after a restart with a maintainer of its own.

    The tables don't change meanwhile, so signals, needs and what waits are computed once and kept.
    """
    spark, root = t.spark, _folder(t.spark, "maintained")
    files = max(8, spark.sparkContext.defaultParallelism)  # of a half, which is a batch
    rows = cut(_signals(t).withColumn("_deal", F.pmod(F.xxhash64("instance"), F.lit(6))))
    needs, waiting = cut(_needs(t)), cut(t.inst().where("state = 'WAITING'").select(F.col("id").cast("string").alias("dependent")))
    stream = lambda: spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    begin = lambda: Maintainer(spark, f"{root}/state", lambda: needs, lambda: waiting, every=2)
    for deals in ("_deal < 4", "_deal > 2"):
        rows.where(deals).drop("_deal").repartition(files, "instance").write.mode("append").parquet(f"{root}/in")
        keeper = begin()
        keeper.run(stream(), f"{root}/checkpoint").awaitTermination()
    return begin().current()


_TOTAL = f"SELECT i.task_id, i.id, greatest(0, c.unmet + coalesce(u.unmet, 0)) AS unmet, c.needs + coalesce(u.needs, 0) AS needs FROM inst i JOIN (SELECT c.*, CASE WHEN i.biz_date >= '{EARLIEST}' THEN 1 ELSE 0 END AS needs FROM ({_CROSS}) c JOIN inst i USING (id)) c ON c.id = i.id LEFT JOIN (SELECT x.run_id, sum(x.unmet)::BIGINT AS unmet, (SELECT count(*) FROM dag_edge e WHERE e.run_id = x.run_id) AS needs FROM ({_UNMET}) x GROUP BY x.run_id) u ON u.run_id = i.id"


@_r.query("rdy_05_incremental_counts", f"SELECT task_id, id, unmet FROM ({_TOTAL})")
def incremental(t):
    found = _maintained(t).select(F.col("dependent").cast("long").alias("id"), "unmet")
    return t.inst().select("task_id", "id").join(found, "id").select("task_id", "id", "unmet")


@_r.query("rdy_05_became_ready", f"SELECT id, needs = 0 AS at_start FROM ({_TOTAL}) WHERE unmet = 0")
def became_ready(t):
    return _maintained(t).where("ready_since is not null").select(F.col("dependent").cast("long").alias("id"), (F.col("ready_since") < 0).alias("at_start"))


_JOBS = "SELECT r.id AS job, CASE WHEN r.state = 'WAITING' AND r.priority = 1 THEN 'SUSPENDED' WHEN r.state = 'WAITING' THEN 'RUNNING' ELSE r.state END AS state, r.started_at, CASE WHEN r.state <> 'WAITING' THEN r.started_at + to_seconds(100 * r.priority) END AS finished_at, n.worker FROM run r LEFT JOIN (SELECT run_id, max(worker) AS worker FROM dag_node GROUP BY 1) n ON n.run_id = r.id"
_LAST = "SELECT run_id, max(rank) AS ordinal FROM (SELECT run_id, rank, row_number() OVER (PARTITION BY run_id, strength ORDER BY rank DESC) AS k, strength FROM dag_node) WHERE strength = 'STRONG' AND k <= 3 GROUP BY 1"
_PANEL = f"SELECT j.*, CAST(greatest(0, floor(epoch(coalesce(j.finished_at, TIMESTAMP '1998-08-01')) - epoch(j.started_at))) AS BIGINT) AS seconds, j.worker % 3 <> 0 AND s.s_suppkey IS NOT NULL AND j.worker IS NOT NULL AS online, l.ordinal AS last_ordinal, r.started_at + to_days(CAST(10 * l.ordinal AS INTEGER)) AS last_at, coalesce(r.started_at + to_days(CAST(10 * l.ordinal AS INTEGER)) > TIMESTAMP '1998-08-01' - INTERVAL 720 HOUR, false) AS resumable FROM ({_JOBS}) j JOIN run r ON r.id = j.job LEFT JOIN supplier s ON s.s_suppkey = j.worker LEFT JOIN ({_LAST}) l ON l.run_id = j.job"


def _panel(t):
    """Runs as long-running jobs, nodes of their graphs as checkpoints, a day in ten after the start."""
    started = t.run().select(F.col("id").alias("run_id"), "started_at")
    nodes = t.dag_node()
    worker = nodes.groupBy("run_id").agg(F.max("worker").alias("worker"))
    state = F.expr("case when state = 'WAITING' and priority = 1 then 'SUSPENDED' when state = 'WAITING' then 'RUNNING' else state end")
    end = F.expr("case when state <> 'WAITING' then started_at + make_dt_interval(0, 0, 0, 100 * priority) end")
    jobs = t.run().join(worker, F.col("id") == F.col("run_id"), "left").select(F.col("id").alias("job"), state.alias("state"), F.col("started_at").cast("timestamp_ntz").alias("started_at"), end.cast("timestamp_ntz").alias("finished_at"), "worker")
    points = nodes.join(started, "run_id").select(F.col("run_id").alias("job"), F.col("rank").alias("ordinal"), F.when(F.col("strength") == "STRONG", "SUCCESS").otherwise("FAILED").alias("state"), F.expr("cast(started_at as timestamp_ntz) + make_dt_interval(10 * rank)").alias("at"))
    workers = t.read("supplier").select(F.col("s_suppkey").alias("worker"), F.when(F.col("s_suppkey") % 3 == 0, "OFFLINE").otherwise("online").alias("status"))
    return progress.panel(jobs, workers, points, "1998-08-01 00:00:00", 720)


@_r.query("stm_07_job_panel", _PANEL)
def job_panel(t):
    return _panel(t)


@_r.query("stm_07_panel_page", f"SELECT job, state, seconds FROM ({_PANEL}) ORDER BY CASE state WHEN 'RUNNING' THEN 0 WHEN 'SUSPENDED' THEN 1 ELSE 2 END, started_at DESC, job DESC LIMIT 50 OFFSET 100")
def panel_page(t):
    return progress.page(_panel(t), 2, 50).select("job", "state", "seconds")


_PARTS = "SELECT id % 3 AS part, count(*) AS n FROM inst GROUP BY 1"


@_r.query("stm_02_listened_history", f"SELECT 'whole' AS job, part AS ordinal, 'SUCCESS' AS state, n AS rows FROM ({_PARTS}) UNION ALL SELECT 'broken', part, CASE part WHEN 0 THEN 'SUCCESS' ELSE 'FAILED' END, CASE part WHEN 0 THEN n END FROM ({_PARTS}) WHERE part < 2")
def listened(t):
    """Two streams over the same three batches of instances: one takes all of them, the other fails in its second batch. A listener writes down what becomes of each."""
    root, rows = _folder(t.spark, "listened"), t.inst().select("id", "state")
    for part in range(3):
        rows.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    fails = F.when(F.col("id") % 3 == 1, F.raise_error(F.lit("a bad row"))).otherwise(F.col("state"))
    with progress.Recorder(t.spark, f"{root}/history") as recorder:
        runs = []
        for name, column in (("whole", F.col("state")), ("broken", fails)):
            source = t.spark.readStream.schema("id long, state string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in").withColumn("state", column)
            query = source.writeStream.queryName(name).format("noop").option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except StreamingQueryException:
                pass  # it is to be in the history
            runs.append(query.runId)
        recorder.wait(runs)
    return progress.recorded(t.spark, f"{root}/history").select("job", "ordinal", "state", "rows")


@_r.query("src_20_corpus_stream", ACQUIRED)
def corpus_stream(t):
    """Documents in files out of order, some of them twice, over two starts."""
    root, docs = _folder(t.spark, "corpus"), t.read("documents").select("doc_id", "text", "source")
    gates = [F.col("source") != "src3", F.length("text").between(200, 20000), F.col("text").rlike("(?i)the")]
    begin = lambda: corpus.Collector(t.spark, root, gates, s.dedup_key)
    for part in ("doc_id % 7 > 2", "doc_id % 7 < 4"):
        docs.where(part).repartition(6, F.xxhash64("doc_id")).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
        begin().run(stream, f"{root}/checkpoint").awaitTermination()
    return begin().corpus().select("doc_id", F.col("content").alias("k"))


_LAYERS = "SELECT p_partkey AS id, p_partkey % 4 = 0 AND p_partkey % 10 < 6 AS near, p_partkey % 3 = 0 AS known, p_partkey % 2 = 0 AS live FROM part"


@_r.query("src_18_layered_catalog", f"SELECT id, CASE WHEN near THEN 'cache' WHEN known THEN 'graph' WHEN live THEN 'live' END AS first, CASE WHEN near OR known OR live THEN 'cache' END AS second, CASE WHEN near AND NOT known AND live THEN 'live' WHEN near AND NOT known THEN NULL WHEN known OR live THEN 'graph' END AS later FROM ({_LAYERS})")
def layered_catalog(t):
    """Every part as a table that is looked up three times: at once again, and when the cache has grown old."""
    part, name = t.read("part"), F.concat(F.lit("db.t"), "p_partkey").alias("name")
    columns = lambda layer: F.array(F.lit(layer), F.col("p_name")).alias("columns")
    live = part.where("p_partkey % 2 = 0").select(name, columns("live"))
    catalog = layered.Layered(t.spark, _folder(t.spark, "layers"), lambda asked: live.join(asked, "name", "left_semi"), ttl_hours=6)
    at = F.expr("timestamp_ntz '2024-01-31 12:00:00' - make_dt_interval(0, p_partkey % 10)").alias("at")
    catalog.start(part.where("p_partkey % 4 = 0").select(name, columns("cache"), at), part.where("p_partkey % 3 = 0").select(name, columns("graph")))
    out = part.select(F.col("p_partkey").alias("id"), name)
    for turn, (into, now) in enumerate((("first", "2024-01-31 12:00:00"), ("second", "2024-01-31 12:01:00"), ("later", "2024-02-01 12:00:00"))):
        out = out.join(catalog.resolve(part.select(name), now, turn).select("name", F.col("layer").alias(into)), "name")
    return out.drop("name")
