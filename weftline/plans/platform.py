"""Streaming, sink and SQL-lineage queries."""

from pyspark.sql import functions as F

from weftline.operators import keyed, sqllineage as sl
from weftline.registry import Registry
from weftline.sources import connectors
from weftline.sources.store import dealt, folder
from weftline.streaming import outbox

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _folder(spark, name):
    """A new folder where all executors can write."""
    return f"{folder(spark)}/{name}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"


@_r.query("stm_01_stream_to_nowhere", "SELECT 4 AS batches, count(*) AS read FROM inst")
def to_nowhere(t):
    """All instances as a stream into nowhere, in four batches over two starts: the second takes up the count where the first one ended."""
    root, rows = _folder(t.spark, "nowhere"), t.inst().select("id", "state")
    read = []
    for half in range(2):
        for part in range(2):
            rows.where(F.col("id") % 4 == 2 * half + part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema("id long, state string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        query = outbox.discarded(stream, f"{root}/checkpoint", availableNow=True)
        query.awaitTermination()
        read += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    return t.inst().limit(1).select(F.lit(len(read)).alias("batches"), F.lit(sum(read)).cast("long").alias("read"))


@_r.query("stm_02_checkpoint_history", "SELECT id, CASE WHEN state = 'SUCCESS' AND row_number() OVER (PARTITION BY task_id, state ORDER BY id DESC) > 3 THEN 'EXPIRED' ELSE state END AS state FROM inst")
def history(t):
    rows = t.inst().select("id", F.col("task_id").alias("job"), "state", F.col("id").alias("ordinal"), F.col("finished_at").alias("at"))
    return outbox.history(rows, 3, "2024-01-31", 72).select("id", "state")


@_r.query("stm_04_outbox_maintenance", "SELECT DISTINCT w.id FROM inst d JOIN inst w ON w.task_id = d.task_id AND w.state = 'WAITING' AND (w.biz_date = d.biz_date OR CAST(w.biz_date AS DATE) = CAST(d.biz_date AS DATE) + 1) WHERE d.state IN ('SUCCESS', 'FAILED')")
def maintenance(t):
    spark, root = t.spark, _folder(t.spark, "outbox")
    inst = t.inst()
    inst.select("id", "task_id", "state", "biz_date", "finished_at").write.parquet(f"{root}/in")
    signals = outbox.outbox(spark, f"{root}/in", "id long, task_id long, state string, biz_date string, finished_at timestamp_ntz")
    outbox.maintain(signals, lambda: t.inst().where("state = 'WAITING'"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("id").distinct()


_INST = "id long, state string"


@_r.query("stm_03_stop_and_resume", "SELECT id, state FROM inst")
def stop_and_resume(t):
    """The stream ends after the first half of the rows, and takes up the second half, and nothing twice, from its checkpoint."""
    root, rows = _folder(t.spark, "resume"), t.inst().select("id", "state")
    rows.where("id % 2 = 0").write.parquet(f"{root}/in")
    source = t.spark.readStream.schema(_INST).parquet(f"{root}/in")
    start = lambda: source.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query = start()
    query.awaitTermination()
    query.stop()
    rows.where("id % 2 = 1").write.mode("append").parquet(f"{root}/in")
    outbox.resumed(start, "STOPPED", True).awaitTermination()
    return t.spark.read.schema(_INST).parquet(f"{root}/out")


@_r.query("stm_06_snapshot_then_stream", "SELECT id, state, id % 2 = 1 AS streamed FROM inst")
def snapshot_feed(t):
    root, rows = _folder(t.spark, "feed"), t.inst().select("id", "state")
    rows.where("id % 2 = 1").write.parquet(f"{root}/in")
    outbox.feed(rows.where("id % 2 = 0"), t.spark.readStream.schema(_INST).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("id", "state", (F.col("batch") >= 0).alias("streamed"))


@_r.query("stm_05_log_tail", "SELECT turn AS entry, role FROM conversations WHERE conv_id = 2 AND turn > 1 ORDER BY turn LIMIT 10")
def tail(t):
    log = t.read("conversations").select(F.col("conv_id").alias("instance"), F.col("turn").alias("entry"), "role")
    return outbox.tail(log, 2, 1, 10)[0].select("entry", "role")


@_r.query("stm_07_streaming_jobs", "SELECT i.node, count(*) AS running, max(i.id) AS newest FROM inst i WHERE i.state = 'RUNNING' GROUP BY i.node")
def jobs(t):
    return t.inst().where("state = 'RUNNING'").groupBy("node").agg(F.count("*").alias("running"), F.max("id").alias("newest"))


@_r.query("snk_01_snapshot_overwrite", "SELECT id, biz_date, CASE WHEN biz_date = '2024-01-15' THEN 'new' ELSE state END AS state FROM inst")
def snapshot(t):
    root = _folder(t.spark, "snapshot")
    rows = t.inst().select("id", "state", "biz_date")
    connectors.write_days(rows, root)
    connectors.write_days(rows.where("biz_date = '2024-01-15'").withColumn("state", F.lit("new")), root)
    return t.spark.read.parquet(root).select("id", F.col("biz_date").cast("string").alias("biz_date"), "state")


@_r.query("snk_02_retention", "SELECT id FROM inst WHERE CAST(biz_date AS DATE) >= DATE '2024-01-31' - 10")
def retention(t):
    return connectors.retained(t.inst(), "2024-01-31", 10).select("id")


_CHECKED = "WITH p AS (SELECT DISTINCT dst, src, 'UNVERIFIED' AS c FROM flow WHERE src LIKE 'supplier:%' AND task_id % 2 = 0), d AS (SELECT DISTINCT dst, src FROM flow WHERE src LIKE 'supplier:%' AND task_id % 3 = 0) SELECT coalesce(p.dst, d.dst) AS dst, coalesce(p.src, d.src) AS src, CASE WHEN p.c IS NOT NULL AND d.src IS NOT NULL THEN 'CONFIRMED' WHEN p.c IS NULL THEN 'DECLARED' WHEN p.dst IN (SELECT dst FROM d) THEN 'CONFLICT' ELSE p.c END AS confidence FROM p FULL JOIN d ON p.dst = d.dst AND p.src = d.src"


def _checked(t):
    flow = t.flow().where("src like 'supplier:%'")
    parsed = flow.where("task_id % 2 = 0").select("dst", "src").distinct().withColumn("confidence", F.lit("UNVERIFIED"))
    return sl.cross_checked(parsed, flow.where("task_id % 3 = 0").select("dst", "src").distinct())


@_r.query("lin_09_cross_check", _CHECKED)
def cross_check(t):
    return _checked(t)


@_r.query("lin_13_channel_merge", "SELECT dst, src, task_id FROM (SELECT dst, src, task_id, row_number() OVER (PARTITION BY dst, src ORDER BY task_id % 4, task_id) AS k FROM flow) WHERE k = 1")
def channel_merge(t):
    return keyed.top(dealt(t.flow(), t.flow_rows(), "dst", "src"), ["dst", "src"], [F.col("task_id") % 4, F.col("task_id")], 1).select("dst", "src", "task_id")


@_r.query("lin_15_grounding", f"SELECT dst, src, CASE WHEN x = 'PRESENT' AND confidence = 'UNVERIFIED' THEN 'CONFIRMED' ELSE confidence END AS confidence FROM (SELECT c.*, CASE WHEN p_partkey % 5 = 0 THEN 'ABSENT' WHEN p_partkey % 5 = 1 THEN 'UNKNOWN' ELSE 'PRESENT' END AS x FROM ({_CHECKED}) c LEFT JOIN part ON 'part:' || p_partkey = c.dst) WHERE NOT (coalesce(x = 'ABSENT', false) AND confidence = 'UNVERIFIED')")
def grounding(t):
    k = F.col("p_partkey") % 5
    known = t.read("part").select(F.concat(F.lit("part:"), "p_partkey").alias("table"), F.when(k == 0, "ABSENT").when(k == 1, "UNKNOWN").otherwise("PRESENT").alias("exists"))
    return sl.grounded(_checked(t), known).select("dst", "src", "confidence")


@_r.query("lin_12_script_calls", r"SELECT doc_id, len(regexp_extract_all(text, '(?:saveAsTable|insertInto|to_sql)\(\s*[''\x22]([\w.]+)', 1)) AS writes FROM documents")
def calls(t):
    return t.read("documents").select("doc_id", F.size(sl.script_tables(F.col("text"))[1]).alias("writes"))



@_r.query("src_19_json_lines", "SELECT doc_id, lang, source, n_chars FROM documents")
def json_lines(t):
    """A JSON-lines sink and its scan."""
    docs, path = t.read("documents").select("doc_id", "lang", "source", "n_chars"), _folder(t.spark, "lines")
    docs.write.json(path)
    return t.spark.read.schema(docs.schema).json(path)


_PLACED = "SELECT l_orderkey AS statement, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS k, l_linenumber, 's' || l_suppkey AS src, count(*) OVER (PARTITION BY l_orderkey) AS n, min(abs(l_linenumber - 3)) OVER (PARTITION BY l_orderkey) = 0 AS constant FROM lineitem"


def _statements(t):
    """An order as a statement: a source for each of its lines, given twice and with a blank, none (a constant) for lines of number 3; even ones list their targets, others fill a table of three columns."""
    line = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey")))
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("statement")).agg(line.alias("lines"))
    source = F.transform("lines", lambda x: F.when(x["l_linenumber"] != 3, F.array(*(F.concat(F.lit("s"), x["l_suppkey"]),) * 2, F.lit(" "))).otherwise(F.array().cast("array<string>")))
    listed = F.when(F.col("statement") % 2 == 0, F.transform("lines", lambda x, i: F.concat(F.lit("t"), i + 1)))
    return rows.select("statement", listed.alias("targets"), F.array(F.lit("t1"), F.lit("t2"), F.lit("t3")).alias("catalog"), source.alias("sources"))


@_r.query("lin_04_column_edges", f"SELECT DISTINCT statement, 't' || k AS dst, src FROM ({_PLACED}) WHERE l_linenumber <> 3 AND (statement % 2 = 0 OR k <= 3)")
def column_edges(t):
    return sl.column_edges(_statements(t))


@_r.query("lin_06_degraded_statements", f"SELECT DISTINCT statement, constant OR statement % 2 = 1 AND n <> 3 AS degraded FROM ({_PLACED})")
def degraded(t):
    return sl.degraded(_statements(t))
