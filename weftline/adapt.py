"""Driver tables as the tables of a data platform: tasks, runs, instances, dependency graphs, lineage and corpora.

Each view is there twice, as DataFrame operations and as DuckDB SQL for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.sources.store import dealt

#: The instant that stands for now in all queries over events, and over orders.
AS_OF, RUN_AS_OF = "2024-01-31 00:00:00", "2001-08-01 00:00:00"
STATES = {"purchase": "SUCCESS", "error": "FAILED", "click": "WAITING", "view": "RUNNING", "signup": "STOPPED"}

_STATE = "CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'WAITING' WHEN 'view' THEN 'RUNNING' WHEN 'signup' THEN 'STOPPED' END"
VIEWS = {
    "task": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type, c_nationkey AS project_id, c_acctbal AS balance FROM customer",
    "inst": f"SELECT event_id AS id, user_id AS task_id, {_STATE} AS state, strftime(ts, '%Y-%m-%d') AS biz_date, ts - to_seconds(CAST(floor(greatest(value, 0)) AS BIGINT)) AS started_at, ts AS finished_at, event_id % 10 AS priority, 'node-' || CAST(event_id % 17 AS VARCHAR) AS node, props FROM events",
    "run": "SELECT o_orderkey AS id, o_custkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'WAITING' ELSE 'FAILED' END AS state, strftime(o_orderdate, '%Y-%m-%d') AS biz_date, o_orderdate AS started_at, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderpriority AS label, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders",
    "dag_node": "SELECT l_orderkey AS run_id, l_linenumber AS node, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rank, CASE min(l_linestatus) WHEN 'F' THEN 'SUCCESS' ELSE 'FAILED' END AS state, CASE WHEN min(l_returnflag) = 'R' THEN 'WEAK' ELSE 'STRONG' END AS strength, min(l_suppkey) AS worker FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "dag_edge": "SELECT a.run_id, a.node AS src, b.node AS dst, a.state AS src_state, b.strength FROM dag_node a JOIN dag_node b ON a.run_id = b.run_id AND b.rank = a.rank + 1",
    "flow": "SELECT 'region:' || r_regionkey AS src, 'nation:' || n_nationkey AS dst, CAST(n_nationkey AS BIGINT) AS task_id, 'CONFIRMED' AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, CAST(c_nationkey AS BIGINT), CASE WHEN c_custkey % 3 = 0 THEN 'UNVERIFIED' ELSE 'DECLARED' END FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, CAST(s_nationkey AS BIGINT), 'DECLARED' FROM supplier UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, CAST(s_nationkey AS BIGINT), CASE WHEN l_partkey % 5 = 0 THEN 'CONFLICT' ELSE 'CONFIRMED' END FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey",
    "vertex": "SELECT 'region:' || r_regionkey AS id, r_name AS name, 'ODS' AS layer, CAST(NULL AS BIGINT) AS datasource FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'DWD', CAST(n_regionkey AS BIGINT) FROM nation UNION ALL SELECT 'customer:' || c_custkey, c_name, 'DWS', CAST(c_nationkey AS BIGINT) FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'DWS', CAST(s_nationkey AS BIGINT) FROM supplier UNION ALL SELECT 'part:' || p_partkey, p_name, 'ADS', CAST(p_size AS BIGINT) FROM part",
}


class Tables:
    """The tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def task(self) -> DataFrame:
        return self.read("customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment type", "c_nationkey project_id", "c_acctbal balance")

    def inst(self) -> DataFrame:
        state = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in STATES.items()))
        began = F.expr("ts - make_interval(0, 0, 0, 0, 0, 0, floor(greatest(value, 0)))")
        return self.read("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), state.alias("state"), F.date_format("ts", "yyyy-MM-dd").alias("biz_date"), began.alias("started_at"),
            F.col("ts").alias("finished_at"), (F.col("event_id") % 10).alias("priority"), F.concat(F.lit("node-"), (F.col("event_id") % 17).cast("string")).alias("node"), "props")

    def run(self) -> DataFrame:
        state = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "WAITING").otherwise("FAILED")
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"), state.alias("state"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("biz_date"), F.col("o_orderdate").alias("started_at"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderpriority").alias("label"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))

    def dag_node(self) -> DataFrame:
        node = self.read("lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("node")).agg(
            F.when(F.min("l_linestatus") == "F", "SUCCESS").otherwise("FAILED").alias("state"), F.when(F.min("l_returnflag") == "R", "WEAK").otherwise("STRONG").alias("strength"), F.min("l_suppkey").alias("worker"))
        return node.withColumn("rank", F.dense_rank().over(Window.partitionBy("run_id").orderBy("node")))

    def dag_edge(self) -> DataFrame:
        """Neighbouring nodes of a run: the next node is in the same partition, so a window finds it without a join."""
        by = Window.partitionBy("run_id").orderBy("node")
        pairs = self.dag_node().select("run_id", F.col("node").alias("src"), F.lead("node").over(by).alias("dst"), F.col("state").alias("src_state"), F.lead("strength").over(by).alias("strength"))
        return pairs.where("dst is not null")

    def flow(self) -> DataFrame:
        edge = lambda df, src, dst, task, conf: df.select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.col(task).cast("long").alias("task_id"), F.expr(conf).alias("confidence"))
        supplier = self.read("supplier")
        sold = dealt(self.read("lineitem").select("l_suppkey", "l_partkey"), self.read("lineitem").count(), "l_suppkey", "l_partkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        parts = [
            edge(self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")), "concat('region:', r_regionkey)", "concat('nation:', n_nationkey)", "n_nationkey", "'CONFIRMED'"),
            edge(self.read("customer"), "concat('nation:', c_nationkey)", "concat('customer:', c_custkey)", "c_nationkey", "if(c_custkey % 3 = 0, 'UNVERIFIED', 'DECLARED')"),
            edge(supplier, "concat('nation:', s_nationkey)", "concat('supplier:', s_suppkey)", "s_nationkey", "'DECLARED'"),
            edge(sold, "concat('supplier:', l_suppkey)", "concat('part:', l_partkey)", "s_nationkey", "if(l_partkey % 5 = 0, 'CONFLICT', 'CONFIRMED')"),
        ]
        return parts[0].union(parts[1]).union(parts[2]).union(parts[3])

    def flow_rows(self) -> int:
        """How many edges ``flow`` has at most, from what files say of themselves; regions and nations apart."""
        return sum(self.read(name).count() for name in ("lineitem", "customer", "supplier"))

    def vertex(self) -> DataFrame:
        node = lambda t, key, name, layer, of: self.read(t).select(F.concat(F.lit(f"{t}:"), F.col(key)).alias("id"), F.col(name).alias("name"), F.lit(layer).alias("layer"), (F.col(of) if of else F.lit(None)).cast("long").alias("datasource"))
        parts = [node("region", "r_regionkey", "r_name", "ODS", None), node("nation", "n_nationkey", "n_name", "DWD", "n_regionkey"), node("customer", "c_custkey", "c_name", "DWS", "c_nationkey"), node("supplier", "s_suppkey", "s_name", "DWS", "s_nationkey"), node("part", "p_partkey", "p_name", "ADS", "p_size")]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
