"""Lineage graph queries: region -> nation -> customer and nation -> supplier -> part."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import filters, graph as g, keyed, tree as tree_order
from weftline.registry import Registry
from weftline.sources.store import cut, dealt

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_DOWN = "SELECT id, min(hop) AS hop FROM (WITH RECURSIVE w(id, hop) AS (SELECT CAST('{a}' AS VARCHAR), 0 UNION SELECT e.dst, w.hop + 1 FROM w JOIN flow e ON e.src = w.id WHERE w.hop < {d}) SELECT * FROM w) GROUP BY id"
_UP = "SELECT id, min(hop) AS hop FROM (WITH RECURSIVE w(id, hop) AS (SELECT CAST('{a}' AS VARCHAR), 0 UNION SELECT e.src, w.hop + 1 FROM w JOIN flow e ON e.dst = w.id WHERE w.hop < {d}) SELECT * FROM w) GROUP BY id"
_BOTH = "SELECT id, min(hop) AS hop FROM (WITH RECURSIVE w(id, hop) AS (SELECT CAST('{a}' AS VARCHAR), 0 UNION SELECT CASE WHEN e.src = w.id THEN e.dst ELSE e.src END, w.hop + 1 FROM w JOIN flow e ON e.src = w.id OR e.dst = w.id WHERE w.hop < {d}) SELECT * FROM w) GROUP BY id"
_down, _up, _both = (lambda a, d, s=s: s.format(a=a, d=d) for s in (_DOWN, _UP, _BOTH))


@_r.query("grf_01_datasources", "SELECT layer || ':' || coalesce(CAST(datasource AS VARCHAR), '-') AS source, count(*) AS tables FROM vertex GROUP BY 1 ORDER BY source LIMIT 60")
def datasources(t):
    source = F.concat("layer", F.lit(":"), F.coalesce(F.col("datasource").cast("string"), F.lit("-")))
    return t.vertex().groupBy(source.alias("source")).agg(F.count("*").alias("tables")).orderBy("source").limit(60)


@_r.query("grf_02_tables_of_layer", "SELECT v.id, v.name, count(f.src) AS inputs FROM vertex v LEFT JOIN flow f ON f.dst = v.id WHERE v.layer = 'DWS' GROUP BY v.id, v.name")
def of_layer(t):
    inputs = t.flow().groupBy("dst").agg(F.count("*").alias("inputs"))
    rows = t.vertex().where("layer = 'DWS'")
    return rows.join(inputs, rows["id"] == inputs["dst"], "left").select("id", "name", F.coalesce("inputs", F.lit(0)).alias("inputs"))


@_r.query("grf_03_columns", "SELECT conv_id AS table_id, turn AS ordinal, role AS name FROM conversations WHERE conv_id = 3 ORDER BY turn")
def columns(t):
    return t.read("conversations").where("conv_id = 3").select(F.col("conv_id").alias("table_id"), F.col("turn").alias("ordinal"), F.col("role").alias("name")).orderBy("ordinal")


@_r.query("grf_04_expand", f"SELECT id FROM ({_both('nation:5', 1)})")
def expand(t):
    return g.neighbourhood(t.flow(), t.vertex(), "nation:5", 1).select("id")


@_r.query("grf_05_downstream", f"SELECT id, hop FROM ({_down('region:2', 3)}) WHERE hop > 0")
def downstream(t):
    return g.downstream(t.flow(), t.vertex(), "region:2", 3)


@_r.query("grf_05_upstream", f"SELECT id, hop FROM ({_up('part:11', 20)}) WHERE hop > 0")
def upstream(t):
    return g.upstream(t.flow(), t.vertex(), "part:11", 5)


@_r.query("grf_05_downstream_edges", f"SELECT src, dst, confidence FROM flow WHERE src IN (SELECT id FROM ({_down('region:2', 3)}) WHERE hop > 0) AND dst IN (SELECT id FROM ({_down('region:2', 3)}) WHERE hop > 0) AND confidence IN ('CONFIRMED', 'DECLARED')")
def downstream_edges(t):
    flow = t.flow().where(filters.one_of("confidence", "CONFIRMED,DECLARED"))
    return g.closed(flow.select("src", "dst", "confidence"), g.downstream(t.flow(), t.vertex(), "region:2", 3)).select("src", "dst", "confidence")


@_r.query("grf_06_column_upstream", f"SELECT id, hop FROM ({_up('customer:7', 2)}) WHERE hop > 0")
def column_upstream(t):
    return g.upstream(t.flow(), t.vertex(), "customer:7", 2)


@_r.query("grf_07_neighbourhood", f"SELECT id, hop FROM ({_both('supplier:3', 2)})")
def neighbourhood(t):
    return g.neighbourhood(t.flow(), t.vertex(), "supplier:3", 2)


@_r.query("grf_08_impact", f"SELECT id, hop FROM ({_down('nation:4', 20)}) WHERE hop > 0 ORDER BY hop, id LIMIT 50 OFFSET 10")
def impact(t):
    return g.impact_page(t.flow(), t.vertex(), "nation:4", 4, 10, 50)


@_r.query("grf_08_impact_count", f"SELECT least(count(*), 10000) AS n, count(*) >= 10000 AS lower_bound FROM ({_down('nation:4', 20)}) WHERE hop > 0")
def impact_count(t):
    return filters.capped_count(g.downstream(t.flow(), t.vertex(), "nation:4", 4).select("id"))


@_r.query("grf_09_search", "SELECT id, name FROM ((SELECT id, name FROM vertex WHERE id LIKE 'nation:%' AND lower(name) LIKE '%an%' ORDER BY name, id LIMIT 15) UNION ALL (SELECT id, name FROM vertex WHERE id LIKE 'region:%' AND lower(name) LIKE '%an%' ORDER BY name, id LIMIT 15)) ORDER BY name, id LIMIT 15")
def search(t):
    return keyed.search(t.vertex(), "AN", ("nation", "region"), 15)


def _walks(edges: str, start: str, end: str, depth: int) -> str:
    """SQL for all walks of up to ``depth`` hops that use no edge twice."""
    return f"""WITH RECURSIVE e AS ({edges}), w AS (
        SELECT [src, dst] AS path, [{{'src': src, 'dst': dst}}] AS used, dst AS node, 1 AS hops FROM e WHERE src = '{start}'
        UNION ALL SELECT list_append(path, e.dst), list_append(used, {{'src': e.src, 'dst': e.dst}}), e.dst, hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < {depth} AND NOT list_contains(used, {{'src': e.src, 'dst': e.dst}}))
        SELECT array_to_string(path, '>') AS path, hops FROM w WHERE node = '{end}' ORDER BY hops, w.path LIMIT 200"""


@_r.query("grf_10_paths", _walks("SELECT DISTINCT src, dst FROM flow", "region:0", "part:4", 4))
def paths(t):
    return g.paths(t.flow(), "region:0", "part:4", 4).select(F.array_join("path", ">").alias("path"), "hops")


_HANDED = "SELECT DISTINCT CAST(a.worker AS VARCHAR) AS src, CAST(b.worker AS VARCHAR) AS dst FROM dag_edge e JOIN dag_node a ON a.run_id = e.run_id AND a.node = e.src JOIN dag_node b ON b.run_id = e.run_id AND b.node = e.dst WHERE a.worker % 3 <> 0 AND b.worker % 4 <> 1 AND a.worker <> b.worker"


@_r.query("grf_10_paths_with_cycles", _walks(_HANDED, "1", "2", 3))
def cyclic_paths(t):
    """Among workers that hand runs to each other, a dense graph with cycles: paths of every length, back through their own ends too."""
    before = F.lag("worker").over(Window.partitionBy("run_id").orderBy("node"))
    edges = t.dag_node().select(before.cast("string").alias("src"), F.col("worker").cast("string").alias("dst")).where("src is not null and src % 3 <> 0 and dst % 4 <> 1 and src <> dst")
    return g.paths(edges, "1", "2", 3).select(F.array_join("path", ">").alias("path"), "hops")


@_r.query("grf_11_metric_sources", "SELECT DISTINCT f.src AS source, v.layer FROM flow f JOIN vertex v ON v.id = f.src WHERE f.dst = 'part:17'")
def metric(t):
    sources = t.flow().where("dst = 'part:17'").select(F.col("src").alias("id")).distinct()
    return t.vertex().join(sources, "id", "left_semi").select(F.col("id").alias("source"), "layer")


_ONE = "SELECT DISTINCT 'n' || src AS src, 'n' || dst AS dst, task_id FROM flow WHERE src LIKE 'nation:%' AND dst LIKE 'supplier:%' UNION SELECT DISTINCT 'n' || src, 'n' || dst, task_id + 100 FROM flow WHERE src LIKE 'supplier:%'"


@_r.query("grf_12_downstream_tasks", f"WITH e AS ({_ONE}) SELECT w.task_id, r.task_id AS other, 1 AS level FROM e w JOIN e r ON r.src = w.dst WHERE w.task_id <> r.task_id GROUP BY ALL")
def task_down(t):
    return g.task_levels(_tasks(t), 3)


@_r.query("grf_13_upstream_tasks", f"WITH e AS ({_ONE}) SELECT r.task_id, w.task_id AS other, 1 AS level FROM e w JOIN e r ON r.src = w.dst WHERE w.task_id <> r.task_id GROUP BY ALL")
def task_up(t):
    back = _tasks(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "task_id")
    return g.task_levels(back, 3)


_STEPS = "SELECT 'd' || (p_partkey - 1 - p_partkey % 4) AS src, 'd' || p_partkey AS dst, p_partkey // 3 AS task_id FROM part"


def _levels(edges: str, depth: int) -> str:
    """SQL for ``task_levels``: flows on from what a task writes, the least number of hops to what another reads."""
    return f"""WITH RECURSIVE e AS ({edges}), w AS (SELECT DISTINCT task_id, dst AS id, 0 AS hop FROM e UNION SELECT w.task_id, e.dst, hop + 1 FROM w JOIN e ON e.src = w.id WHERE hop < {depth})
        SELECT w.task_id, r.task_id AS other, min(hop) + 1 AS level FROM w JOIN (SELECT DISTINCT task_id, src FROM e) r ON r.src = w.id WHERE r.task_id <> w.task_id GROUP BY ALL"""


def _steps(t, src="src", dst="dst"):
    """Parts as data sets, each made of an earlier one by a task that makes three of them."""
    return t.read("part").selectExpr(f"concat('d', p_partkey - 1 - p_partkey % 4) {src}", f"concat('d', p_partkey) {dst}", "cast(floor(p_partkey / 3) as long) task_id")


@_r.query("grf_12_downstream_levels", _levels(_STEPS, 5))
def task_levels_down(t):
    return g.task_levels(_steps(t), 5)


@_r.query("grf_13_upstream_levels", _levels(_STEPS.replace(" AS src", " AS x").replace(" AS dst", " AS src").replace(" AS x", " AS dst"), 5))
def task_levels_up(t):
    return g.task_levels(_steps(t, "dst", "src"), 5)


def _tasks(t):
    flow = t.flow().where("src like 'supplier:%' or src like 'nation:%' and dst like 'supplier:%'")
    later = F.when(F.col("src").startswith("supplier:"), 100).otherwise(0)
    return flow.select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"), (F.col("task_id") + later).alias("task_id"))


@_r.query("grf_14_corrections", "SELECT f.src, f.dst, f.confidence, coalesce(c.action = 'CONFIRMED', false) AS confirmed FROM flow f LEFT JOIN (SELECT src, dst, CASE WHEN count(*) % 2 = 0 OR task_id % 3 = 0 THEN 'REMOVED' ELSE 'CONFIRMED' END AS action FROM flow WHERE confidence = 'UNVERIFIED' GROUP BY src, dst, task_id) c USING (src, dst) WHERE c.action IS NULL OR c.action <> 'REMOVED'")
def corrections(t):
    flow = t.flow()
    action = F.when((F.count("*") % 2 == 0) | (F.col("task_id") % 3 == 0), "REMOVED").otherwise("CONFIRMED")
    found = flow.where("confidence = 'UNVERIFIED'").groupBy("src", "dst", "task_id").agg(action.alias("action")).drop("task_id")
    return g.corrected(dealt(flow.select("src", "dst", "confidence"), t.flow_rows(), "src", "dst"), found)


@_r.query("grf_15_cycle_residue", "SELECT count(*) > 0 AS cyclic FROM flow WHERE src = dst")
def cycles(t):
    return g.peeled(t.flow()).agg((F.count("*") > 0).alias("cyclic"))


@_r.query("grf_15_cycle_path", "WITH RECURSIVE w(place, id) AS (SELECT 0, 0 UNION ALL SELECT place + 1, (id + 5) % 25 FROM w WHERE place < 5) SELECT place, id FROM w")
def cycle_path(t):
    """Nations that lead to the fifth after them, in five rings; regions lead into these, and each nation out to a leaf."""
    n = t.read("nation").select(F.col("n_nationkey").cast("int").alias("src"))
    into = t.read("region").select((100 + F.col("r_regionkey")).cast("int").alias("src"), F.col("r_regionkey").cast("int").alias("dst"))
    return g.closed_path(n.withColumn("dst", (F.col("src") + 5) % 25).union(n.withColumn("dst", F.col("src") + 200)).union(into))


@_r.query("grf_16_dependency_check", "SELECT count(*) AS left_over FROM dag_edge WHERE src >= dst")
def dependencies(t):
    inner = t.dag_edge().select(F.concat_ws("/", "run_id", "src").alias("src"), F.concat_ws("/", "run_id", "dst").alias("dst"))
    return g.peeled(inner).agg(F.count("*").alias("left_over"))


@_r.query("grf_17_scope_closure", "SELECT a.run_id, a.node FROM dag_node a JOIN (SELECT run_id, max(node) AS top FROM dag_node WHERE state = 'FAILED' GROUP BY 1) b ON a.run_id = b.run_id AND a.node <= b.top")
def closure(t):
    seeds = t.dag_node().where("state = 'FAILED'").groupBy("run_id").agg(F.max("node").alias("id"))
    back = t.dag_edge().select("run_id", "dst", "src")
    return _per_run(back, seeds, "dst", "src", 7).select("run_id", F.col("id").alias("node"))


def _per_run(edges, seeds, src, dst, depth):
    """Reach within each run. Edges are made once, not for each hop."""
    return g.reach(cut(edges), seeds, depth, src, dst, key=["run_id"], inside=True)


@_r.query("grf_18_frozen_downstream", "SELECT a.run_id, a.node, a.rank - b.rank AS hop FROM dag_node a JOIN (SELECT run_id, min(rank) AS rank FROM dag_node WHERE strength = 'WEAK' GROUP BY 1) b ON a.run_id = b.run_id AND a.rank >= b.rank")
def frozen(t):
    seeds = t.dag_node().where("strength = 'WEAK'").groupBy("run_id").agg(F.min("node").alias("id"))
    return _per_run(t.dag_edge().select("run_id", "src", "dst"), seeds, "src", "dst", 7).select("run_id", F.col("id").alias("node"), "hop")


@_r.query("grf_19_layers", "SELECT run_id, node, rank - 1 AS layer, 50 + 220 * (rank - 1) AS x FROM dag_node")
def dag_layers(t):
    return g.layers(t.dag_edge(), t.dag_node().select("run_id", F.col("node").alias("id")), key=["run_id"]).withColumnRenamed("id", "node")


@_r.query("grf_20_merged_dependencies", "WITH a AS (SELECT DISTINCT src, dst, 1 AS hop FROM flow WHERE src LIKE 'nation:%'), b AS (SELECT DISTINCT src, dst, 2 AS hop FROM flow WHERE confidence = 'DECLARED' OR src LIKE 'supplier:%') SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN b.src IS NULL THEN 'DECLARED' WHEN a.src IS NULL THEN 'DERIVED' ELSE 'BOTH' END AS origin, least(a.hop, b.hop) AS hop FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst")
def merged(t):
    flow = t.flow()
    a = flow.where("src like 'nation:%'").select("src", "dst").distinct().withColumn("hop", F.lit(1))
    b = dealt(flow.where("confidence = 'DECLARED' or src like 'supplier:%'").select("src", "dst"), t.flow_rows(), "src", "dst").distinct().withColumn("hop", F.lit(2))
    return g.merged_dependencies(a, b)


@_r.query("grf_21_tree", "SELECT '/' || n_regionkey || '/' || n_nationkey || '/' AS path, n_name AS name FROM nation UNION ALL SELECT '/' || r_regionkey || '/', r_name FROM region ORDER BY path")
def tree(t):
    nation = t.read("nation").select(F.concat_ws("/", F.lit(""), "n_regionkey", "n_nationkey", F.lit("")).alias("path"), F.col("n_name").alias("name"))
    return nation.union(t.read("region").select(F.concat_ws("/", F.lit(""), "r_regionkey", F.lit("")), "r_name")).orderBy("path")


_TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey > 1 + p_partkey % 4 THEN p_partkey - 1 - p_partkey % 4 END AS parent, CASE WHEN p_size % 5 > 0 THEN p_size % 3 END AS sort, CASE WHEN p_partkey % 11 > 0 THEN p_name END AS name FROM part"


@_r.query("grf_21_preorder", f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY coalesce(sort, 0), name NULLS LAST, id) AS r FROM ({_TREE})),
    w AS (SELECT id, parent, [r] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, list_append(w.path, n.r) FROM w JOIN n ON n.parent = w.id)
    SELECT id, parent, row_number() OVER (ORDER BY path) - 1 AS place, len(path) - 1 AS depth FROM w""")
def preorder(t):
    """Parts as a tree of hundreds of levels in reading order."""
    return tree_order.preorder(t.read("part").selectExpr("p_partkey id", "if(p_partkey > 1 + p_partkey % 4, p_partkey - 1 - p_partkey % 4, null) parent", "if(p_size % 5 > 0, p_size % 3, null) sort", "if(p_partkey % 11 > 0, p_name, null) name"))


@_r.query("grf_22_correction_write", "SELECT src, dst, max(task_id) AS task_id FROM (SELECT src, dst, task_id FROM flow WHERE task_id % 4 <> 1 UNION ALL SELECT src, dst, task_id + 1000 FROM flow WHERE task_id % 4 = 2) GROUP BY src, dst")
def correction_write(t):
    flow = t.flow().select("src", "dst", "task_id")
    new = flow.where("task_id % 4 = 2").withColumn("task_id", F.col("task_id") + 1000)
    return keyed.upserted(flow.where("task_id % 4 <> 1"), new, ["src", "dst"], [F.col("task_id").desc()], t.flow_rows())


@_r.query("grf_23_neighbour_tables", f"SELECT id, hop FROM ({_both('nation:9', 2)}) WHERE hop > 0 ORDER BY hop, id LIMIT 100")
def near_tables(t):
    return g.neighbourhood(t.flow(), t.vertex(), "nation:9", 2).where("hop > 0").orderBy("hop", "id").limit(100)


@_r.query("grf_24_declared_dependencies", "SELECT DISTINCT a.worker AS task, b.worker AS needs FROM dag_edge e JOIN dag_node a ON a.run_id = e.run_id AND a.node = e.dst JOIN dag_node b ON b.run_id = e.run_id AND b.node = e.src WHERE a.worker <> b.worker")
def declared(t):
    from pyspark.sql import Window

    before = F.lag("worker").over(Window.partitionBy("run_id").orderBy("node"))
    return t.dag_node().select(F.col("worker").alias("task"), before.alias("needs")).where("needs is not null and task <> needs").distinct()


@_r.query("lin_14_flow_confidence", "WITH f AS MATERIALIZED (SELECT * FROM flow) SELECT a.src AS reads, b.dst AS writes, CASE WHEN CASE b.confidence WHEN 'CONFIRMED' THEN 0 WHEN 'DECLARED' THEN 1 WHEN 'UNVERIFIED' THEN 2 ELSE 3 END > CASE a.confidence WHEN 'CONFIRMED' THEN 0 WHEN 'DECLARED' THEN 1 WHEN 'UNVERIFIED' THEN 2 ELSE 3 END THEN b.confidence ELSE a.confidence END AS confidence FROM f a JOIN f b ON a.dst = b.src")
def flow_confidence(t):
    a = t.flow().select(F.col("src").alias("reads"), F.col("dst").alias("mid"), F.col("confidence").alias("ca"))
    b = t.flow().select(F.col("src").alias("mid"), F.col("dst").alias("writes"), F.col("confidence").alias("cb"))
    return a.join(b, "mid").select("reads", "writes", g.weaker(F.col("ca"), F.col("cb")).alias("confidence"))
