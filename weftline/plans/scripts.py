"""Guarded SQL, templates, schedules, script-lineage merging and consensus queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import scalar as s, schedules, templates
from weftline.operators import consensus as c, evaluation as e, filters, keyed, sqllineage as sl
from weftline.registry import Registry
from weftline.sources import connectors

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _view(t, name):
    t.read(name).createOrReplaceTempView(name)


@_r.query("src_04_guarded_sql", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def guarded(t):
    _view(t, "nation")
    sql = "select n_regionkey, count(*) as n from nation group by n_regionkey;"
    if reason := sl.rejected(sql):
        raise ValueError(reason)
    return t.spark.sql(sql.rstrip(";"))


@_r.query("src_05_scalar_query", "SELECT max(n_nationkey) AS value FROM nation")
def scalar(t):
    return t.spark.createDataFrame([(sl.scalar(t.read("nation").agg(F.max("n_nationkey"))),)], "value int")


@_r.query("src_06_statement_script", "SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
def script(t):
    _view(t, "nation")
    return sl.run_script(t.spark, "create or replace temporary view one as select * from nation where n_regionkey = 1; -- a; comment\nselect n_name as name from one;")


_TYPES = "SELECT * FROM (VALUES ('mysql', 'rdb', 3306), ('postgres', 'rdb', 5432), ('oracle', 'rdb', 1521), ('sqlserver', 'rdb', 1433), ('mariadb', 'rdb', 3306), ('db2', 'rdb', 50000), ('hive', 'mpp', 10000), ('impala', 'mpp', 21050), ('clickhouse', 'mpp', 8123), ('starrocks', 'mpp', 9030), ('doris', 'mpp', 9030), ('mongodb', 'nosql', 27017), ('redis', 'nosql', 6379), ('elasticsearch', 'nosql', 9200), ('hbase', 'nosql', 16000), ('s3', 'storage', 9000), ('hdfs', 'storage', 8020), ('ftp', 'storage', 21)) v(type, family, port)"


@_r.query("src_14_connector_catalogue", f"SELECT s.s_suppkey AS id, v.type, v.family, CASE WHEN s.s_suppkey % 5 = 0 THEN 1000 + s.s_nationkey ELSE v.port END AS port, CASE WHEN v.type = 'mysql' THEN 'jdbc:mysql://h' || s.s_suppkey || ':' || CASE WHEN s.s_suppkey % 5 = 0 THEN 1000 + s.s_nationkey ELSE v.port END || '/db' || s.s_nationkey END AS mysql_url FROM supplier s JOIN (SELECT *, row_number() OVER (ORDER BY type) - 1 AS k FROM ({_TYPES})) v ON v.k = s.s_suppkey % 20")
def catalogue(t):
    """Every supplier as a source of some type, two of them unknown, one in five with a port of its own."""
    kinds = F.array(*map(F.lit, [*sorted(connectors.CONNECTORS), "cobol", "punch card"]))
    rows = t.read("supplier").select(F.col("s_suppkey").alias("id"), F.element_at(kinds, (F.col("s_suppkey") % 20 + 1).cast("int")).alias("type"), F.concat(F.lit("h"), "s_suppkey").alias("host"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_nationkey") + 1000).cast("int").alias("port"), F.concat(F.lit("db"), "s_nationkey").alias("db"))
    return connectors.addressed(rows).select("id", "type", "family", "port", F.when(F.col("type") == "mysql", F.col("url")).alias("mysql_url"))


@_r.query("src_16_column_metadata", "SELECT column_name AS name FROM (DESCRIBE nation)")
def metadata(t):
    return t.spark.createDataFrame([(f.name,) for f in t.read("nation").schema], "name string")


@_r.query("src_17_existence_probe", "SELECT id, CASE WHEN split_part(id, ':', 1) IN ('nation', 'region') THEN 'PRESENT' ELSE 'ABSENT' END AS state FROM vertex WHERE split_part(id, ':', 1) <> 'customer'")
def probe(t):
    """Of every vertex, whether the catalog knows the table of its kind."""
    for name in ("nation", "region"):
        _view(t, name)
    rows = t.vertex().withColumn("name", F.upper(F.substring_index("id", ":", 1))).where("name <> 'CUSTOMER'")
    return connectors.existences(rows).select("id", "state")


_ASKED = ["select * from t{};", "select 1; select {}", "drop table t{}", "with x as (select {}) delete from y", "  ", "WITH x AS (SELECT {}) SELECT * FROM x ; ", "select 'updated_{}' as selected"]


@_r.query("flt_12_read_only_guard", "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 1 THEN 'several statements' WHEN 2 THEN 'not a query' WHEN 3 THEN 'holds delete' WHEN 4 THEN 'blank' END AS reason FROM part")
def guard(t):
    text = F.element_at(F.array(*(F.format_string(x.replace("{}", "%1$s"), F.col("p_partkey").cast("string")) for x in _ASKED)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t.read("part").select(F.col("p_partkey").alias("id"), sl.rejection(text).alias("reason"))


@_r.query("flt_13_strict_biz_date", "SELECT count(*) AS n FROM run")
def strict_date(t):
    asked = "1997-5-1"
    rows = t.run().where(F.col("biz_date") == asked) if templates.is_date(asked) else t.run()
    return rows.agg(F.count("*").alias("n"))


@_r.query("scl_05_templates", "SELECT id, CASE id % 4 WHEN 0 THEN strftime(CAST(biz_date AS DATE) - 1, '%Y%m%d') WHEN 1 THEN strftime(CAST(biz_date AS DATE) - INTERVAL 1 MONTH, '%Y-%m') || '/x' WHEN 2 THEN strftime(CASE WHEN strftime(CAST(biz_date AS DATE), '%Y-%m') = '2024-01' THEN CAST(biz_date AS DATE) - INTERVAL 1 MONTH ELSE CAST(biz_date AS DATE) END, '%Y%m') END AS value FROM inst")
def strict_templates(t):
    """A template for every instance's business date; one of four can't be resolved."""
    text = F.element_at(F.array(*map(F.lit, ["{{yyyymmdd-1}}", "{{yyyy-mm-1}}/x", "{{bizmonth}}", "{{nothing known}}"])), (F.col("id") % 4 + 1).cast("int"))
    return templates.resolved(t.inst().select("id", "biz_date", text.alias("text")), "text", "biz_date", "2024-01-31", into="value").select("id", "value")


@_r.query("scl_06_lenient_templates", "SELECT id, CASE id % 2 WHEN 0 THEN '${none} ' || strftime(CAST(biz_date AS DATE) + 2, '%d.%m.') ELSE biz_date END AS value FROM inst")
def lenient_templates(t):
    next_month = F.when(F.day(F.date_add(F.to_date("biz_date"), 2)) < F.day(F.to_date("biz_date")), "+1").otherwise("")
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("${ none } ${dd + 2}.${mm"), next_month, F.lit("}."))).otherwise("${yyyy-mm-dd}")
    rows = t.inst().select("id", "biz_date", text.alias("text"))
    return templates.resolved(rows, "text", "biz_date", "2024-01-31", into="value", lenient=True).select("id", "value")


@_r.query("scl_09_default_biz_date", "SELECT id, CAST(started_at AS DATE) - 1 AS d FROM run")
def default_date(t):
    return t.run().select("id", F.date_sub(F.to_date("started_at"), 1).alias("d"))


@_r.query("scl_11_next_fire", "SELECT id, CASE id % 2 WHEN 0 THEN date_trunc('day', finished_at) + INTERVAL 1 DAY ELSE date_trunc('second', finished_at) + INTERVAL 90 SECOND END AS next FROM inst")
def next_fire(t):
    rows = t.inst().select("id", F.date_trunc("second", F.col("finished_at")).cast("timestamp_ntz").alias("base"), F.when(F.col("id") % 2 == 0, "0 0 0 * * ?").alias("cron"), F.lit(90).alias("seconds"))
    return schedules.next_fires(rows, "base", "cron", "seconds").select("id", "next")


@_r.query("scl_13_held_depth", "SELECT p_partkey AS id, CASE WHEN p_size - 5 BETWEEN 1 AND 20 THEN p_size - 5 ELSE 20 END AS depth FROM part")
def depth(t):
    return t.read("part").select(F.col("p_partkey").alias("id"), filters.held_depths(F.col("p_size") - 5).alias("depth"))


@_r.query("scl_21_job_or_library", r"SELECT doc_id, CASE WHEN source IN ('src4', 'src5') THEN 'library' WHEN regexp_matches(text, '(?m)^\s*if __name__|spark\.|\.write') THEN 'job' ELSE 'library' END AS kind FROM documents")
def job_kind(t):
    path = F.when(F.col("source").isin("src4", "src5"), "pkg/tests/x.py").otherwise("jobs/x.py")
    return t.read("documents").select("doc_id", s.job_kind(path, F.col("text")).alias("kind"))


@_r.query("scl_28_label_flags", "SELECT l_orderkey AS k, bool_or(a AND b) AS overlap FROM (SELECT l_orderkey, l_suppkey, bool_or(l_linenumber <= 2) AS a, bool_or(l_linenumber > 2) AS b FROM lineitem GROUP BY ALL) GROUP BY 1")
def flags(t):
    pick = lambda x: F.collect_set(F.when(x, F.col("l_suppkey")))
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(pick(F.col("l_linenumber") <= 2).alias("reads"), pick(F.col("l_linenumber") > 2).alias("writes"))
    return rows.select("k", F.arrays_overlap("reads", "writes").alias("overlap"))


@_r.query("scl_29_legal_names", "SELECT p_partkey AS id, p_partkey % 2 = 0 AS ok FROM part")
def legal(t):
    name = F.when(F.col("p_partkey") % 2 == 0, "db.t_1").otherwise("1t-x")
    return t.read("part").select(F.col("p_partkey").alias("id"), s.legal_name(name).alias("ok"))


@_r.query("scl_33_literal_gate", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'blank' WHEN n_nationkey % 5 = 1 THEN 'dynamic' WHEN n_nationkey % 5 = 2 THEN 'path' WHEN n_nationkey % 5 = 3 THEN 'absent' END AS reason FROM nation")
def literal_gate(t):
    k = F.col("n_nationkey") % 5
    name = F.when(k == 0, " ").when(k == 1, "t_${d}").when(k == 2, "/a/b").when(k == 3, "zz.none").otherwise("db.t")
    return t.read("nation").select(F.col("n_nationkey").alias("id"), s.literal_reject(name, F.lit("select * from db.t join x")).alias("reason"))


@_r.query("jon_19_suffix_names", "SELECT a.id, b.id AS other FROM (SELECT n_nationkey AS id, 'db.' || lower(n_name) AS name FROM nation) a JOIN (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation) b ON a.name = b.name OR ends_with(a.name, '.' || b.name) OR ends_with(b.name, '.' || a.name)")
def suffix_join(t):
    a = t.read("nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("db."), F.lower("n_name")).alias("name"))
    b = t.read("nation").select(F.col("n_nationkey").alias("other"), F.lower("n_name").alias("name"))
    return c.suffix_join(a, b).select("id", "other")


@_r.query("jon_21_content_with_params", "SELECT id, CASE WHEN id % 3 = 0 THEN 'o' WHEN id % 3 = 1 THEN 'b' ELSE 'd' END AS content, CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN 2 ELSE 3 END AS params FROM task")
def content_params(t):
    k = F.col("id") % 3
    levels = [(F.when(k == 0, "o").otherwise(" "), F.lit(1)), (F.when(k == 1, "b"), F.lit(2)), (F.lit("d"), F.lit(3))]
    first = F.coalesce(*(F.when(F.trim(x) != "", F.struct(x.alias("content"), p.alias("params"))) for x, p in levels))
    return t.task().select("id", first.alias("x")).select("id", "x.content", "x.params")


@_r.query("lin_10_table_cross_check", "WITH p AS (SELECT DISTINCT lower(dst) AS name FROM flow WHERE task_id % 2 = 0), d AS (SELECT DISTINCT upper(dst) AS name FROM flow WHERE task_id % 3 = 0) SELECT coalesce(d.name, p.name) AS name, CASE WHEN p.name IS NOT NULL AND d.name IS NOT NULL THEN 'CONFIRMED' WHEN d.name IS NULL THEN 'UNVERIFIED' ELSE 'DECLARED' END AS confidence FROM p FULL JOIN d ON p.name = lower(d.name)")
def table_check(t):
    flow = t.flow()
    parsed = flow.where("task_id % 2 = 0").select(F.lower("dst").alias("name")).distinct()
    told = flow.where("task_id % 3 = 0").select(F.upper("dst").alias("name")).distinct()
    return c.named_alike(parsed, told)


@_r.query("lin_16_system_namespace", "SELECT n_nationkey AS id, n_nationkey % 8 IN (0, 2, 4, 5) AS system FROM nation")
def system(t):
    cases = [("Information_Schema.tables", "hive"), ("dw.tables", "postgres"), ("db.pg_toast.x", "POSTGRES"), ("pg_catalog.x", "mysql"), ("performance_schema.y", "doris"), ("master.sys.objects", "sqlserver"), ("sys", "oracle"), ("sys.a.b", "oracle")]
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(e).alias("engine")) for n, e in cases))
    x = F.get(table, (F.col("n_nationkey") % 8).cast("int"))
    return t.read("nation").select(F.col("n_nationkey").alias("id"), c.system_table(x["name"], x["engine"]).alias("system"))


@_r.query("lin_17_declared_columns", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'db.t' END AS table_name, CASE WHEN p_partkey % 2 = 0 THEN 'c' END AS column_name FROM part")
def declared(t):
    x = sl.declared_columns(F.when(F.col("p_partkey") % 2 == 0, "db.t.c").otherwise("broken"))
    return t.read("part").select(F.col("p_partkey").alias("id"), x["table"].alias("table_name"), x["column"].alias("column_name"))


@_r.query("lin_19_direction_repair", "SELECT m.row, m.item, coalesce(a.direction, m.direction) AS direction FROM (SELECT l_orderkey AS row, l_suppkey AS item, min(l_returnflag) AS direction FROM lineitem GROUP BY ALL) m LEFT JOIN (SELECT l_orderkey AS row, l_suppkey AS item, max(l_linestatus) AS direction FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL) a USING (row, item)")
def repair(t):
    line = t.read("lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("item"), "l_linenumber", "l_returnflag", "l_linestatus")
    model = line.groupBy("row", "item").agg(F.min("l_returnflag").alias("direction"))
    ast = line.where("l_linenumber <= 2").groupBy("row", "item").agg(F.max("l_linestatus").alias("direction"))
    return keyed.updated(model.withColumn("key", F.struct("row", "item")), ast.select(F.struct("row", "item").alias("key"), "direction"), "key", "direction").select("row", "item", "direction")


@_r.query("lin_20_hybrid_merge", "SELECT l_orderkey AS k, len(list_distinct(list(l_suppkey) FILTER (WHERE l_linenumber <> 3))) AS n_union FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber <> 3) > 0")
def hybrid(t):
    pick = lambda x: F.collect_set(F.when(x, F.col("l_suppkey")))
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(pick(F.col("l_linenumber") < 3).alias("model"), pick(F.col("l_linenumber") > 3).alias("ast"))
    return rows.select("k", F.size(c.hybrid(F.col("model"), F.col("ast"), "union")).alias("n_union")).where("n_union > 0")


#: Scripts by nation, and what each holds, worked out by hand, as (kind, line, sql, hint).
_SCRIPTS = (
    "import os\nspark.sql(\"select * from db.t where name = 'x' and day = %s\")\n# spark.sql('select 1')\ncur.execute(query)\n",
    "q = f\"\"\"\n  insert into out.t_{day}\n  select a from b\n\"\"\"\nprint('no sql here')\n",
    "hive -e \"select * from src.$TABLE\"\nmysql <<EOF\ndelete from t where k = '1'\nEOF\n",
    "x = 'it is select'\n",
)
_EMBEDDED = (
    "(0, 2, 'select * from db.t where name = ''x'' and day = NULL', NULL), (0, 4, NULL, 'DYNAMIC_SQL'), "
    "(1, 1, 'insert into out.t___dyn__' || chr(10) || '  select a from b', 'DYNAMIC_TABLE'), "
    "(2, 1, 'select * from src.__dyn__', 'DYNAMIC_TABLE'), (2, 2, 'delete from t where k = ''1' || chr(39), NULL)"
)


@_r.query("lin_11_embedded_sql", f"SELECT n_nationkey AS script, line, sql, hint FROM nation JOIN (VALUES {_EMBEDDED}) v(kind, line, sql, hint) ON n_nationkey % 4 = kind")
def embedded(t):
    text = F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return sl.embedded_statements(t.read("nation").select(F.col("n_nationkey").alias("script"), text.alias("text")))


@_r.query("lin_21_pattern_tables", r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '\binto\s+([a-z_][\w.]*)', 1))) AS writes, len(list_distinct(regexp_extract_all(lower(text), '\b(?:from|join)\s+([a-z_][\w.]*)', 1))) AS reads FROM documents")
def pattern_tables(t):
    return t.read("documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\binto\s+([a-z_][\w.]*)"), F.lit(1)))).alias("writes"), F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:from|join)\s+([a-z_][\w.]*)"), F.lit(1)))).alias("reads"))


_VOTED = "SELECT l_orderkey AS row, l_suppkey AS item, bool_or(l_linenumber <= 2) AS a, bool_or(l_linenumber > 2) AS b FROM lineitem GROUP BY ALL"


def _voted(t):
    return t.read("lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("item")).agg(F.bool_or(F.col("l_linenumber") <= 2).alias("a"), F.bool_or(F.col("l_linenumber") > 2).alias("b"))


@_r.query("evl_12_candidate_tiers", f"SELECT tier, count(*) AS n FROM (SELECT CASE WHEN a AND b THEN 'agree' WHEN a AND item % 2 = 0 THEN 'sql_qual' WHEN a THEN 'sql_bare' WHEN item % 2 = 0 THEN 'model_qual' ELSE 'model_bare' END AS tier FROM ({_VOTED})) GROUP BY tier")
def candidate_tiers(t):
    return _voted(t).groupBy(c.candidate_tier(F.col("a"), F.col("b"), F.col("item") % 2 == 0).alias("tier")).agg(F.count("*").alias("n"))


@_r.query("evl_24_specialist_fusion", f"SELECT row, item, CASE WHEN a THEN 'specialist' ELSE 'base' END AS source FROM ({_VOTED})")
def fusion(t):
    return _voted(t).select("row", "item", F.when(F.col("a"), "specialist").otherwise("base").alias("source"))


@_r.query("evl_26_agreement_report", f"SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a) AS first, round(count(*) FILTER (WHERE a AND b)::DOUBLE / count(*) FILTER (WHERE b), 6) AS recall FROM ({_VOTED})")
def agreement(t):
    both, first, second = F.count_if(F.col("a") & F.col("b")), F.count_if("a"), F.count_if("b")
    return _voted(t).agg(both.alias("both"), first.alias("first"), F.round(e.ratio(both, second, 1.0), 6).alias("recall"))


@_r.query("evl_33_adjudication", f"SELECT row, item, a <> b AS disagree, item < 5 AS bareword FROM ({_VOTED})")
def adjudication(t):
    return _voted(t).select("row", "item", (F.col("a") != F.col("b")).alias("disagree"), (F.col("item") < 5).alias("bareword"))


@_r.query("evl_37_frozen_tiers", "SELECT p AS tier, sum(n) OVER (ORDER BY p)::BIGINT AS so_far FROM (SELECT priority AS p, count(*) AS n FROM run WHERE priority IN (1, 2, 4) GROUP BY 1)")
def frozen(t):
    order = [1, 2, 4]
    rows = t.run().where(F.col("priority").isin(order)).groupBy(F.col("priority").alias("tier")).agg(F.count("*").alias("n"))
    return rows.select("tier", F.sum("n").over(Window.orderBy("tier")).alias("so_far"))


@_r.query("evl_37_frozen_order", "SELECT tier, place, tier <> 2 AS accepted, round(sum(good) OVER (ORDER BY place)::DOUBLE / sum(n) OVER (ORDER BY place), 6) AS precision_so_far FROM (SELECT priority AS tier, CASE priority WHEN 4 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS place, count(*) AS n, count(*) FILTER (WHERE state = 'SUCCESS') AS good FROM run WHERE priority IN (4, 1, 2) GROUP BY ALL)")
def frozen_order(t):
    tiers = t.run().groupBy(F.col("priority").alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "SUCCESS").alias("good"))
    return c.frozen_tiers(tiers, [4, 1, 2], [4, 1]).select("tier", "place", "accepted", "precision_so_far")


@_r.query("evl_35_arbitrated_gold", "SELECT k, gold = 0 AND pred > 0 AS disputed, CASE WHEN gold = 0 AND pred > 0 AND told > 0 THEN told ELSE gold END AS n FROM (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber = 1 AND l_suppkey % 2 = 0) AS gold, count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber >= 2) AS pred, count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber >= 2 AND l_suppkey % 3 = 0) AS told FROM lineitem GROUP BY 1)")
def arbitrated(t):
    n, item = F.col("l_linenumber"), F.col("l_suppkey")
    pick = lambda x: F.collect_set(F.when(x, item))
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(pick((n == 1) & (item % 2 == 0)).alias("gold"), pick(n >= 2).alias("pred"), pick((n >= 2) & (item % 3 == 0)).alias("told"))
    disputed, gold = c.arbitrated(F.col("gold"), F.col("pred"), F.col("told"))
    return rows.select("k", disputed.alias("disputed"), F.size(gold).alias("n"))


@_r.query("evl_40_tiered_rescoring", f"SELECT row, count(*) FILTER (WHERE a AND b) AS auto, count(*) FILTER (WHERE a <> b) AS review FROM ({_VOTED}) GROUP BY row")
def rescoring(t):
    return _voted(t).groupBy("row").agg(F.count_if(F.col("a") & F.col("b")).alias("auto"), F.count_if(F.col("a") != F.col("b")).alias("review"))


@_r.query("evl_03_greedy_alignment")
def alignment(t):
    rows = t.read("nation").groupBy("n_regionkey").agg(F.collect_set(F.concat(F.lit("db."), F.lower("n_name"))).alias("gold"), F.collect_set(F.lower("n_name")).alias("pred"))
    return c.aligned(rows, "n_regionkey")


@_r.query("evl_08_paired_bootstrap")
def paired(t):
    """Two systems that name suppliers of an order: lines 1 to 4, and lines 2 to 5; gold are lines 1 to 3."""
    n = F.col("l_linenumber")
    seen = t.read("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.bool_or(n <= 3).alias("g"), F.bool_or(n <= 4).alias("a"), F.bool_or((n >= 2) & (n <= 5)).alias("b"))
    kinds = lambda x: (F.count_if(F.col("g") & F.col(x)).alias(f"tp_{x}"), F.count_if(~F.col("g") & F.col(x)).alias(f"fp_{x}"), F.count_if(F.col("g") & ~F.col(x)).alias(f"fn_{x}"))
    return e.paired_bootstrap(seen.groupBy("l_orderkey").agg(*kinds("a"), *kinds("b")), seed=3)
