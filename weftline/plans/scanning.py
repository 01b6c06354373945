"""Queries over scripts: every order is one, a line of it a piece of code about its part and its supplier."""

from pyspark.sql import functions as F

from weftline.operators import runner
from weftline.operators import scriptlineage as sl
from weftline.plans.platform import _folder
from weftline.registry import Registry
from weftline.sources import lines

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

#: Code by line number; {p} and {s} stand for the line's part and supplier.
CODE = [
    'spark.sql("INSERT INTO dw.t{p} SELECT a, b FROM ods.s{s} WHERE c = \'from no.c\'")',
    'cur.execute("""\nMERGE INTO dw.t{p} USING Ods.S{s} AS x ON x.k = k\nWHEN MATCHED THEN UPDATE SET a = 1\n""")',
    '# spark.sql("INSERT INTO no.t{p} SELECT * FROM no.s{s}")\nprint("select * from no.s{s}")',
    'work{p} = "WITH c{s} AS (SELECT * FROM ods.s{s}) " + "INSERT INTO dw.t{p} SELECT * FROM c{s} JOIN (SELECT 1) z"\nspark.sql(work{p})',
    'sh = "x"\nhive -e "CREATE OR REPLACE TEMPORARY VIEW v{p} AS SELECT * FROM ods.s{s}, ods.both"',
    'spark.sql("INSERT INTO {{{{ target }}}} SELECT * FROM no.s{s}")',
    'psql <<EOF\nDELETE FROM dw.t{p} WHERE k IN (SELECT k FROM ods.s{s}); -- from no.d\nEOF\n',
]

_LINES = "SELECT l_orderkey AS k, l_linenumber AS n, 'dw.t' || l_partkey AS t, 'ods.s' || l_suppkey AS s FROM lineitem"
_GATED = f"""WITH l AS ({_LINES}), w AS (SELECT DISTINCT k, t FROM l WHERE n IN (1, 2, 4, 7)), r AS (SELECT DISTINCT k, s FROM l WHERE n IN (1, 2, 4, 5, 7) UNION SELECT DISTINCT k, 'ods.both' FROM l WHERE n = 5)
    SELECT k, coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM r WHERE r.k = o.k), '') AS reads, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM w WHERE w.k = o.k), '') AS writes FROM (SELECT DISTINCT k FROM l) o"""


def _scripts(t):
    code = F.element_at(F.array(*(F.format_string(c.replace("%", "%%").replace("{{{{", "{{").replace("}}}}", "}}").replace("{p}", "%1$s").replace("{s}", "%2$s"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")) for c in CODE)), F.col("l_linenumber"))
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", code.alias("code"))
    each = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "code")))
    return lines.groupBy("k").agg(each.alias("x")).select("k", F.array_join("x.code", "\n").alias("text"))


def _joined(df):
    return df.select("k", F.array_join("reads", ",").alias("reads"), F.array_join("writes", ",").alias("writes"))


@_r.query("lin_18_executed_sql", _GATED)
def executed(t):
    return _joined(sl.script_lineage(_scripts(t), "k"))


@_r.query("lin_01_statement_tables", "SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey, l_partkey, CASE WHEN l_linenumber IN (1, 2, 4, 5, 7) THEN 'ods.s' || l_suppkey || CASE l_linenumber WHEN 5 THEN ',ods.t2' ELSE '' END ELSE '' END AS reads, CASE WHEN l_linenumber IN (1, 4, 7) THEN 'dw.t' || l_partkey ELSE '' END AS writes FROM lineitem")
def statement_tables(t):
    """What one statement a line reads and writes: inserts, queries, expressions with names of their own, deletes; others aren't statements."""
    texts = ["INSERT INTO dw.t%1$s SELECT * FROM ods.s%2$s", "SELECT * FROM ods.s%2$s x", "DROP ME NOW", "WITH a AS (SELECT * FROM ods.s%2$s), b AS (SELECT * FROM a) INSERT INTO dw.t%1$s SELECT * FROM a JOIN b ON true", "SELECT * FROM ods.s%2$s, `ods`.`t2` AS y", "select from", "DELETE FROM dw.t%1$s WHERE k IN (SELECT k FROM ods.s%2$s)"]
    made = F.element_at(F.array(*(F.format_string(x, F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")) for x in texts)), F.col("l_linenumber"))
    found = t.read("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_suppkey", "l_partkey", sl.tables(F.array(made)).alias("x"))
    return found.select("k", "n", "l_suppkey", "l_partkey", F.array_join("x.reads", ",").alias("reads"), F.array_join("x.writes", ",").alias("writes"))


@_r.query("lin_18_scripts_with_sql", f"SELECT count(*) AS scripts, count(*) FILTER (WHERE reads <> '' OR writes <> '') AS with_sql, count(*) FILTER (WHERE writes <> '') AS that_write FROM ({_GATED})")
def with_sql(t):
    found = sl.script_lineage(_scripts(t), "k")
    reads, writes = F.size("reads") > 0, F.size("writes") > 0
    return found.agg(F.count("*").alias("scripts"), F.count_if(reads | writes).alias("with_sql"), F.count_if(writes).alias("that_write"))


_RUN = "SELECT 'r' || r_regionkey AS script, place, CASE WHEN r_regionkey % 2 = 0 OR place < 4 THEN 'OK' WHEN place = 4 THEN 'FAILED' ELSE 'NOT_RUN' END AS state FROM region, (SELECT unnest(range(1, 6)) AS place)"


@_r.query("src_09_statement_outcomes", _RUN)
def outcomes(t):
    """A script for each region over its nations: a setting, a view, a query with a semicolon in a literal, one that fails for every other region, and one after it."""
    nation = f"parquet.`{t.sf_dir}/nation.parquet`"
    text = F.concat(
        F.lit("SET spark.sql.shuffle.partitions=2; -- its own; session\n"), F.lit("CREATE TEMPORARY VIEW own AS SELECT * FROM "), F.lit(f"{nation} WHERE n_regionkey = "), F.col("r_regionkey").cast("string"),
        F.lit(";\nSELECT count(*), ';' AS x FROM own GROUP BY n_name;\n"), F.when(F.col("r_regionkey") % 2 == 1, "SELECT no_column FROM own").otherwise("SELECT n_name FROM own"), F.lit(";\nSELECT 1"))
    scripts = t.read("region").select(F.concat(F.lit("r"), "r_regionkey").alias("script"), text.alias("text"))
    return runner.run_all(t.spark, scripts).select("script", "place", "state")


@_r.query("src_11_copy_job", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS name, s_acctbal AS balance FROM supplier WHERE s_nationkey <> 3 OR s_suppkey % 3 = 0")
def copy_jobs(t):
    """A job that copies suppliers, one that fails half way, and one, run twice, that replaces some by their key."""
    from pyspark.errors import PySparkException

    target, rows = _folder(t.spark, "copy"), t.read("supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal balance", "s_nationkey nation").repartition(3)
    lines.copy_job(rows, target, ["id", "name", "balance"], "nation <> 3")
    try:
        lines.copy_job(rows.withColumn("name", F.when(F.col("id") % 50 == 7, F.raise_error(F.lit("lost"))).otherwise("half")), target, ["id", "name", "balance"])
    except PySparkException:
        pass  # it leaves nothing
    for _ in range(2):
        lines.copy_job(rows.where("id % 3 = 0").withColumn("name", F.lit("new")), target, ["id", "name", "balance"], mode="replace", keys=["id"])
    return lines.load(t.spark, target, rows.select("id", "name", "balance").schema)
