"""SQL lineage, templates, connectors: golden cases."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import templates as t
from weftline.operators import sqllineage as sl
from weftline.sources import connectors


def test_guard_and_split():
    assert sl.rejected("select 1;") is None and sl.rejected("with x as (select 1) select * from x") is None
    assert sl.rejected(" ") == "blank" and sl.rejected("select 1; select 2") == "several statements" and sl.rejected("drop table x") == "not a query" and sl.rejected("select 1 from x where drop") == "holds drop"
    assert sl.statements("select ';' -- a;b\n; /* ; */ select `x;y`;;") == ["select ';'", "select `x;y`"]


def test_tables_of_statements(spark):
    got = sl.tables(spark, "INSERT INTO dwd.o SELECT * FROM ods.a x JOIN ods.b y ON x.i = y.i UNION ALL SELECT * FROM (SELECT * FROM ods.c) q")
    assert got["parsed"] and got["writes"] == ["dwd.o"] and set(got["reads"]) == {"ods.a", "ods.b", "ods.c"}
    assert sl.tables(spark, "WITH x AS (SELECT * FROM a) SELECT * FROM x JOIN b")["reads"] == ["a", "b"] or set(sl.tables(spark, "WITH x AS (SELECT * FROM a) SELECT * FROM x JOIN b")["reads"]) == {"a", "b"}
    assert not sl.tables(spark, "SELEC nonsense FROM")["parsed"]


def test_columns_of_queries(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, 3)], "uid long, amount double, oid long").write.parquet(str(tmp_path / "o"))
    spark.createDataFrame([(1, "n")], "id long, name string").write.parquet(str(tmp_path / "u"))
    spark.read.parquet(str(tmp_path / "o")).createOrReplaceTempView("o")
    spark.read.parquet(str(tmp_path / "u")).createOrReplaceTempView("u")
    sql = "WITH x AS (SELECT uid, sum(amount) AS total FROM o GROUP BY uid) SELECT u.name, x.total AS t, x.total + u.id AS e, 'c' AS k FROM x JOIN u ON u.id = x.uid"
    got = {c["target"]: ([s.split(".")[-1] for s in c["sources"]], c["transform"]) for c in sl.columns(spark, sql)}
    assert got["name"] == (["name"], "DIRECT") and got["t"] == (["amount"], "AGGREGATE") and sorted(got["e"][0]) == ["amount", "id"] and got["e"][1] == "EXPRESSION" and "k" not in got
    assert sl.try_columns(spark, "select nothing from nowhere") == ([], True)


def test_cross_check_and_script_calls(spark):
    parsed = spark.createDataFrame([("d", "a", "UNVERIFIED"), ("d", "b", "UNVERIFIED"), ("e", "c", "UNVERIFIED")], "dst string, src string, confidence string")
    declared = spark.createDataFrame([("d", "a"), ("f", "g")], "dst string, src string")
    assert {tuple(r) for r in sl.cross_checked(parsed, declared).collect()} == {("d", "a", "CONFIRMED"), ("d", "b", "CONFLICT"), ("e", "c", "UNVERIFIED"), ("f", "g", "DECLARED")}
    reads, writes = sl.script_tables(F.lit("df = spark.table('A.b')\ndf.write.saveAsTable(\"c.D\")"))
    row = spark.range(1).select(reads.alias("r"), writes.alias("w"), sl.embedded_sql(F.lit('x("select * from t where d = {d} and k = %s")')).alias("q"), sl.declared_columns(F.lit("db.t.c")).alias("c")).first()
    assert (row.r, row.w, row.q, tuple(row.c)) == (["a.b"], ["c.d"], ["select * from t where d = __dyn__ and k = NULL"], ("db.t", "c"))


def test_embedded_statements(spark):
    texts = {
        1: "# don't\nsql('select 1 from t')", 2: r'x("select \"a\" from b")', 3: "a = 1\n\nb = '''\nwith x as (select 1)\nselect * from {t}\n'''\nc = 'select 2'", 4: None, 5: "",
        6: "cat <<-'EO'\nselect 1\n", 7: "x = 'select " + "a, " * 20000 + "b from c'", 8: "spark.sql(q)\nspark.sql('delete from t')", 9: "'unclosed\n'select 3'", 10: "cat <<X\nselect 'a\nX\n'select 4'",
    }
    got = sl.embedded_statements(spark.createDataFrame(list(texts.items()), "script int, text string")).collect()
    rows = sorted((r.script, r.line, "" if r.sql is None else r.sql if r.script != 7 else len(r.sql), r.hint) for r in got)
    assert rows == [
        (1, 2, "select 1 from t", None), (2, 1, r'select \"a\" from b', None), (3, 3, "with x as (select 1)\nselect * from __dyn__", "DYNAMIC_TABLE"), (3, 7, "select 2", None),
        (7, 1, 60015, None), (8, 1, "", "DYNAMIC_SQL"), (8, 2, "delete from t", None), (9, 2, "select 3", None), (10, 1, "select 'a", None), (10, 4, "select 4", None),
    ]


def test_templates():
    r = lambda x, p=None: t.resolve(x, "2024-03-31", "2024-03-31", p)
    assert r("a={{yyyy-mm-dd}} b={{yyyymmdd-1}} c={{yyyy-mm-1}} d={{ yyyymmdd + 1*7 }} e={{bizmonth}}") == "a=2024-03-31 b=20240330 c=2024-02 d=20240407 e=202402"
    assert r("{{x}}", {"x": "p{{y}}", "y": "{{bizdate}}"}) == "p20240331"
    for bad, params in (("{{}}", None), ("{{x", None), ("{{what?}}", None), ("{{x}}", {"x": "{{y}}", "y": "{{x}}"}), ("{{a{{b}}}}", None)):
        with pytest.raises(t.TemplateError):
            r(bad, params)
    assert t.resolve_lenient("${yyyy} ${ no }", "20240331", "20240331") == "2024 ${no}"
    assert t.shift(t.parse_date("2024-03-31"), "yyyymm", -1).isoformat() == "2024-02-29"


def test_connectors(spark, tmp_path):
    assert connectors.options("mysql", "h", "d") == {"format": "jdbc", "url": "jdbc:mysql://h:3306/d", "driver": "com.mysql.cj.jdbc.Driver"}
    assert len(connectors.CONNECTORS) == 18 and connectors.existence(spark, "no_such_table") == "ABSENT"
    connectors.copy(spark, spark.range(3), "t", kind="s3", url=str(tmp_path))
    assert connectors.read(spark, "t", kind="s3", url=str(tmp_path)).count() == 3
    assert connectors.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"
