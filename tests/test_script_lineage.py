"""Tables of SQL that scripts execute, worked out by hand."""

from pyspark.sql import functions as F

from weftline.operators import scriptlineage as sl

CASES = [
    ('spark.sql("INSERT INTO dw.a SELECT * FROM ods.b x JOIN ods.c AS y ON x.k = y.k")', ["ods.b", "ods.c"], ["dw.a"]),
    ('df = spark.sql("""\nWITH t AS (SELECT * FROM ods.b), u AS (SELECT * FROM t)\nSELECT * FROM u, ods.d WHERE 1 = 1\n""")', ["ods.b", "ods.d"], []),
    ('# spark.sql("INSERT INTO no.a SELECT * FROM no.b")\ncur.execute(\'DELETE FROM dw.x WHERE k IN (SELECT k FROM ods.y)\')', ["ods.y"], ["dw.x"]),
    ('"""Doc: insert into no.a select * from no.b"""\nprint("select * from no.c")', [], []),
    ('sql = "INSERT INTO dw.a " \\\n  "SELECT * " + f"FROM ods.b"\nrun_it(sql)', ["ods.b"], ["dw.a"]),
    ('work = "MERGE INTO dw.m USING ods.s ON a = b WHEN MATCHED THEN UPDATE SET x = 1"\nother = "SELECT * FROM no.z"\nspark.sql(work)', ["ods.s"], ["dw.m"]),
    ('work = "SELECT * FROM old.one"\nwork = "SELECT * FROM new.one"\ncur.execute(work, 3)', ["new.one"], []),
    ('work = "SELECT * FROM ods.q"\nprint(work)', [], []),
    ('spark.sql("CREATE OR REPLACE TEMP VIEW v AS SELECT * FROM ods.b"); spark.sql("INSERT INTO dw.a SELECT * FROM ods.v2")', ["ods.b", "ods.v2"], ["dw.a"]),
    ('spark.sql("INSERT INTO {{ target }} SELECT * FROM ods.b")', [], []),
    ('hive -e "INSERT OVERWRITE TABLE dw.h SELECT extract(year FROM ts) FROM ods.e -- from no.c\n"', ["ods.e"], ["dw.h"]),
    ("psql <<EOF\nCREATE TABLE IF NOT EXISTS dw.n AS SELECT * FROM ods.b;\nUPDATE dw.u SET a = 'from no.x' WHERE 1 = 1;\nEOF\n", ["ods.b"], ["dw.n", "dw.u"]),
    ('spark.sql("SELECT * FROM information_schema.tables JOIN `ods`.`B` ON true")', ["ods.b"], []),
    ('spark.sql("SELECT * FROM generate_series(1, 3) g, ods.k")', [], []),
    ('spark.sql("INSERT INTO a.t SELECT * FROM a.t UNION ALL SELECT * FROM b.t")', ["b.t"], ["a.t"]),
    ("x = 'it\\'s' # a comment with 'quotes\nspark.sql('SELECT 1 FROM ods.last')", ["ods.last"], []),
    ("spark.sql('SELECT * FROM ods.big WHERE x = ' + '" + "1" * 3000 + "')", [], []),
    ('hive -e "\nINSERT OVERWRITE TABLE dw.h\nSELECT * FROM ods.e"\nimpala-shell -f \'x\'', ["ods.e"], ["dw.h"]),
    ("mysql -e 'UPDATE dw.m SET a = 1;\nSELECT * FROM ods.l'", ["ods.l"], ["dw.m"]),
    ("", [], []),
    (None, [], []),
    ("unclosed = 'select * from no.a", [], []),
]


def test_executed_sql(spark):
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, text string")
    got = {r.k: (r.reads, r.writes) for r in sl.script_lineage(rows, "k").collect()}
    assert {k: (CASES[k][0], v) for k, v in got.items()} == {k: (c[0], (c[1], c[2])) for k, c in enumerate(CASES)}


def test_fragments_end_at_800_characters(spark):
    far = 'note: insert into a.t select x from b.t where y = 1 and "' + "z" * 900 + '"'
    cut = "select " + "c, " * 100 + " c from near.t where x in (1" + ", 1" * 300 + ") union select 1 from far.t"
    rows = spark.createDataFrame([(0, far), (1, cut), (2, "psql <<X\nselect 1 from here.t\nX\n"), (3, 'q("select * from one.t") and then from no.t'), (4, "nothing of the kind")], "k int, text string")
    got = {r.k: (r.reads, r.writes) for r in sl.script_lineage(rows, "k", gated=False).collect()}
    assert got == {0: (["b.t"], ["a.t"]), 1: (["far.t", "near.t"], []), 2: (["here.t"], []), 3: (["one.t"], []), 4: ([], [])}


def test_a_script_of_many_parts(spark):
    text = "\n".join(f'spark.sql("INSERT INTO dw.t{k} SELECT * FROM ods.s{k}")  # step {k}' for k in range(400))
    r = sl.script_lineage(spark.createDataFrame([(1, text)], "k int, text string"), "k").first()
    assert len(r.reads) == len(r.writes) == 400


def test_a_script_is_walked_through_once_however_many_columns_ask(spark):
    found = sl.script_lineage(spark.createDataFrame([(1, "spark.sql('insert into a select * from b')")], "k long, text string"), "k")
    asked = found.agg(F.count_if((F.size("reads") > 0) | (F.size("writes") > 0)).alias("n"), F.count_if(F.size("writes") > 0).alias("w"))
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("<<[-~]") == 1
    assert tuple(asked.first()) == (1, 1)
