"""Copy jobs and statement scripts."""

import tempfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.operators import runner
from weftline.sources import lines

SCHEMA = "id long, name string, at timestamp_ntz, day date, price decimal(10,2), tags array<string>"
ROWS = [(1, "a\n\"é\"", datetime(2024, 1, 1, 2, 3, 4, 5), date(2024, 1, 1), Decimal("1.10"), ["x", "y"]), (2, None, None, None, None, None), (3, "c", None, None, None, [])]


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_rows_come_back_as_they_were(spark):
    path = folder()
    assert lines.load(spark, path, SCHEMA).collect() == []
    lines.copy_job(spark.createDataFrame(ROWS, SCHEMA).repartition(2), f"file:{path}")
    assert sorted(map(tuple, lines.load(spark, path, SCHEMA).collect())) == ROWS
    lines.copy_job(spark.createDataFrame(ROWS[:1], SCHEMA), path, mode="overwrite")
    assert [r.id for r in lines.load(spark, path, SCHEMA).collect()] == [1]


def test_a_failed_job_leaves_nothing_and_a_rerun_no_double(spark):
    path, rows = folder(), spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name")).repartition(4)
    lines.copy_job(rows, path)
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException):
            lines.copy_job(rows.withColumn("name", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("x")), path, mode=mode)
    assert lines.load(spark, path, "id long, name string").where("name = concat('n', id)").count() == 100
    for _ in range(3):
        lines.copy_job(rows.where("id >= 90").withColumn("name", F.lit("new")).union(spark.createDataFrame([(200, "new")], "id long, name string")), path, mode="replace", keys=["id"])
    got = lines.load(spark, path, "id long, name string")
    assert got.count() == 101 and got.where("name = 'new'").count() == 11


def test_statements_run_until_one_fails(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    script = "SET spark.sql.shuffle.partitions=7; select ';' as a; -- x; y\n\n;select * from nowhere.t; select 1"
    out, last = runner.run(spark, script, {"spark.sql.caseSensitive": "true"})
    assert [(p, s) for p, _, s, _ in out] == [(1, "OK"), (2, "OK"), (3, "FAILED"), (4, "NOT_RUN")] and "TABLE_OR_VIEW_NOT_FOUND" in out[2][3]
    assert runner.exit_code(out) == 3 and last.collect()[0][0] == ";" and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert runner.run(spark, " ; ; ")[0] == [] and runner.exit_code([]) == 0
    scripts = spark.createDataFrame([("b", "select 1"), ("a", "select x"), ("c", None)], "script string, text string")
    assert [(r.script, r.state) for r in runner.run_all(spark, scripts).collect()] == [("a", "FAILED"), ("b", "OK")]


def test_placement_as_greedy_choice(spark):
    import random

    from weftline.operators import readiness

    r = random.Random(5)
    waiting = [(k, r.randrange(4), r.randrange(3)) for k in range(60)]
    nodes = [(f"n{k}", r.randrange(-1, 9), k % 2) for k in range(6)]
    free, want = {n: (f, p) for n, f, p in nodes}, []
    for k, _, pool in sorted(waiting, key=lambda w: (w[1], w[0])):
        fit = sorted((-f, n) for n, (f, p) in free.items() if p == pool and f > 0)
        if fit:
            want.append((k, fit[0][1]))
            free[fit[0][1]] = (-fit[0][0] - 1, pool)
    got = readiness.placed(spark.createDataFrame(waiting, "id long, priority int, pool int"), spark.createDataFrame(nodes, "node string, free long, pool int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
