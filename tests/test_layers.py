"""Reading order of forests, the layered catalog, and the corpus from a stream."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from weftline.operators import tree
from weftline.sources.layered import Layered
from weftline.streaming.corpus import Collector


def plain(rows):
    """Depth first, by hand."""
    there = {r[0] for r in rows}
    below = {}
    for r in sorted(rows, key=lambda r: (r[2] or 0, r[3] is None, r[3] or "", r[0])):
        below.setdefault(r[1] if r[1] in there else None, []).append(r[0])
    out, todo = [], [(k, 0) for k in reversed(below.get(None, []))]
    while todo:
        k, depth = todo.pop()
        out.append((k, len(out), depth))
        todo += [(c, depth + 1) for c in reversed(below.get(k, []))]
    return sorted(out)


SCHEMA = "id long, parent long, sort int, name string"


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_preorder(spark, kind):
    r = random.Random(7)
    if kind == "chain":
        rows = [(k, k + 1 if k < 199 else None, None, None) for k in range(200)]
    elif kind == "star":
        rows = [(0, None, None, "top")] + [(k, 0, r.choice([None, 0, 1, -1]), r.choice([None, "a", "b"])) for k in range(1, 150)]
    else:
        rows = [(k, r.choice([None, r.randrange(k + 1), 9999]) if k else None, r.choice([None, 0, 2]), r.choice([None, "x", "y"])) for k in range(120)]
        rows = [x for x in rows if x[0] != x[1]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_n", F.lit("mine"))
    assert sorted((x.id, x.place, x.depth) for x in tree.preorder(df).collect()) == plain(rows)


def test_cycles_and_no_nodes(spark):
    rows = [(1, None, None, "a"), (2, 1, None, "b"), (3, 4, None, "c"), (4, 3, None, "d"), (5, 4, None, "e"), (6, 6, None, "f")]
    assert sorted((x.id, x.place, x.depth) for x in tree.preorder(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 0, 0), (2, 1, 1)]
    assert tree.preorder(spark.createDataFrame([], SCHEMA)).collect() == []


def test_leaves_take_one_step_and_ended_steps_are_spread(spark, monkeypatch):
    made = []
    monkeypatch.setattr(tree, "cut", lambda df, keep=tree.cut: made.append(keep(df)) or made[-1])
    rows = [(0, None, None, None)] + [(k, 0, None, None) for k in range(1, 2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted((x.id, x.place, x.depth) for x in tree.preorder(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)
        steps, last = made[1], made[-1].groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert steps.count() == 2001  # the root is entered and left
    assert max(r["count"] for r in made[-2].groupBy(F.spark_partition_id()).count().collect()) < 1000 and max(r["count"] for r in last) < 1000


def test_layers_ask_the_source_for_the_rest_alone(spark):
    asked = []
    known = spark.createDataFrame([("l1", ["a"]), ("l2", ["b"])], "name string, columns array<string>")

    def live(names):
        asked.append(sorted(r.name for r in names.collect()))
        return known

    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    catalog = Layered(spark, root, live)
    catalog.start(spark.createDataFrame([("c", ["x"])], "name string, columns array<string>").withColumn("at", F.expr("timestamp_ntz '2024-01-01 10:00:00'")), spark.createDataFrame([("g", ["y"]), ("c", ["older"])], "name string, columns array<string>"))
    names = spark.createDataFrame([("c",), (" l1",), ("g",), ("none",), (None,), (" ",), ("g",)], "name string")
    got = lambda now, turn: {r.name: (r.columns, r.layer) for r in catalog.resolve(names, now, turn).collect()}
    first = {"c": (["x"], "cache"), "l1": (["a"], "live"), "g": (["y"], "graph"), "none": (None, None)}
    assert got("2024-01-01 12:00:00", 0) == first and asked.pop() == ["l1", "none"]
    assert got("2024-01-01 12:00:00", 0) == first and asked.pop() == ["l1", "none"]  # the same turn again
    assert {k: v[1] for k, v in got("2024-01-01 12:01:00", 1).items()} == {"c": "cache", "l1": "cache", "g": "cache", "none": None} and asked.pop() == ["none"]
    assert got("2024-01-01 17:00:00", 2)["c"] == (["older"], "graph") and asked.pop() == ["none"]
    catalog.evict(spark.createDataFrame([("l1",)], "name string"), 3)
    assert got("2024-01-01 17:01:00", 4)["l1"] == (["a"], "graph")
    assert {r.name: r.layer for r in Layered(spark, root, None).resolve(names, "2024-01-03 00:00:00", 5).collect()} == {"c": "graph", "l1": "graph", "g": "graph", "none": None}


def test_corpus_in_any_order(spark):
    docs = [(5, "the  Same"), (3, "the same"), (9, "the same "), (4, "bread"), (1, "the rest"), (None, "the none"), (2, None), (7, "the rest")]
    for seed in range(2):
        order = random.Random(seed).sample(docs, len(docs))
        c = Collector(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), [F.col("text").contains("the")], lambda x: F.regexp_replace(F.lower(F.trim(x)), " +", " "))
        for batch, part in enumerate((order[:4], order[2:], order)):
            for _ in range(2):
                c.apply(spark.createDataFrame(part, "doc_id long, text string"), batch)
        assert sorted((r.content, r.doc_id) for r in c.corpus().collect()) == [("the rest", 1), ("the same", 3)]
