"""Walks within keys, layers by one peeling, levels of tasks over what is read and written alone."""

import pytest

from weftline.operators import graph


@pytest.fixture
def cuts(monkeypatch):
    made = []
    monkeypatch.setattr(graph, "cut", lambda df, keep=graph.cut: made.append(keep(df)) or made[-1])
    return made


def test_reach_stays_within_its_key(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "b", "d"), (2, "a", "a")], "run int, src string, dst string")
    seeds = spark.createDataFrame([(1, "a"), (2, "a")], "run int, id string")
    assert sorted(tuple(r) for r in graph.reach(edges, seeds, 5, key=["run"], inside=True).collect()) == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "a", 0)]


def test_layers_are_peeled_once(spark, cuts):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(0, 9), (0, 9)], "src int, dst int")
    nodes = spark.createDataFrame([(k,) for k in range(11)], "id int")
    assert {r.id: r.layer for r in graph.layers(edges, nodes).collect()} == {k: k % 10 for k in range(11)}
    assert len(cuts) == 11  # nodes, edges and nine rounds


def test_layers_with_ends_outside_and_bounded_rounds(spark):
    of = lambda edges, nodes, *a: {r.id: r.layer for r in graph.layers(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "id string"), *a).collect()}
    assert of([("x", "y"), ("y", "b"), ("a", "z"), ("z", "b")], ["a", "b"]) == {"a": 0, "z": 1, "b": 2}  # x isn't there, so y isn't led to
    assert of([("a", "b"), ("b", "a"), ("b", "c")], ["a", "b", "c"], 3) == {"a": 3, "b": 3, "c": 3}
    with pytest.raises(ValueError):
        of([("x", "y"), ("y", "x")], ["a"])
    assert of([], ["a"]) == {"a": 0}


def test_levels_take_only_what_is_written_and_read(spark, monkeypatch):
    seen = []
    reach = graph.reach
    monkeypatch.setattr(graph, "reach", lambda edges, seeds, *a, **k: seen.append((edges.count(), seeds.count())) or reach(edges, seeds, *a, **k))
    rows = [("in", "m", 1), ("m", "m2", 2), ("m2", "out", 3)] + [("m", f"leaf{k}", 2) for k in range(50)] + [(f"root{k}", "m", 4) for k in range(50)]
    got = graph.task_levels(spark.createDataFrame(rows, "src string, dst string, task_id int"), 5)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (4, 2, 1), (4, 3, 2)}
    assert seen == [(1, 3)]  # m to m2; m from two tasks, m2 from one
