"""Paths between two nodes against plain enumeration."""

import random

import pytest

from weftline.operators import graph


def plain(edges, start, end, depth, most):
    out, todo = [], [((start,), frozenset())]
    for hops in range(1, depth + 1):
        todo = [(p + (b,), used | {(a, b)}) for p, used in todo for a, b in edges if a == p[-1] and (a, b) not in used]
        out += sorted((hops, list(p)) for p, _ in todo if p[-1] == end)
    return out[:most]


@pytest.mark.parametrize("seed, depth, most, keep", [(1, 5, 200, None), (2, 4, 7, 1), (3, 6, 10, 2), (4, 3, 200, None)])
def test_as_enumeration(spark, seed, depth, most, keep):
    r = random.Random(seed)
    edges = sorted({(f"n{r.randrange(7)}", f"n{r.randrange(7)}") for _ in range(14)})  # loops and cycles too
    df = spark.createDataFrame([*edges, edges[0], (None, "n1"), ("n1", None)], "src string, dst string")
    for start, end in (("n0", "n3"), ("n2", "n2")):
        got = [(x.hops, x.path) for x in graph.paths(df, start, end, depth, most, keep).collect()]
        assert got == plain(edges, start, end, depth, most)


def test_no_path(spark):
    df = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert graph.paths(df, "b", "a", 5).collect() == [] and graph.paths(df.limit(0), "a", "b", 3).collect() == []


def test_dense_graph_stays_within_bounds(spark):
    """A million edges, 10 ** 12 paths of 4 hops and more: what is kept at a hop is bounded."""
    edges = spark.range(1000).selectExpr("cast(id as string) src").crossJoin(spark.range(1000).selectExpr("cast(id as string) dst"))
    got = graph.paths(edges, "1", "2", 4, most=1500).collect()
    assert len(got) == 1500 and got[0].path == ["1", "2"] and [x.hops for x in got[:3]] == [1, 2, 2]
    assert sum(x.hops == 2 for x in got) == 1000 and all(x.hops == 3 for x in got[1001:])
