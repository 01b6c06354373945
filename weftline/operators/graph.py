"""Bounded traversal of lineage graphs: a join for each hop, at most as many as the depth allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.store import cut, dealt

MOST_DEPTH, MOST_NODES, MOST_PATHS = 20, 2000, 200


def reach(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src", dst: str = "dst", key: list[str] | None = None, inside: bool = False) -> DataFrame:
    """(key..., id, hop) of what edges lead to from the seeds (key..., id) within ``depth`` hops, the seeds at hop 0; the least hop of each.

    ``inside``: edges have the key too, and lead on within it. A hop joins what the last one found with the edges and leaves out what was seen; each is
    checkpointed, and an empty one ends the walk. Edges are read once a hop, so those that take work to make should be cut before.
    """
    key = key or []
    on = [*key, "id"] if inside else ["id"]
    step = edges.select(*on[:-1], F.col(src).alias("id"), F.col(dst).alias("_to"))  # an edge may come twice: what a hop finds is made distinct, not the whole table
    seen = front = cut(seeds.select(*key, "id").distinct().withColumn("hop", F.lit(0)))
    for h in range(1, min(depth, MOST_DEPTH) + 1):
        found = front.join(step, on).select(*key, F.col("_to").alias("id")).distinct()
        front = cut(found.join(seen, [*key, "id"], "left_anti").withColumn("hop", F.lit(h)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def downstream(edges: DataFrame, nodes: DataFrame, anchor: str, depth: int) -> DataFrame:
    """Nodes that the anchor leads to, without itself."""
    seeds = nodes.where(F.col("id") == anchor).select("id")
    return reach(edges, seeds, depth).where("hop > 0").join(nodes, "id", "left_semi")


def upstream(edges: DataFrame, nodes: DataFrame, anchor: str, depth: int) -> DataFrame:
    return downstream(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes, anchor, depth)


def neighbourhood(edges: DataFrame, nodes: DataFrame, anchor: str, depth: int) -> DataFrame:
    """Nodes within ``depth`` hops in either direction, the anchor at hop 0."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return reach(both, nodes.where(F.col("id") == anchor).select("id"), depth)


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def impact_page(edges: DataFrame, nodes: DataFrame, anchor: str, depth: int, offset: int, limit: int) -> DataFrame:
    """A page of what lies downstream, by hop and id."""
    return downstream(edges, nodes, anchor, depth).orderBy("hop", "id").offset(offset).limit(limit)


def paths(edges: DataFrame, start: str, end: str, depth: int, most: int = MOST_PATHS, keep: int | None = None) -> DataFrame:
    """(path, hops): directed paths of 1 to ``depth`` hops that use no edge twice, shortest first and then in order of their nodes, at most ``most``.

    From the end backwards a node learns from how many hops it can be reached, so a walk only takes edges from which the end is still as far as its length
    asks for: what begins can end. For each length the first ``keep`` walks go on at each hop. They are all that counts unless so many of them use an edge
    twice that fewer than asked for are left of a length that was cut; then more are kept. Each hop is a checkpointed join of at most depth * keep walks with the edges.
    """
    depth = min(depth, MOST_DEPTH)
    step = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    spark, here = edges.sparkSession, [cut(edges.sparkSession.createDataFrame([(end,)], "id string"))]
    for _ in range(depth):
        here.append(cut(step.join(here[-1].withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()))
    lengths = [n for n in range(1, depth + 1) if not here[n].where(F.col("id") == start).isEmpty()]
    ends = reduce(DataFrame.unionByName, (x.withColumn("left", F.lit(n)) for n, x in enumerate(here)))
    keep = keep or 2 * most
    while True:
        front = spark.createDataFrame([(n, [start], start) for n in lengths], "length int, path array<string>, at string").withColumn("used", F.array().cast("array<struct<src:string,dst:string>>"))
        found, got, short = [], 0, False
        cut_at: set[int] = set()
        for h in range(1, (lengths[-1] if lengths else 0) + 1):
            edge = F.struct(F.col("at").alias("src"), "dst")
            on = front.join(step, F.col("at") == F.col("src")).where(~F.array_contains("used", edge)).withColumn("left", F.col("length") - h)
            on = on.join(ends.withColumnRenamed("id", "dst"), ["dst", "left"], "left_semi")
            on = on.select("length", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"), F.array_append("used", edge).alias("used"))
            first = F.row_number().over(Window.partitionBy("length").orderBy("path"))
            on = cut(on.withColumn("_k", first).where(F.col("_k") <= keep + 1))
            cut_at |= {r.length for r in on.where(F.col("_k") > keep).select("length").distinct().collect()}  # at most one a length
            front = on.where(F.col("_k") <= keep).drop("_k")
            if h in lengths:
                whole = front.where(F.col("length") == h).select("path", F.lit(h).alias("hops"))
                found.append(whole)
                got += min(whole.count(), most)
                short |= got < most and h in cut_at
                if got >= most or short:
                    break
                front = front.where(F.col("length") > h)
        if not short:
            none = spark.createDataFrame([], "path array<string>, hops int")
            return reduce(DataFrame.unionByName, found, none).orderBy("hops", "path").limit(most)
        keep *= 4


def task_levels(edges: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(task_id, other, level): tasks that read, directly or over flows, what a task writes; level 1 reads it itself.

    ``edges`` (src, dst, task_id): a task reads src and writes dst. The task itself is left out; the least level of each.
    """
    src, dst = edges.select(F.col("src").alias("id")).distinct(), edges.select(F.col("dst").alias("id")).distinct()
    mid = cut(src.join(dst, "id", "left_semi"))  # all that is written and read: nothing else has a reader or leads to one
    of = lambda df, *sides: reduce(lambda d, c: d.join(mid.withColumnRenamed("id", c), c, "left_semi"), sides, df)
    writes = of(edges.select("task_id", "dst"), "dst").select("task_id", F.col("dst").alias("id")).distinct()
    reads = of(edges.select("task_id", "src"), "src").select(F.col("task_id").alias("other"), F.col("src").alias("id")).distinct()
    near = reach(cut(of(edges.select("src", "dst"), "src", "dst").distinct()), writes, depth, key=["task_id"])
    return near.join(reads, "id").where("other <> task_id").groupBy("task_id", "other").agg((F.min("hop") + 1).alias("level"))


def peeled(edges: DataFrame, rounds: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Edges (key..., src, dst) left after nodes without incoming edges have been taken away, with theirs, again and again until nothing changes.

    Edges are left if and only if there is a cycle: those of cycles and of what cycles lead to. ``rounds`` takes away no oftener than that; what is
    left then need not be a cycle.
    """
    key = key or []
    left = cut(edges.select(*key, "src", "dst").distinct())
    n, done = left.count(), 0
    while n and (rounds is None or done < rounds):
        left = cut(left.join(left.select(*key, F.col("dst").alias("src")).distinct(), [*key, "src"], "left_semi"))
        before, n, done = n, left.count(), done + 1
        if n == before:
            break
    return left


def _doubled(state: DataFrame, value: str, joined: Column, done: Column) -> DataFrame:
    """``state`` (id, to, value) after as many doublings of ``to`` as it takes until ``done``, an aggregate, is true; each takes in the value that ``to`` has."""
    while not state.agg(done).first()[0]:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col(value).alias("_value"))
        state = cut(state.join(ahead, "to").select("id", F.col("_to").alias("to"), joined.alias(value), (F.col(value) != joined).alias("changed")))
    return state


def closed_path(edges: DataFrame) -> DataFrame:
    """(place, id) of one cycle of edges (src, dst), from its least node at 0 to the same node again; no rows if and only if there is no cycle.

    Peeled from both ends, every node left has a successor; with the least of each, peeling again leaves cycles alone. The one with the least node is ranked
    by doubling, so the joins grow with the logarithm of its length.
    """
    swap = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    inner = swap(peeled(swap(peeled(edges))))
    ring = peeled(inner.groupBy("src").agg(F.min("dst").alias("dst"))).select(F.col("src").alias("id"), F.col("dst").alias("to"))
    low = _doubled(ring.select("id", "to", F.least("id", "to").alias("low"), F.lit(True).alias("changed")), "low", F.least("low", "_value"), ~F.coalesce(F.max("changed"), F.lit(False)))
    first = low.agg(F.min("low").alias("first"))
    one = cut(ring.join(low.join(F.broadcast(first), F.col("low") == F.col("first")).select("id", "first"), "id"))
    at = F.col("id") == F.col("first")
    start = one.select("id", F.when(at, F.col("id")).otherwise(F.col("to")).alias("to"), F.when(at, 0).otherwise(1).alias("left"))
    left = _doubled(start, "left", F.col("left") + F.col("_value"), F.count_distinct("to") <= 1)
    n = left.agg(F.count("*").alias("n"))
    placed = left.join(n).select(F.when(F.col("left") == 0, 0).otherwise(F.col("n") - F.col("left")).alias("place"), "id")
    return placed.unionByName(left.where("left = 0").join(n).select(F.col("n").alias("place"), "id"))


def _led(edges: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Edges that known nodes (key..., id) lead to."""
    while True:
        inside = edges.join(known.withColumnRenamed("id", "src"), [*key, "src"], "left_semi")
        more = cut(inside.select(*key, F.col("dst").alias("id")).distinct().join(known, [*key, "id"], "left_anti"))
        if more.where("id is not null").isEmpty():
            return cut(inside)
        known = cut(known.unionByName(more))


def layers(edges: DataFrame, nodes: DataFrame, rounds: int | None = None, key: list[str] | None = None) -> DataFrame:
    """(key..., id, layer, x) of a graph without cycles: the longest path that leads to each node, and where that stands in a layout.

    One peeling gives both: an edge is left after as many rounds as the longest path to its start has edges, so that a node is as deep as the last round in which
    an edge still leads to it. A graph with a cycle, of which edges never go, is a ValueError. ``rounds`` bounds the paths instead.
    """
    key = key or []
    known = cut(nodes.select(*key, "id").distinct())
    at = known.select(*key, F.col("id").alias("src"), F.lit(True).alias("_known"))
    left = cut(edges.select(*key, "src", "dst").distinct().join(at, [*key, "src"], "left"))
    if not left.where("_known is null").isEmpty():  # edges that begin outside count only if nodes lead there
        if rounds is None and not peeled(left, key=key).isEmpty():
            raise ValueError("the graph has a cycle")
        left = _led(left, known, key)
    left = left.drop("_known")
    deep, n, rows, done = [known.withColumn("layer", F.lit(0))], left.count(), 0, 0
    while n and (rounds is None or done < rounds):
        rows, done = rows + n, done + 1
        deep.append(left.select(*key, F.col("dst").alias("id"), F.lit(done).alias("layer")))
        left = cut(left.join(left.select(*key, F.col("dst").alias("src")), [*key, "src"], "left_semi"))
        before, n = n, left.count()
        if n == before:
            if rounds is None:
                raise ValueError("the graph has a cycle")
            deep.append(left.select(*key, F.col("dst").alias("id"), F.lit(rounds).alias("layer")))
            break
    level = dealt(reduce(DataFrame.unionByName, deep), 2 * rows, *key, "id").groupBy(*key, "id").agg(F.max("layer").alias("layer"))
    return level.withColumn("x", 50 + 220 * F.col("layer"))


def merged_dependencies(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """(src, dst, origin, hop) of declared and derived dependencies."""
    a, b = declared.withColumnRenamed("hop", "_a"), derived.withColumnRenamed("hop", "_b")
    origin = F.when(F.col("_b").isNull(), "DECLARED").when(F.col("_a").isNull(), "DERIVED").otherwise("BOTH")
    return a.join(b, ["src", "dst"], "full").select("src", "dst", origin.alias("origin"), F.least("_a", "_b").alias("hop"))


def corrected(edges: DataFrame, corrections: DataFrame) -> DataFrame:
    """Edges without those that were REMOVED; CONFIRMED ones are marked. corrections: src, dst, action."""
    rows = edges.join(corrections, ["src", "dst"], "left").where("action is null or action <> 'REMOVED'")
    return rows.withColumn("confirmed", F.coalesce(F.col("action") == "CONFIRMED", F.lit(False))).drop("action")


def weaker(a: Column, b: Column, order: tuple[str, ...] = ("CONFIRMED", "DECLARED", "UNVERIFIED", "CONFLICT")) -> Column:
    """The weaker of two confidences; of equal ones the first."""
    rank = lambda c: F.coalesce(*(F.when(c == x, i) for i, x in enumerate(order)), F.lit(len(order)))
    return F.when(rank(b) > rank(a), b).otherwise(a)
