"""Forests in reading order: every node after its parent and its elder siblings with all that is below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.keyed import numbered
from weftline.sources.store import cut


def preorder(nodes: DataFrame, key: str = "id", parent: str = "parent", sort: str = "sort", name: str = "name") -> DataFrame:
    """(key, parent, place, depth): the place of each node from 0, and how many are above it.

    Siblings go by sort (null as 0), then name (nulls last), then key; a node whose parent isn't there is a root, roots are siblings. Nodes on or below a cycle of
    parents have no place and are left out. A walk around the forest enters and leaves every node once; where each step of it leads is one join, and by jumping
    twice as far each round a step learns in a logarithm of rounds, however deep the forest is, how many nodes are still entered after it. Siblings are neighbours in
    one order over range parts, so a parent may have any number of children.
    """
    rows = nodes.select(F.col(key).alias("_id"), F.col(parent).alias("_asked"), F.coalesce(sort, F.lit(0)).alias("_sort"), F.col(name).alias("_name")).dropDuplicates(["_id"])
    there = rows.select(F.col("_id").alias("_asked"), F.lit(True).alias("_there"))
    rows = rows.join(there, "_asked", "left").withColumn("_parent", F.when(F.col("_there"), F.col("_asked"))).drop("_asked", "_there")
    rows = rows.withColumns({"_root": F.col("_parent").isNotNull(), "_nameless": F.col("_name").isNull()})
    rows = cut(numbered(rows, "_n", "_root", "_parent", "_sort", "_nameless", "_name", "_id").select("_id", "_parent", "_n"))
    after = rows.select((F.col("_n") - 1).alias("_n"), F.col("_n").alias("_sib"), F.col("_parent").alias("_sib_parent"))
    child = rows.where("_parent is not null").groupBy(F.col("_parent").alias("_id")).agg(F.min("_n").alias("_child"))
    above = rows.select(F.col("_id").alias("_parent"), F.col("_n").alias("_up"))
    linked = rows.join(after, "_n", "left").join(child, "_id", "left").join(above, "_parent", "left")
    sibling = F.when(F.col("_sib_parent").eqNullSafe(F.col("_parent")), F.col("_sib"))  # step 2n enters node n, step 2n + 1 leaves it
    back = F.coalesce(2 * sibling, 2 * F.col("_up") + 1)
    inner = F.col("_child").isNotNull()  # a node without children is entered and left in one step
    enter = linked.select((2 * F.col("_n")).alias("step"), F.when(inner, 2 * F.col("_child")).otherwise(back).alias("to"), F.lit(1).cast("long").alias("entered"), F.when(inner, 1).otherwise(0).cast("long").alias("deeper"))
    leave = linked.where(inner).select((2 * F.col("_n") + 1).alias("step"), back.alias("to"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("deeper"))
    state, rounds = cut(enter.union(leave)), max(1, 2 * rows.count()).bit_length()
    for _ in range(rounds):
        if state.where("to is not null").isEmpty():
            break
        far = state.select(F.col("step").alias("_at"), F.col("to").alias("_to"), F.col("entered").alias("_e"), F.col("deeper").alias("_d"))
        at = state.withColumn("_at", F.coalesce("to", -1 - F.col("step")))  # steps that lead to the end find nothing, but are spread over tasks as others are
        state = cut(at.join(far, "_at", "left").select("step", F.col("_to").alias("to"), (F.col("entered") + F.coalesce("_e", F.lit(0))).alias("entered"), (F.col("deeper") + F.coalesce("_d", F.lit(0))).alias("deeper")))
    ended = state.where("to is null and step % 2 = 0").select((F.col("step") / 2).cast("long").alias("_n"), "entered", "deeper")
    whole = ended.agg(F.max("entered").alias("_all"))
    found = rows.join(ended, "_n").join(F.broadcast(whole))  # one row
    return found.select(F.col("_id").alias(key), F.col("_parent").alias(parent), (F.col("_all") - F.col("entered")).alias("place"), (-F.col("deeper")).alias("depth"))
