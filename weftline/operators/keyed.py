"""Keyed operations on tables: differences, updates, replacement, first and top rows, cumulative shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.store import cut, dealt


def without(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def read_write_pairs(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(task_id, reads, writes): what each task reads with what it writes, but nothing with itself."""
    return reads.distinct().join(writes.distinct(), "task_id").where("reads <> writes").select("reads", "writes", "task_id").distinct()


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows that were added, removed or modified between two versions of a table, with their new values."""
    values = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*values).alias("_old"))
    b = new.select(F.col(key).alias("_key"), F.struct(*values).alias("_new"))
    both = a.join(b, a[key] == b["_key"], "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("modified")
    return both.select(F.coalesce(key, "_key").alias(key), change.alias("change"), "_new.*")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of columns, which no single task sorts.

    Ranges of the order are parts, kept as they fell; a row's place is that within its part and the rows of all parts before. One value's rows lie in one part.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, place).join(before, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def zipped(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Rows of equal place in the order of one column."""
    return numbered(a, "_n", order).join(numbered(b, "_n", order).drop(order), "_n").drop("_n")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns[:-1]), columns[-1])


def content_hash(entry: Column) -> Column:
    """SHA-256 of all entries of a group in order, as an aggregate."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "|"), 256)


def search(nodes: DataFrame, word: str, kinds: tuple[str, ...], limit: int) -> DataFrame:
    """Nodes of several kinds whose names hold a word in any case: a page of each kind, merged by name and cut again; none for a blank word."""
    if not word.strip():
        return nodes.limit(0).select("id", "name")
    found = [nodes.where(F.col("id").startswith(f"{x}:") & F.lower("name").contains(word.lower())).select("id", "name").orderBy("name", "id").limit(limit) for x in kinds]
    return reduce(DataFrame.union, found).orderBy("name", "id").limit(limit)


def first_of(df: DataFrame, order: str, *key: str) -> DataFrame:
    """The least ``order`` of each key."""
    return df.groupBy(*key).agg(F.min(order).alias(order))


def top(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


CONFIDENCE = ("CONFIRMED", "DECLARED", "UNVERIFIED", "CONFLICT")


def confidence_rank(column: str = "confidence") -> Column:
    """0 for the strongest; unknown ones are the weakest."""
    return F.coalesce(*(F.when(F.col(column) == c, i) for i, c in enumerate(CONFIDENCE)), F.lit(len(CONFIDENCE)))


def cumulative(df: DataFrame, order: str, good: str, n: str) -> DataFrame:
    """``df`` (one row a tier) with the precision of each tier and all before it."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("precision_so_far", F.sum(good).over(w) / F.sum(n).over(w))


def longest_prefix(df: DataFrame, order: str, ok: Column) -> DataFrame:
    """Rows before the first, in order, that isn't ok."""
    return df.withColumn("_ok", F.min(F.when(ok, 1).otherwise(0)).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).where("_ok = 1").drop("_ok")


def updated(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    u = updates.select(key, F.col(column).alias("_new"))
    return df.join(u, key, "left").withColumn(column, F.coalesce("_new", column)).select(df.columns)


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list[Column], rows: int = 0) -> DataFrame:
    """Both tables, of each key the row that comes first. ``rows``: about how many there are, so that parts are as many as they ask for."""
    return top(dealt(old.unionByName(new), rows, *key), key, order, 1)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of the keys that ``new`` has replaced by those of ``new``."""
    return without(old, new.select(key).distinct(), key).unionByName(new)
