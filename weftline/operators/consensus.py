"""Agreement of several sources on names of tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffix_join(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Pairs of rows whose names are equal or of which one is the other's dotted end: an equi-join on all dotted ends."""
    def ends(df: DataFrame, side: str) -> DataFrame:
        parts = F.split(name, r"\.")
        all_ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        return df.withColumn("_end", F.explode(all_ends)).withColumnRenamed(name, f"_name_{side}")

    both = ends(a, "a").join(ends(b, "b"), "_end")
    return both.where((F.col("_end") == F.col("_name_a")) | (F.col("_end") == F.col("_name_b"))).drop("_end").distinct()


def named_alike(parsed: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, confidence): names of both, in the declared spelling, compared without case."""
    a = parsed.select(F.lower("name").alias("k"), F.col("name").alias("p"))
    b = declared.select(F.lower("name").alias("k"), F.col("name").alias("d"))
    c = F.when(F.col("p").isNotNull() & F.col("d").isNotNull(), "CONFIRMED").when(F.col("d").isNull(), "UNVERIFIED").otherwise("DECLARED")
    return a.join(b, "k", "full").select(F.coalesce("d", "p").alias("name"), c.alias("confidence"))


#: Namespaces of engines' own tables: those of every engine, and those of one; fixed values.
COMMON = ("information_schema",)
SYSTEM = {
    "postgres": ("pg_catalog", "pg_toast"),
    "mysql": ("mysql", "sys", "performance_schema"),
    "mariadb": ("mysql", "sys", "performance_schema"),
    "starrocks": ("mysql", "sys", "performance_schema"),
    "doris": ("mysql", "sys", "performance_schema"),
    "sqlserver": ("sys",),
    "oracle": ("sys", "system"),
}


def system_table(name: Column, engine: Column) -> Column:
    """Whether the last but one part of a qualified name is a namespace of the engine's own tables; a bare name's is none, an unknown engine has the common ones."""
    parts = F.split(F.trim(name), r"\.")
    schema = F.when(F.size(parts) >= 2, F.lower(F.element_at(parts, -2)))
    own = F.lit(False)
    for k, v in SYSTEM.items():
        own = F.when(F.lower(engine) == k, schema.isin(*v)).otherwise(own)
    return F.coalesce(schema.isin(*COMMON) | own, F.lit(False))


def hybrid(model: Column, ast: Column, strategy: str) -> Column:
    """Tables of a model and of a parser: model, override (the parser's where it has any), or union."""
    if strategy == "union":
        return F.array_union(model, ast)
    return model if strategy == "model" else F.when(F.size(ast) > 0, ast).otherwise(model)


def arbitrated(gold: Column, predicted: Column, grounded: Column) -> tuple[Column, Column]:
    """(disputed, gold after arbitration): an empty gold set against a prediction is disputed, and flips only to an arbiter's grounded set that isn't empty."""
    disputed = (F.size(gold) == 0) & (F.size(predicted) > 0)
    return disputed, F.when(disputed & (F.size(grounded) > 0), grounded).otherwise(gold)


def frozen_tiers(tiers: DataFrame, order: list, accepted: list, tier: str = "tier", good: str = "good", n: str = "n") -> DataFrame:
    """``tiers`` (one row each) of a frozen order, with place, whether they are accepted, and the precision of each and all before; tiers outside the order are left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(tier))
    rows = tiers.withColumn("place", place).where("place > 0")
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as the order has entries
    return rows.withColumn("precision_so_far", F.round(F.sum(good).over(w) / F.sum(n).over(w), 6)).withColumn("accepted", F.col(tier).isin(accepted))


def candidate_tier(sql: Column, model: Column, qualified: Column) -> Column:
    """agree, sql_qual, sql_bare, model_qual or model_bare."""
    return F.when(sql & model, "agree").when(sql & qualified, "sql_qual").when(sql, "sql_bare").when(qualified, "model_qual").otherwise("model_bare")


def aligned(rows: DataFrame, key: str) -> DataFrame:
    """(key, matched): pairs of gold and predicted names, one to one, chosen greedily in sorted order; equal, or one the other's dotted end."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        same = lambda a, b: a == b or a.endswith(f".{b}") or b.endswith(f".{a}")
        for b in batches:
            out = []
            for g, p in zip(b["gold"], b["pred"]):
                left, n = sorted(p), 0
                for x in sorted(g):
                    if (y := next((y for y in left if same(x, y)), None)) is not None:
                        left.remove(y)
                        n += 1
                out.append(n)
            yield pd.DataFrame({key: b[key], "matched": out})

    return rows.select(key, "gold", "pred").mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, matched int")
