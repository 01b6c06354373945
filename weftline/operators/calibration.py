"""Candidate names graded by what found them, the order of grades by their precision, and how far down that order names can be accepted unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import once
from weftline.operators.evaluation import folds, ratio
from weftline.sources.store import cut

#: Grades in their prior order; fixed values.
TIERS = ("agree", "sql_qual", "sql_bare", "model_qual", "model_bare")


def _ends(name: str | Column) -> Column:
    """All dotted ends of a name, itself first."""
    return once(F.split(name, r"\."), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def alike(a: DataFrame, b: DataFrame, key: list[str], other: str) -> DataFrame:
    """(key..., name, ``other``): pairs of names within a key that are equal or of which one is the other's dotted end. Both sides: key..., name."""
    theirs = b.select(*key, F.col("name").alias(other)).distinct()
    own = a.select(*key, "name").distinct()
    down = own.withColumn("_end", F.explode(_ends("name"))).join(theirs.withColumn("_end", F.col(other)), [*key, "_end"]).drop("_end")
    up = own.withColumn("_end", F.col("name")).join(theirs.withColumn("_end", F.explode(F.slice(_ends(other), 2, 1 << 30))), [*key, "_end"]).drop("_end")
    return down.select(*key, "name", other).union(up.select(*key, "name", other))  # equal names are in the first alone, so no pair comes twice


def candidates(parsed: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(key, name, tier) of names that a parser and a model found in each key's text (key, name), each once: a parsed one that the model names too agrees, and a
    predicted one that matches a parsed one stands for that; others are graded by their side and whether they are qualified. Null names are none."""
    s, m = (x.where("name is not null").select(key, "name").distinct() for x in (parsed, predicted))
    both = cut(alike(s, m, [key], "_other"))
    grade = lambda side: F.when(F.col("name").contains("."), f"{side}_qual").otherwise(f"{side}_bare")
    agreed = both.select(key, "name").distinct().withColumn("_agree", F.lit(True))
    ours = s.join(agreed, [key, "name"], "left").select(key, "name", F.when(F.col("_agree"), "agree").otherwise(grade("sql")).alias("tier"))
    theirs = m.join(both.select(key, F.col("_other").alias("name")), [key, "name"], "left_anti").select(key, "name", grade("model").alias("tier"))
    return ours.unionByName(theirs)


def judged(edges: DataFrame, gold: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(``edges`` with correct, ``gold`` (key, name) with the tiers that cover it) of keys that have gold names. What several joins read is computed once."""
    edges, known = cut(edges), cut(gold.where("name is not null").select(key, "name").distinct())
    hits = cut(alike(edges, known, [key], "_gold"))
    right = hits.select(key, "name").distinct().withColumn("correct", F.lit(True))
    rows = edges.join(known.select(key).distinct(), key, "left_semi").join(right, [key, "name"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))
    covering = hits.join(edges, [key, "name"]).groupBy(key, F.col("_gold").alias("name")).agg(F.collect_set("tier").alias("tiers"))  # at most one a tier
    return rows, cut(known.join(covering, [key, "name"], "left").withColumn("tiers", F.coalesce("tiers", F.expr("cast(array() as array<string>)"))))


def _prior(tier: str = "tier") -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), F.col(tier))


def ordered(tiers: DataFrame, group: list[str], calibrated: bool = True) -> DataFrame:
    """``tiers`` (group..., tier, n, good), those that have rows, with their place: by precision, ties in the prior order, or in the prior order alone; and n and good so far."""
    by = [F.desc(F.col("good") / F.col("n")), _prior()] if calibrated else [_prior()]
    w = Window.partitionBy(*group).orderBy(*by)  # a group has as many rows as there are tiers
    rows = tiers.where("n > 0").withColumn("place", F.row_number().over(w))
    return rows.withColumn("n_so_far", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("good_so_far", F.sum("good").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def curve(edges: DataFrame, gold: DataFrame, key: str, calibrated: bool) -> DataFrame:
    """(place, tier, n, correct, accepted, precision, recall, review): the operating point of accepting each tier and all before it; review: names left a key."""
    rows, covered = judged(edges, gold, key)
    tiers = rows.groupBy("tier").agg(F.count("*").alias("n"), F.count_if("correct").alias("good")).withColumn("_all", F.lit(0))
    points = ordered(tiers, ["_all"], calibrated)
    first = covered.select(F.explode_outer("tiers").alias("tier"), key, "name").join(points.select("tier", "place"), "tier", "left").groupBy(key, "name").agg(F.min("place").alias("place"))
    at = first.groupBy("place").agg(F.count("*").alias("_covered"))
    whole = covered.agg(F.count("*").alias("_golds"), F.count_distinct(key).alias("_keys"))
    w = Window.partitionBy("_all").orderBy("place")
    out = points.join(at, "place", "left").join(F.broadcast(whole))  # one row
    seen = F.sum(F.coalesce("_covered", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rest = F.sum("n").over(Window.partitionBy("_all")) - F.col("n_so_far")
    return out.select("place", "tier", "n", F.col("good").alias("correct"), F.col("n_so_far").alias("accepted"), F.round(F.col("good_so_far") / F.col("n_so_far"), 6).alias("precision"), F.round(seen / F.col("_golds"), 6).alias("recall"), F.round(rest / F.col("_keys"), 6).alias("review"))


def fold_sets(edges: DataFrame, gold: DataFrame, key: str, k: int | None, least: float) -> DataFrame:
    """(fold, accept, n_keys, accepted, correct, covered, golds) for each of ``k`` folds of the keys in their order, or a fold a key.

    A fold's order of tiers and the longest run from its top whose precision stays at ``least`` or more are fitted on the other folds' names: sums by fold
    and tier, less the fold's own, are all it takes. They are then applied to its own names.
    """
    rows, covered = judged(edges, gold, key)
    keys = covered.select(key).distinct()
    n = keys.count()
    dealt = cut(folds(keys, max(1, min(k or n, n)), key).select(key, "fold"))
    cells = rows.join(dealt, key).groupBy("fold", "tier").agg(F.count("*").alias("n"), F.count_if("correct").alias("good"))
    whole = cells.groupBy("tier").agg(F.sum("n").alias("_n"), F.sum("good").alias("_good"))
    own = dealt.groupBy("fold").agg(F.count("*").alias("n_keys"))
    grid = own.select("fold").crossJoin(F.broadcast(whole)).join(cells, ["fold", "tier"], "left")  # as many rows a fold as there are tiers
    rest = grid.select("fold", "tier", F.coalesce("n", F.lit(0)).alias("_own"), F.coalesce("good", F.lit(0)).alias("_own_good"), (F.col("_n") - F.coalesce("n", F.lit(0))).alias("n"), (F.col("_good") - F.coalesce("good", F.lit(0))).alias("good"))
    run = Window.partitionBy("fold").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fitted = ordered(rest, ["fold"]).withColumn("ok", F.min(F.col("good_so_far") / F.col("n_so_far") >= least).over(run))
    taken = fitted.where("ok").groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("place", "tier"))).alias("x"), F.sum("_own").alias("accepted"), F.sum("_own_good").alias("correct"))
    taken = taken.select("fold", F.col("x.tier").alias("accept"), "accepted", "correct")
    empty = F.expr("cast(array() as array<string>)")
    sets = own.join(taken, "fold", "left").select("fold", F.coalesce("accept", empty).alias("accept"), "n_keys", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("accepted", "correct")))
    found = covered.join(dealt, key).join(sets.select("fold", "accept"), "fold").groupBy("fold").agg(F.count_if(F.arrays_overlap("tiers", "accept")).alias("covered"), F.count("*").alias("golds"))
    return sets.join(found, "fold")


def pooled(sets: DataFrame) -> DataFrame:
    """(folds, precision, recall, precision_min, precision_max, recall_min, recall_max, modal, modal_folds): ``fold_sets`` summed up; the accept set that most folds chose, the first of them if several."""
    p, r = ratio(F.col("correct"), F.col("accepted"), 1.0), ratio(F.col("covered"), F.col("golds"), 0.0)
    total = lambda a, b, e: F.round(ratio(F.sum(a), F.sum(b), e), 6)
    scores = sets.agg(F.count("*").alias("folds"), total("correct", "accepted", 1.0).alias("precision"), total("covered", "golds", 0.0).alias("recall"), *(F.round(f(x), 6).alias(f"{n}_{s}") for n, x in (("precision", p), ("recall", r)) for f, s in ((F.min, "min"), (F.max, "max"))))
    chosen = sets.groupBy("accept").agg(F.count("*").alias("_n"), F.min("fold").alias("_first"))
    modal = chosen.agg(F.max_by("accept", F.struct("_n", -F.col("_first"))).alias("modal"), F.max("_n").alias("modal_folds"))
    return scores.join(F.broadcast(modal))  # one row each


def grafted(tables: DataFrame, columns: DataFrame, key: list[str], union: bool = False) -> DataFrame:
    """(key..., name, columns): the tables of one source with the columns of another.

    Both sides: key..., name, columns (null if it doesn't say), pos (its order). Names are trimmed and lower-cased; of one that comes several times the first whose
    columns aren't null counts. A table takes the columns of the other side's equal name, else of the first of its names that is a dotted end of it or has it for one, even
    if those are null; if there is none, its own. ``union``: tables that only the other side has are there too. Blank and null names are none.
    """
    def first(df: DataFrame) -> DataFrame:
        rows = df.withColumn("name", F.lower(F.trim("name"))).where("name <> ''")
        best = F.min_by(F.struct("columns"), F.struct(F.col("columns").isNull(), F.col("pos")))
        return rows.groupBy(*key, "name").agg(best.alias("_x"), F.min("pos").alias("pos")).select(*key, "name", F.col("_x.columns").alias("columns"), "pos")

    own, theirs = cut(first(tables)), cut(first(columns))
    wanted = own.select(*key, "name")
    wanted = wanted.union(theirs.select(*key, "name")).distinct() if union else wanted
    pairs = alike(wanted, theirs, key, "_other").join(theirs.withColumnRenamed("name", "_other"), [*key, "_other"])
    chosen = pairs.groupBy(*key, "name").agg(F.min_by(F.struct("columns"), F.struct(F.col("name") != F.col("_other"), F.col("pos"))).alias("_hit"))
    back = own.select(*key, "name", F.col("columns").alias("_own"))
    out = wanted.join(chosen, [*key, "name"], "left").join(back, [*key, "name"], "left")
    return out.select(*key, "name", F.when(F.col("_hit").isNotNull(), F.col("_hit.columns")).otherwise(F.col("_own")).alias("columns"))
