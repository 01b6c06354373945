"""Scores, consensus and calibration of labelled sets, as aggregates over rows of (row, item)."""

from __future__ import annotations

from math import comb, exp, factorial, fsum
from sys import float_info

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.keyed import numbered


def ratio(a: Column, b: Column, empty: float) -> Column:
    """a / b, and ``empty`` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def clean_set(items: Column) -> Column:
    """Distinct trimmed lower-case names that aren't blank."""
    return F.array_distinct(F.transform(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.lower(F.trim(x))))


def counted(gold: Column, predicted: Column) -> dict[str, Column]:
    """tp, fp, fn and predicted total of two sets."""
    return {"tp": F.size(F.array_intersect(gold, predicted)), "fp": F.size(F.array_except(predicted, gold)), "fn": F.size(F.array_except(gold, predicted)), "pred_total": F.size(predicted)}


def micro(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    """Precision, recall and F1 of summed counts, as aggregates: 1, 1 and 0 where there is nothing to divide by."""
    t, p, n = F.sum(tp), F.sum(fp), F.sum(fn)
    return {"precision": F.round(ratio(t, t + p, 1.0), 6), "recall": F.round(ratio(t, t + n, 1.0), 6), "f1": F.round(ratio(2 * t, 2 * t + p + n, 0.0), 6)}


def majority(votes: DataFrame, least: int, key: list[str]) -> DataFrame:
    """Items that so many different voters named, with their number. votes: key..., voter."""
    return votes.groupBy(*key).agg(F.count_distinct("voter").alias("votes")).where(F.col("votes") >= least)


def _two_sided(b: int, c: int, exact: int = 1000, middle: float = 2.0**900) -> float:
    """Exact two-sided p of a fair split of ``b`` + ``c``. Beyond ``exact`` in doubles: each coefficient in proportion to the middle one, by recursion, until it is too small
    for a double (after some 26 square roots of the total); their sum stands for 2 ** total.
    """
    total, low = b + c, min(b, c)
    if total <= exact:
        return min(1.0, 2 * sum(comb(total, k) for k in range(low + 1)) / 2**total)
    shares, k, share = [], total // 2, middle
    while share >= float_info.min and k >= 0:
        shares.append(share)
        share *= k / (total - k + 1)
        k -= 1
    whole = 2 * fsum(shares) - (0 if total % 2 else middle)  # an even total has one middle
    return min(1.0, 2 * fsum(shares[total // 2 - low :]) / whole)


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(b_only, c_only, p): rows that only one of two systems has right, and the exact two-sided p. The counts alone come to the driver."""
    n = rows.agg(F.count_if(F.col(a) & ~F.col(b)).alias("b"), F.count_if(~F.col(a) & F.col(b)).alias("c")).first()
    return rows.sparkSession.createDataFrame([(n["b"], n["c"], _two_sided(n["b"], n["c"]))], "b_only long, c_only long, p double")


def _weights(keys: np.ndarray, seed: int, resamples: int) -> np.ndarray:
    """Poisson weights of mean 1 (rows x resamples) that depend on each row's key and the seed alone: mixed 64-bit counters, compared with the distribution."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, resamples + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    below = np.cumsum([exp(-1) / factorial(i) for i in range(18)])
    return np.searchsorted(below, u, side="right").astype(np.float64)


def resampled(rows: DataFrame, values: list[str], seed: int, resamples: int = 1000, block: int = 256) -> DataFrame:
    """(i, w, values...): sums of weights and of weighted values for each resample; all values of a row share its weight.

    Poisson weights need no number of rows. Each partition sums its rows, ``block`` at a time (numpy), and partial sums are added.
    Equal rows share a hash and so a weight: give rows a column that tells them apart.
    """
    def sums(batches):
        total = np.zeros((len(values) + 1, resamples))
        for b in batches:
            keys, v = b["_key"].to_numpy(), np.vstack([np.ones(len(b)), *(b[x].to_numpy(dtype=float) for x in values)])
            for at in range(0, len(keys), block):
                total += v[:, at : at + block] @ _weights(keys[at : at + block], seed, resamples)
        yield pd.DataFrame({"i": np.arange(resamples), "w": total[0]} | {x: total[k + 1] for k, x in enumerate(values)})

    keyed = rows.select(F.xxhash64(*rows.columns).alias("_key"), *(F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in values))
    schema = ", ".join(["i int", "w double", *(f"`{x}` double" for x in values)])
    return keyed.mapInPandas(sums, schema).groupBy("i").agg(*(F.sum(x).alias(x) for x in ("w", *values)))


def bootstrap(rows: DataFrame, value: str, seed: int, resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """(mean, low, high): percentile interval of a mean under resampling; rows with a null value take no part."""
    rows = rows.where(F.col(value).isNotNull())
    means = resampled(rows, [value], seed, resamples).select((F.col(value) / F.col("w")).alias("m"))
    out = means.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    return rows.agg(F.avg(value).alias("mean")).join(out)


def _f1(tp: str, fp: str, fn: str) -> Column:
    return ratio(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn), 0.0)


def paired_bootstrap(rows: DataFrame, seed: int, resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """(f1_a, f1_b, difference, low, high, significant) of two systems by their micro F1; both see the same weights.

    rows: a key and the counts tp_a, fp_a, fn_a, tp_b, fp_b, fn_b. Significant if 0 lies outside the interval of F1(a) - F1(b).
    """
    counts = [f"{c}_{s}" for s in "ab" for c in ("tp", "fp", "fn")]
    gap = (_f1(*counts[:3]) - _f1(*counts[3:])).alias("gap")
    ends = resampled(rows, counts, seed, resamples).select(gap).agg(F.percentile("gap", (1 - level) / 2).alias("low"), F.percentile("gap", (1 + level) / 2).alias("high"))
    seen = rows.agg(*(F.sum(c).alias(c) for c in counts)).select(_f1(*counts[:3]).alias("f1_a"), _f1(*counts[3:]).alias("f1_b"), gap.alias("difference"))
    return seen.join(ends).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def folds(rows: DataFrame, k: int, order: str) -> DataFrame:
    """``rows`` with a fold 0..k-1 by place in order."""
    return numbered(rows, "fold", order).withColumn("fold", F.pmod("fold", F.lit(k)))


def cross_validated(rows: DataFrame, k: int, order: str, tier: str, good: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(scores, accepted): tiers are accepted for each fold by their precision on the other folds, and judged on the fold itself.

    scores: accepted, right, precision and recall pooled over folds; accepted: tier and the number of folds that accept it. ``good`` is 0 or 1.
    Sums of each fold and tier are all that is joined: a fold's training sums are those of the tier without its own.
    """
    cells = folds(rows, k, order).groupBy("fold", tier).agg(F.count("*").alias("n"), F.sum(good).alias("good"))
    whole = Window.partitionBy(tier)
    rest_n, rest_good = F.sum("n").over(whole) - F.col("n"), F.sum("good").over(whole) - F.col("good")
    judged = cells.withColumn("ok", (rest_n > 0) & (rest_good >= least * rest_n))
    taken, right, every = F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("ok"), F.col("good")).otherwise(0)), F.sum("good")
    scores = judged.agg(taken.alias("accepted"), right.alias("right"), F.round(ratio(right, taken, 1.0), 6).alias("precision"), F.round(ratio(right, every, 1.0), 6).alias("recall"))
    return scores, judged.where("ok").groupBy(tier).agg(F.count("*").alias("folds"))


def name_pools(real: DataFrame, synthetic: DataFrame, least: int = 60, parts: int = 6) -> DataFrame:
    """(name, pool, synthetic) of each different name of two tables of one column: one in ``parts`` is held out, ``least`` at least, the others are for
    training; no name is in both pools. Names lie in the order of their MD5, so a rerun agrees. Null names are left out.
    """
    both = real.toDF("name").withColumn("synthetic", F.lit(False)).union(synthetic.toDF("name").withColumn("synthetic", F.lit(True)))
    names = both.where("name is not null").groupBy("name").agg(F.bool_or("synthetic").alias("synthetic")).withColumn("_order", F.md5("name"))
    held = max(least, names.count() // parts)
    return numbered(names, "_place", "_order", "name").select("name", F.when(F.col("_place") < held, "heldout").otherwise("train").alias("pool"), "synthetic")


def ungrounded(docs: DataFrame, names: DataFrame, gold: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, name) of each row of ``docs`` and each different name predicted for all of them that is neither gold for its key nor stands literally, as a whole, in its text.

    names: name; gold: key, name. Blank names are none, a null text holds nothing. A key's gold names are one array beside its text, so pairs aren't
    shuffled; Spark broadcasts the names only up to its own size limit, else it pairs blocks of both sides.
    """
    known = gold.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("name").alias("_gold"))
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("_text")).join(known, key, "left")
    pairs = rows.crossJoin(names.where("trim(name) <> ''").select("name").distinct())
    return pairs.where(~F.coalesce(F.array_contains("_gold", F.col("name")), F.lit(False)) & ~F.col("_text").contains(F.col("name"))).select(key, "name")


def frontier(points: DataFrame, least: float) -> DataFrame:
    """The point of highest recall whose precision is enough."""
    return points.where(F.col("precision") >= least).agg(F.max_by("tier", F.struct("recall", "precision")).alias("tier"), F.max("recall").alias("recall"))


def kept_empty(rows: DataFrame, empty: Column, share: float, key: str) -> DataFrame:
    """All rows that aren't empty, and of the empty ones, by hash, as many as make up ``share`` of the result."""
    n = rows.agg(F.count_if(~empty).alias("_n"))
    placed = numbered(rows.where(empty).withColumn("_h", F.md5(F.col(key).cast("string"))), "_k", "_h", key).join(n)
    return rows.where(~empty).unionByName(placed.where(F.col("_k") < F.floor(F.col("_n") * share / (1 - share))).drop("_h", "_k", "_n"))
