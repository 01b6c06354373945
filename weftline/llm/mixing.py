"""Mixing of sources to target weights: exact block quotas, dealt to output shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.store import cut

WEIGHTS = (3, 1, 2)
#: Words of a block, blocks of a shard, and parts into which each source's order is cut for running sums.
BLOCK, SHARD_BLOCKS, PARTS = 1 << 15, 16, 1024
WORD = r"[^\x20\x09-\x0D]+"
#: Shards below which a node's whole subtree is one task's work.
SUBTREE = 256


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of each source of a table with source and size.

    Sources by code point, null last, take ``weights`` in turn; targets are in proportion to them, sum to ``share`` of all
    sizes, and stop at ``most`` times a source's size, the excess going to the rest by weight. The common factor follows from running sums over sources in
    the order in which they reach their limit. One row a source; all of them pass one task.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({"full": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "used": F.coalesce(F.sum("w").over(before), F.lit(0)), "all": F.sum("source_size").over(every), "all_w": F.sum("w").over(every)})
    rows = rows.withColumn("each", (share * F.col("all") - most * F.col("full")) / (F.col("all_w") - F.col("used")))
    rows = rows.withColumn("factor", F.min(F.when(F.col("each") * F.col("w") <= most * F.col("source_size"), F.struct(F.col("used"), F.col("each")))).over(every)["each"])
    limit = most * F.col("source_size")
    return rows.select("source", "source_size", F.coalesce(F.least(limit, F.col("factor") * F.col("w")), limit).cast("double").alias("target"))


def _descend(seed: int, stop: int) -> "callable":
    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Split nodes in halves until they hold ``stop`` shards at most; a node's draws depend on the seed and its shards alone."""
        for b in batches:
            for node in b.itertuples():
                todo, done = [(int(node.lo), int(node.hi), np.asarray(node.source, np.int64), np.asarray(node.at, np.int64), np.asarray(node.n, np.int64))], []
                while todo:
                    lo, hi, source, at, n = todo.pop()
                    if hi - lo <= stop:
                        done.append((lo, hi, source, at, n))
                        continue
                    mid = (lo + hi) // 2
                    take = int(n.sum()) * (mid - lo) // (hi - lo)
                    rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
                    left = rng.multivariate_hypergeometric(n, take, method="marginals") if len(n) else n
                    for part in ((lo, mid, at, left), (mid, hi, at + left, n - left)):
                        on = part[3] > 0
                        todo.append((part[0], part[1], source[on], part[2][on], part[3][on]))
                yield pd.DataFrame(done, columns=["lo", "hi", "source", "at", "n"])

    return descend


def shards(quotas: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """(shard, source, block) of tables of block quotas (source: a number, n: its blocks 0..n-1), each block to one shard.

    The root holds all quotas; a node of k shards gives its left half a multivariate-hypergeometric draw of as many blocks as
    its part of the shards is due. The top of the tree is one task's work (a node is one number a source), subtrees of at most
    SUBTREE shards are dealt to tasks.
    """
    kind = "lo long, hi long, source array<long>, at array<long>, n array<long>"
    q = F.sort_array(F.collect_list(F.struct("source", "n")))
    root = quotas.where("n > 0").groupBy().agg(q.alias("q")).select(F.lit(0).cast("long").alias("lo"), F.lit(n_shards).cast("long").alias("hi"), F.col("q.source").alias("source"), F.transform("q", lambda x: F.lit(0).cast("long")).alias("at"), F.col("q.n").alias("n"))
    nodes = root.mapInPandas(_descend(seed, SUBTREE), kind)
    if n_shards > SUBTREE:
        nodes = nodes.repartition(-(-n_shards // SUBTREE), "lo")
    leaves = nodes.mapInPandas(_descend(seed, 1), kind)
    each = leaves.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("source", "at", "n")).alias("x")).where("x.n > 0")
    return each.select("shard", F.col("x.source").alias("source"), F.explode(F.sequence(F.col("x.at"), F.col("x.at") + F.col("x.n") - 1)).alias("block"))


def _placed(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple, share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as a struct ``row``, placed in their source's permuted order, with what each pass takes of them; and the sources."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), h.alias("h"))
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * PARTS / F.lit(2**32)).cast("long"))
    thin = cut(rows.groupBy("source", "part").agg(F.sum("size").alias("s")))
    goal = targets(thin.select("source", F.col("s").alias("size")), weights, share, most)
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long")
    goal = cut(goal.withColumn("number", number).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = thin.select(F.col("source").alias("s_source"), F.col("part").alias("s_part"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"))
    sums = cut(sums.join(goal, F.col("s_source").eqNullSafe(F.col("source"))).drop("source"))
    inner = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("part") == F.col("s_part"))).withColumn("start", F.col("ahead") + F.col("inner"))
    passes = F.expr("filter(transform(sequence(0, {0}), p -> struct(p as pass, greatest(0L, least(size, quota - start - p * source_size)) as words)), x -> x.words > 0)".format(int(np.ceil(most)) - 1))
    return rows.withColumn("passes", passes), goal


def _dealt(goal: DataFrame, block: int, shard_blocks: int, seed: int) -> tuple[DataFrame, int]:
    """(number, block, shard) of every block of every source's quota, and the number of shards."""
    blocks = goal.select(F.col("number").alias("source"), F.ceil(F.col("quota") / F.lit(block)).cast("long").alias("n"))
    n = max(1, -(-blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // shard_blocks))
    return shards(blocks, n, seed).withColumnRenamed("source", "number"), n


def _drawn(placed: DataFrame, dealt: DataFrame, block: int) -> DataFrame:
    """A row for each time that a document is taken, with its shard and its rank there."""
    rows = placed.withColumn("x", F.explode("passes")).select("*", "x.pass", "x.words").drop("passes", "x")
    rows = rows.withColumn("block", F.floor((F.col("start") + F.col("pass") * F.col("source_size")) / F.lit(block)).cast("long")).join(dealt, ["number", "block"])
    return rows.withColumn("rank", F.md5(F.concat_ws(":", "h", F.col("pass").cast("string"), F.col("shard").cast("string"))))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(plan, pieces): a row per row of ``docs``, and what the mix takes of it, by output shard.

    plan: doc_id, source, size, source_size, target, start (words before it in its source's permuted order).
    pieces: shard, position (shuffled within the shard), doc_id, source, start, size, pass (0 the first time, 1 the second), words (all
    of the document, or the first words where the source's target ends).
    A source's documents are permuted by the MD5 of seed and id; the permuted order, read again and again, is cut into blocks of about
    ``block`` words, whose number up to the target, rounded, is the source's exact quota. So a source's taken words equal its
    rounded target, one document a source is cut, and none is taken more than ceil(most) times. Running sums go by
    PARTS parts of a source, so a source with a third of all rows is as many groups. Reruns agree; rows of equal id, source and size
    share one order, in any way. Null text has size 0; a null id is permuted as an empty one; no rows give no rows.
    """
    placed, goal = _placed(docs.select(doc_id, text, source), doc_id, text, source, weights, share, most, seed)
    plan = cut(placed.drop("row", "part", "s_part", "s_source", "ahead", "inner"))
    pieces = _drawn(plan, _dealt(goal, block, shard_blocks, seed)[0], block)
    place = F.row_number().over(Window.partitionBy("shard").orderBy("rank", "number", "start")) - 1
    pieces = pieces.select("shard", place.alias("position"), "doc_id", "source", "start", "size", "pass", "words")
    return plan.select("doc_id", "source", "size", "source_size", "target", "start"), pieces


def digest(plan: DataFrame, pieces: DataFrame) -> DataFrame:
    """A row per document of ``plan``, with the words that ``pieces`` hold of it."""
    keys = ["doc_id", "source", "start", "size"]
    got = pieces.groupBy(keys).agg(F.sum("words").alias("n")).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return plan.join(got, on, "left").select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = None, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as ``mix`` takes them: repeated where taken twice, the last of a source cut to its first words, joined by one blank.

    Rows come by shard, shuffled within it. ``n_chars`` names a column that holds the length of the text.
    """
    placed, goal = _placed(docs, doc_id, text, source, weights, share, most, seed)
    dealt, n = _dealt(goal, block, shard_blocks, seed)
    rows = _drawn(placed, cut(dealt), block).select("row", "shard", "rank", "start", "size", "words")
    rows = rows.repartition(max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "rank", "start")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text}"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    now = F.when(F.col("words") < F.col("size"), first).otherwise(F.col(f"row.{text}"))
    out = {c: F.col("row")[c] for c in docs.columns} | {text: now} | ({n_chars: F.length(now).cast(dict(docs.dtypes)[n_chars])} if n_chars else {})
    return rows.select(*(v.alias(k) for k, v in out.items()))
