"""Exact top-k by inner product, a term at a time, over blocks of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.store import cut, partitions

BLOCK = 4096
USABLE = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and abs(x) < double('infinity'))"


def _pack(rows: int) -> "callable":
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of at most ``rows`` vectors: ids and a matrix of integers, shorter vectors filled up with zeros."""
        block = TaskContext.get().partitionId() << 24
        for b in batches:
            for at in range(0, b.num_rows, rows):
                x = b.slice(at, rows)
                lists, ids = x.column("terms"), x.column("vec_id").to_numpy()
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                width = int(sizes.max(initial=0))
                m = np.zeros((len(ids), width), np.int64)
                m[np.arange(width)[None, :] < sizes[:, None]] = flat
                block += 1
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "ids": [ids.astype(np.int64).tobytes()], "m": [m.tobytes()]})

    return pack


def scores(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Inner products of query rows with n candidates: each term's postings are scattered, weighted, into dense arrays.

    Sums that could leave 64 bits are added up as Python's integers and held to the ends of their range.
    """
    peak = lambda x: max(-int(x.min(initial=0)), int(x.max(initial=0)))
    most = sum(peak(queries[:, t]) * peak(postings[t][1]) for t in range(min(queries.shape[1], len(postings))))
    if most >= 2**63:
        queries, postings = queries.astype(object), [(at, value.astype(object)) for at, value in postings]
    out = np.zeros((len(queries), n), queries.dtype)
    for t in range(min(queries.shape[1], len(postings))):
        at, value = postings[t]
        on = np.flatnonzero(queries[:, t])
        if not len(at) or not len(on):
            continue
        if len(at) == n and len(on) == len(queries):
            out += queries[:, t, None] * value[None, :]
        else:
            out[np.ix_(on, at)] += queries[on, t, None] * value[None, :]
    return out if out.dtype == np.int64 else np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, without those of id ``own``."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        s = score[at]
        least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
        at = at[s >= least]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _search(k: int) -> "callable":
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, qids = (np.frombuffer(r[x], np.int64) for x in ("ids", "q_ids"))
                m, q = (np.frombuffer(r[x], np.int64).reshape(len(i), -1) for x, i in (("m", ids), ("q_m", qids)))
                postings = [(at := np.flatnonzero(m[:, t]), m[at, t]) for t in range(m.shape[1])]
                for s in range(0, len(q), 512):
                    dense = scores(q[s : s + 512], postings, len(ids))
                    got = [best(dense[i], ids, own, k) for i, own in enumerate(qids[s : s + 512])]
                    row = np.repeat(np.arange(len(got)), [len(x) for x in got])
                    at = np.concatenate(got) if got else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "q_block": np.full(len(at), r["q_block"], np.int64), "q_row": row + s, "query_id": qids[s : s + 512][row], "vec_id": ids[at], "score": dense[row, at]})

    return search


def top_k(vectors: DataFrame, is_query: str, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k candidates with the highest integer inner products for each query.

    Components become floor(scale * x), held like scores to the range of 64 bits. ``is_query`` is an SQL condition on vec_id; candidates are all rows but those of
    the query's own id, ties go to the smaller id. Vectors or ids that are null, or vectors that hold null or non-finite
    components, take no part; a shorter vector counts as filled up with zeros, an empty one scores 0. Every repeated row
    is a candidate, and a query, of its own. Query blocks meet candidate blocks by a join on the query block and a salt, so candidates are spread
    over all tasks; each pair of blocks gives at most k rows a query, which a window over the query merges.
    """
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(USABLE)
    v = v.select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale} * double(x)) as long))").alias("terms"))
    kind = "block long, ids binary, m binary"
    asked = v.where(is_query)
    n = asked.count()
    salts = partitions(vectors.sparkSession)
    asked = cut(asked.repartition(-(-max(n, 1) // block)).mapInArrow(_pack(block), kind))
    asked = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    numbers = asked.agg(F.sort_array(F.collect_list("q_block")).alias("b")).first()["b"]  # one long for each 4096 queries
    given = v.mapInArrow(_pack(block), kind).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    given = given.withColumn("q_block", F.explode(F.lit(numbers) if numbers else F.expr("cast(array() as array<long>)")))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = given.join(asked, ["q_block", "salt"]).select("q_block", "ids", "m", "q_ids", "q_m")
    found = found.mapInArrow(_search(k), "q_block long, q_row long, query_id long, vec_id long, score long")
    by = Window.partitionBy("q_block", "q_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
