"""Near-duplicate embeddings of one label, by tile products of int8 vectors with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.graph import components
from weftline.llm.store import cut, partitions

TILE = 2048
#: Room for rounding in double precision, far above what sums of a few thousand products lose.
SLACK = 1e-9
USABLE = "size({0}) > 0 and forall({0}, x -> x is not null and abs(x) < double('infinity')) and exists({0}, x -> x <> 0)"


def _units(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tiles(rows: int) -> "callable":
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal (label, dim) of a sorted partition, at most ``rows`` vectors to a tile."""
        part, seq, held = TaskContext.get().partitionId() << 24, 0, []

        def flush(key: tuple) -> pa.RecordBatch:
            nonlocal seq
            ids, w, flat = (np.concatenate(x) for x in zip(*held))
            held.clear()
            seq += 1
            return pa.RecordBatch.from_pydict({"label": pa.array([key[0]], pa.int64()), "dim": pa.array([key[1]], pa.int32()), "tile": pa.array([part + seq], pa.int64()), "ids": [ids.tobytes()], "w": [w.tobytes()], "flat": [flat.tobytes()]})

        key, full = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            label, dim = b.column("label").to_numpy(), b.column("dim").to_numpy()
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(dim)])
            ids, w = b.column("cid").to_numpy(), b.column("w").to_numpy()
            at = 0
            while at < len(ids):
                now = int(label[at]), int(dim[at])
                if held and (now != key or full >= rows):
                    yield flush(key)
                    full = 0
                key = now
                other = np.flatnonzero((label[at:] != now[0]) | (dim[at:] != now[1]))
                to = min(at + (int(other[0]) if len(other) else len(ids) - at), at + rows - full)
                held.append((ids[at:to], w[at:to], flat[ends[at] : ends[to]]))
                full += to - at
                at = to
        if held:
            yield flush(key)

    return pack


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and length of what rounding left out, of each unit vector."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rest = x - q * scale[:, None]
    return q, scale, np.sqrt((rest * rest).sum(axis=1))


def linked(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of vector pairs of two tiles of unit vectors with cosine of ``threshold`` or more; i < j in the same tile.

    With u = s*q + r, |u.v - s*t*(q.p)| <= |r| + (1 + |r|)*|r'|; a pair is computed in double precision only if the int8
    product and this bound leave it possible. int8 products are summed exactly in float32 while dim * 127**2 < 2**24.
    """
    (qa, sa, ea), (qb, sb, eb) = _quantised(a), _quantised(b)
    kind = np.float32 if a.shape[1] * 127**2 < 2**24 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    near *= sa[:, None]
    near *= sb[None, :]
    near += (1 + ea)[:, None] * eb[None, :]
    i, j = np.nonzero(near >= (threshold - SLACK - ea)[:, None])
    if same:
        i, j = i[i < j], j[i < j]
    yes = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        s = slice(k, k + (1 << 15))
        yes[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= threshold
    return i[yes], j[yes]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places reaches over links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _product(threshold: float, kind: str) -> "callable":
    def product(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("tile")
        dim = int(pair.dim.iloc[0])
        sides = [(np.frombuffer(r.ids, np.int64), np.frombuffer(r.w, np.int64), _units(np.frombuffer(r.flat, kind), dim)) for r in pair.itertuples()]
        (ia, wa, a), (ib, wb, b) = sides[0], sides[-1]
        same = len(sides) == 1
        i, j = linked(a, b, threshold, same)
        ids, w = (ia, wa) if same else (np.concatenate([ia, ib]), np.concatenate([wa, wb]))
        j = j if same else j + len(ia)
        links = (np.bincount(i, w[j], len(ids)) + np.bincount(j, w[i], len(ids))).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][roots(len(ids), place[i], place[j])[place]]
        on = links > 0
        return pd.DataFrame({"cid": ids[on], "links": links[on], "root": root[on]})

    return product


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: its id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null and their lengths are equal. A vector that is null, empty or zero, or
    holds null or non-finite components, or whose id is null, links with nothing: n_links 0, its own component, kept.
    Equal vectors of a label are one class with a weight, so a group of exact copies of any size is one row of a tile.
    Classes stand in tiles of at most ``tile`` vectors; every pair of tiles of a label is one task's work, which returns
    a count and a root for each vector, never pairs. Rows that repeat an id count as vectors of their own.
    No vectors give no rows; other columns are ignored.
    """
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("embedding"))
    ok = v.where(f"vec_id is not null and label is not null and embedding is not null and {USABLE.format('embedding')}")
    ok = ok.withColumn("h", F.xxhash64("embedding"))
    classes = ok.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))  # a number of its own: ids may repeat
    spark = vectors.sparkSession
    kind = "f4" if "float" in dict(v.dtypes)["embedding"] else "f8"
    n = partitions(spark)
    sorted_ = classes.withColumn("dim", F.size("embedding")).repartitionByRange(n, "label", "dim", "cid").sortWithinPartitions("label", "dim")
    flat = sorted_.select("label", "dim", "cid", "w", F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>").alias("embedding"))
    tiles = cut(flat.mapInArrow(_tiles(tile), "label long, dim int, tile long, ids binary, w binary, flat binary"))
    others = tiles.groupBy("label", "dim").agg(F.collect_list("tile").alias("others"))
    pairs = tiles.join(cut(others), ["label", "dim"]).withColumn("other", F.explode("others"))
    pairs = pairs.select("label", "dim", "tile", "ids", "w", "flat", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    found = cut(pairs.groupBy("lo", "hi").applyInPandas(_product(threshold, kind), "cid long, links long, root long"))
    parts = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    per = classes.join(links, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("number", F.coalesce("component", "cid")).drop("component")
    per = cut(per.select("label", "h", "embedding", "number", "least", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links")))
    per = per.join(per.groupBy("number").agg(F.min("least").alias("component")), "number").select("label", "h", "embedding", "links", "component")
    out = ok.join(per, ["label", "h", "embedding"]).select("vec_id", "links", "component")
    rest = v.where(f"not coalesce(vec_id is not null and label is not null and embedding is not null and {USABLE.format('embedding')}, false)")
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component")))
    return out.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
