"""Hard-negative mining by one-dimensional distance keys.

Every vector x gets one more component, sqrt(M - |x|^2) for the largest |x|^2 = M, so that for an anchor q (whose own is 0) a higher inner product is a
smaller distance: |q - x|^2 = |q|^2 + M - 2 q.x. Vectors are stored sorted by (nearest pivot, distance to it). A vector within r of an anchor has a key
within r of the anchor's own distance to that pivot, so a search scans one interval of keys a pivot and widens it until what it found, or the
distance that nothing beyond can count, certifies that the answer is whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.store import cut, partitions, small

#: Rows and bytes that pivots are chosen from, at most: those of the smallest hash. Anchors' first radii come from them too; results don't depend on them.
SAMPLE, SAMPLE_BYTES = 2048, 16 << 20
PIVOTS = 48
#: Vectors of a segment of the sorted store, anchors that are searched for together, and blocks of anchors whose best a task keeps at a time.
SEGMENT, TOGETHER, HELD = 1024, 256, 64
#: Blocks of anchors (each some 50 kB at 64 components) that are broadcast at most.
BROADCAST = 256
USABLE = "embedding is not null and vec_id is not null and label is not null and forall(embedding, x -> x is not null and abs(x) < double('infinity'))"
_ENDS = -(2**63), 2**63 - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``b``, held to the range of 64 bits; by floating point only where that is exact."""
    peak = lambda x: max(-int(x.min(initial=0)), int(x.max(initial=0)))
    most = peak(a) * peak(b) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, *_ENDS).astype(np.int64)


class Space:
    """Pivots, and distances among vectors with their added component."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, ids: np.ndarray, most: float, pivots: int) -> None:
        self.sample, self.labels, self.ids, self.most = sample, labels, ids, most
        full = self.lifted(sample)
        chosen, far = [0], np.full(len(full), np.inf)
        while len(chosen) < min(pivots, len(full)):  # each pivot is the vector farthest from those before
            far = np.minimum(far, np.linalg.norm(full - full[chosen[-1]], axis=1))
            if not far.max() > 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = full[chosen]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.append(x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None], 1)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest pivot and the distance to it, a block of rows at a time."""
        which, key = [], []
        for s in range(0, len(x), 256):
            d = self.to_pivots(self.lifted(x[s : s + 256]))
            which.append(d.argmin(1))
            key.append(d.min(1))
        return np.concatenate(which or [np.zeros(0, np.int64)]), np.concatenate(key or [np.zeros(0)])

    def to_pivots(self, full: np.ndarray) -> np.ndarray:
        return np.stack([np.linalg.norm(full - p, axis=1) for p in self.pivots], 1)

    def slack(self, q: np.ndarray) -> np.ndarray:
        """More than what rounding can take from a distance of each anchor."""
        return 1e-6 * (np.sqrt(self.most) + np.linalg.norm(q.astype(float), axis=1)) + 1e-9

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from each anchor at which inner products fall to ``score`` (a column or more), rounded up; none is too far for the lowest score there is."""
        x = q.astype(float)
        d2 = ((x * x).sum(1) + self.most)[:, None] - 2 * score.astype(float)
        return np.where(score > _ENDS[0], np.sqrt(np.maximum(d2, 0)) + self.slack(q)[:, None], np.inf)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    m = np.zeros((len(sizes), width), np.int64)
    m[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return m


def _thin(m: np.ndarray) -> tuple[int, bytes]:
    """A matrix of integers in as few bytes a number as all of them fit in."""
    least, most = int(m.min(initial=0)), int(m.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= least and most < 1 << (8 * w - 1))
    return width, m.astype(f"<i{width}").tobytes()


def _full(raw: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").astype(np.int64).reshape(rows, -1)


def _long(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


_BLOCK = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("uids", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("m", pa.binary())])
PACK = "block long, pivot int, low double, high double, n int, uids binary, ids binary, labels binary, width int, m binary"


def _packed(size: int, width: int, by_pivot: bool) -> "callable":
    """Rows, sorted by (pivot, key), in blocks of at most ``size``; ``by_pivot``: of one pivot each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            pivot, key = (b.column(c).to_numpy() for c in ("pivot", "key"))
            edges = np.flatnonzero(np.diff(pivot)) + 1 if by_pivot else np.zeros(0, np.int64)
            edges = np.unique(np.concatenate([edges, [0, b.num_rows]]))
            for a, z in [(s, min(s + size, z)) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()) for s in range(a, z, size)]:
                x = b.slice(a, z - a)
                uids, ids, labels = (x.column(c).to_numpy().astype(np.int64).tobytes() for c in ("uid", "vec_id", "label"))
                w, m = _thin(_matrix(x.column("terms"), width))
                number += 1
                row = dict(block=number, pivot=int(pivot[a]), low=float(key[a:z].min()), high=float(key[a:z].max()), n=z - a, uids=uids, ids=ids, labels=labels, width=w, m=m)
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, _BLOCK)

    return run


def _best(score: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores among ``ok``, ties to smaller ids."""
    at = np.flatnonzero(ok)
    if len(at) > k:
        s = score[at]
        at = at[s >= s[np.argpartition(s, len(s) - k)[len(s) - k]]]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


class Positives:
    """The first k rows of an anchor's label, but those of its own id. ``bands``: none."""

    def __init__(self, k: int) -> None:
        self.k = k

    def slots(self, bands: list[int] | None) -> list[tuple[int, int]]:
        return [(_ENDS[0], _ENDS[1])]

    def wanted(self, anchor: int, label: int, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (labels == label) & (ids != anchor)


class Negatives:
    """The first k rows of other labels whose score is from ``percent`` of a positive's up to it, for each of the anchor's positive scores."""

    def __init__(self, k: int, percent: int) -> None:
        self.k, self.percent = k, percent

    def slots(self, bands: list[int] | None) -> list[tuple[int, int]]:
        return [(max(_ENDS[0], min(_ENDS[1], -((-self.percent * p) // 100))), p) for p in bands or []]

    def wanted(self, anchor: int, label: int, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return labels != label


STATE = "qb long, n int, ids binary, labels binary, width int, m binary, bands array<array<long>>, least array<array<long>>, radius array<double>, done array<double>, open boolean"


def _begun(space: Space, rule) -> "callable":
    """Anchors with the score that each slot needs at least: its own bound, or the k-th best of the sample, which holds rows like all others.

    The first radius is half of the way from where the slots begin to where nothing can count any more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, labels, m, bands = _long(r["ids"]), _long(r["labels"]), _full(r["m"], r["width"], r["n"]), r["bands"] or [None] * r["n"]
                dot = products(m, space.sample)
                least, radius = [], []
                for i in range(len(ids)):
                    ok, own, reach = rule.wanted(ids[i], labels[i], space.ids, space.labels), [], -1.0
                    for low, high in rule.slots(bands[i]):
                        at = _best(dot[i], space.ids, ok & (dot[i] <= high) & (dot[i] >= low), rule.k)
                        own.append(int(dot[i][at[-1]]) if len(at) == rule.k else low)
                        if low <= high:
                            whole = float(space.radius(m[i : i + 1], np.array([[own[-1]]]))[0, 0])
                            near = float(space.radius(m[i : i + 1], np.array([[high]]))[0, 0])
                            reach = max(reach, near + 0.5 * (whole - near))
                    least.append(own)
                    radius.append(reach)
                out = {k: [r[k]] for k in ("qb", "n", "ids", "labels", "width", "m")} | {"bands": [[x or [] for x in bands]], "least": [least], "radius": [radius], "done": [[-1.0] * len(ids)], "open": [any(x >= 0 for x in radius)]}
                yield pa.RecordBatch.from_pydict(out, _state_schema())

    return run


def _state_schema() -> pa.Schema:
    longs = pa.list_(pa.list_(pa.int64()))
    return pa.schema([("qb", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("m", pa.binary()), ("bands", longs), ("least", longs), ("radius", pa.list_(pa.float64())), ("done", pa.list_(pa.float64())), ("open", pa.bool_())])


def _intervals(space: Space) -> "callable":
    """For each block of anchors and pivot the keys to scan, and those that were scanned before: unions over its anchors, so a segment is read once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = _full(r["m"], r["width"], r["n"])
                d = space.to_pivots(np.append(m.astype(float), np.zeros((len(m), 1)), 1))
                rows = []
                for now, name in ((np.array(r["radius"]), "now"), (np.array(r["done"]), "before")):
                    on = now >= 0
                    rows.append((np.where(on[:, None], d - now[:, None], np.inf).min(0), np.where(on[:, None], d + now[:, None], -np.inf).max(0)))
                (lo, hi), (old_lo, old_hi) = rows
                yield pa.RecordBatch.from_pydict({"qb": np.full(len(lo), r["qb"]), "pivot": np.arange(len(lo), dtype=np.int32), "lo": lo, "hi": hi, "old_lo": old_lo, "old_hi": old_hi})

    return run


FOUND = "qb long, i int, slot int, vec_id long, score long"


def _scan(rule) -> "callable":
    """The best of each anchor and slot in the segments that a task reads, kept together while they are of the same blocks of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            cols = [[], [], [], [], []]
            for qb, best in held.items():
                for (i, slot), (score, ids) in best.items():
                    for c, v in zip(cols, ([qb] * len(ids), [i] * len(ids), [slot] * len(ids), ids.tolist(), score.tolist())):
                        c += v
            held.clear()
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["qb", "i", "slot", "vec_id", "score"])

        for b in batches:
            for r in b.to_pylist():
                if r["qb"] not in held and len(held) == HELD:
                    yield flush()
                best = held.setdefault(r["qb"], {})
                ids, labels = _long(r["s_ids"]), _long(r["s_labels"])
                anchors, own = _long(r["ids"]), _long(r["labels"])
                dot = products(_full(r["m"], r["width"], r["n"]), _full(r["s_m"], r["s_width"], r["s_n"]))
                for i in range(r["n"]):
                    least = r["least"][i]
                    if not least or not (dot[i] >= min(least)).any():
                        continue
                    ok = rule.wanted(anchors[i], own[i], ids, labels)
                    for slot, (_, high) in enumerate(rule.slots(r["bands"][i])):
                        at = _best(dot[i], ids, ok & (dot[i] <= high) & (dot[i] >= least[slot]), rule.k)
                        if len(at):
                            score, names = dot[i][at], ids[at]
                            if (i, slot) in best:
                                score, names = (np.append(x, y) for x, y in zip(best[i, slot], (score, names)))
                                order = np.lexsort((names, -score))[: rule.k]
                                score, names = score[order], names[order]
                            best[i, slot] = score, names
        if held:
            yield flush()

    return run


def _judged(space: Space, rule) -> "callable":
    """After a scan: an anchor is certified if each slot has its k within the radius that was scanned, or nothing beyond it counts. Others go as far as their
    k-th best so far, or else as far as anything counts, which is enough for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m, worst = _full(r["m"], r["width"], r["n"]), {(x["i"], x["slot"]): x["score"] for x in r["kth"] or []}
                radius, done = [], []
                for i in range(r["n"]):
                    before, reach = r["radius"][i], -1.0
                    for slot, (low, high) in enumerate(rule.slots(r["bands"][i])):
                        if low <= high:
                            least = max(r["least"][i][slot], worst.get((i, slot), _ENDS[0]))
                            reach = max(reach, float(space.radius(m[i : i + 1], np.array([[least]]))[0, 0]))
                    done.append(max(before, r["done"][i]))
                    radius.append(reach if reach > done[-1] else -1.0)
                out = {k: [r[k]] for k in ("qb", "n", "ids", "labels", "width", "m", "bands", "least")} | {"radius": [radius], "done": [done], "open": [any(x >= 0 for x in radius)]}
                yield pa.RecordBatch.from_pydict(out, _state_schema())

    return run


def _search(anchors: DataFrame, segments: DataFrame, space: Space, rule) -> DataFrame:
    """(qb, i, slot, rank, vec_id, score): the first k rows for each slot of each anchor, exactly."""
    n = partitions(anchors.sparkSession)
    salt = F.pmod(F.xxhash64("segment"), F.lit(n)).cast("int")  # a pivot may hold most segments
    directory = segments.select(F.col("block").alias("segment"), "pivot", "low", "high").withColumn("salt", salt)
    payload = segments.select(F.col("block").alias("segment"), F.col("n").alias("s_n"), F.col("ids").alias("s_ids"), F.col("labels").alias("s_labels"), F.col("width").alias("s_width"), F.col("m").alias("s_m"))
    state = cut(anchors.mapInArrow(_begun(space, rule), STATE))
    by = Window.partitionBy("qb", "i", "slot").orderBy(F.desc("score"), "vec_id")
    found = None
    while state.where("open").limit(1).count():
        spans = state.where("open").mapInArrow(_intervals(space), "qb long, pivot int, lo double, hi double, old_lo double, old_hi double")
        spans = spans.where("lo <= hi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        hits = spans.join(directory, ["pivot", "salt"]).where("low <= hi and high >= lo and not (low <= old_hi and high >= old_lo)").select("qb", "segment")
        asked = state.where("open").select("qb", "n", "ids", "labels", "width", "m", "bands", "least")
        work = hits.join(small(asked, BROADCAST), "qb").join(payload, "segment")  # anchors travel to segments, which are more; a segment is shuffled once
        new = work.mapInArrow(_scan(rule), FOUND)
        new = new if found is None else found.drop("rank").unionByName(new)
        found = cut(new.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= rule.k))
        kth = found.where(F.col("rank") == rule.k).groupBy("qb").agg(F.collect_list(F.struct("i", "slot", "score")).alias("kth"))  # of a block, one a slot
        state = cut(state.join(kth, "qb", "left").mapInArrow(_judged(space, rule), STATE))
    return found


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", segment: int = SEGMENT, together: int = TOGETHER, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first ``positives`` rows of the same label, the
    first ``negatives`` rows of other labels whose score is from ``percent`` of the positive's score up to it.

    Components become floor(scale * x); scores are integer inner products, held like components to 64 bits, higher first, ties to smaller ids. ``is_anchor`` is an
    SQL condition on vec_id. Rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take no part; shorter vectors count as
    filled up with zeros. Rows of the anchor's own id are no positives of it. Every repeated row is an anchor and a candidate of its own, so an anchor may come with one
    positive or negative id several times. Other columns take no part, whatever their names. An empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("embedding")).where(USABLE)
    v = v.select("vec_id", "label", F.expr(f"transform(embedding, x -> cast(floor({scale} * double(x)) as long))").alias("terms"))
    squares = F.expr("aggregate(terms, 0d, (s, x) -> s + double(x) * double(x))")
    most, width = v.agg(F.max(squares), F.max(F.size("terms"))).first()
    if most is None:
        return spark.createDataFrame([], OUT)
    rows = max(positives + negatives + 1, min(SAMPLE, SAMPLE_BYTES // (8 * max(width, 1))))
    sample = v.orderBy(F.xxhash64("vec_id", "label", "terms"), "vec_id").limit(rows).toPandas()  # at most SAMPLE rows
    terms = np.zeros((len(sample), width), np.int64)
    for i, x in enumerate(sample["terms"]):
        terms[i, : len(x)] = x
    space = Space(terms, sample["label"].to_numpy(np.int64), sample["vec_id"].to_numpy(np.int64), float(most), pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, key = space.keys(_matrix(b.column("terms"), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(which, pa.int32()), pa.array(key, pa.float64())], [*b.schema.names, "pivot", "key"])

    kept = cut(v.mapInArrow(keyed, "vec_id long, label long, terms array<long>, pivot int, key double").withColumn("uid", F.monotonically_increasing_id()))
    order = ["pivot", "key", "uid"]
    bytes_ = kept.count() * (8 * width + 32)
    stored = kept.repartitionByRange(partitions(spark, bytes_), *order).sortWithinPartitions(*order)
    segments = cut(stored.mapInArrow(_packed(segment, width, True), PACK))
    asked = kept.where(is_anchor).repartitionByRange(partitions(spark, bytes_), *order).sortWithinPartitions(*order)
    asked = cut(asked.mapInArrow(_packed(together, width, False), PACK)).withColumnRenamed("block", "qb")
    if not asked.limit(1).count():
        return spark.createDataFrame([], OUT)

    pos = _search(asked.withColumn("bands", F.lit(None).cast("array<array<long>>")), segments, space, Positives(positives))
    if pos is None:
        return spark.createDataFrame([], OUT)
    each = pos.groupBy("qb", "i").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("x")).select("qb", "i", F.col("x.score").alias("scores"))
    bands = each.groupBy("qb").agg(F.map_from_entries(F.collect_list(F.struct("i", "scores"))).alias("by"))  # of one block of anchors
    bands = bands.join(asked.select("qb", "n"), "qb").select("qb", F.expr("transform(sequence(0, n - 1), i -> coalesce(by[i], cast(array() as array<long>)))").alias("bands"))
    neg = _search(asked.join(bands, "qb"), segments, space, Negatives(negatives, percent))
    if neg is None:
        return spark.createDataFrame([], OUT)
    pos = pos.select("qb", "i", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = neg.select("qb", "i", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asked.mapInArrow(_names, "qb long, i int, anchor_id long")
    return neg.join(pos, ["qb", "i", "slot"]).join(names, ["qb", "i"]).select(*(x.split()[0] for x in OUT.split(", ")))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.select(["qb", "ids"]).to_pylist():
            ids = _long(r["ids"])
            yield pa.RecordBatch.from_pydict({"qb": np.full(len(ids), r["qb"]), "i": np.arange(len(ids), dtype=np.int32), "anchor_id": ids})
