"""Links between documents whose word shingles have a high Jaccard similarity: universe partition and pigeonhole, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, erfc, exp, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.exchange import KIND, buckets, exchanged, gathered, packets, repeated, short_keys
from weftline.llm.graph import components
from weftline.llm.identity import identified
from weftline.llm.store import TRIM, batched, cut, partitions, pick, small, trim
from weftline.llm.words import LOWER, blocks, hashed, mix

WORDS, PERCENT = 5, 80
#: Signature records that a task holds before it sends them.
RECORDS = 1 << 20
#: Documents of one signature in a tile, when those of different components are paired.
TILE = 512
#: Sets that are intersected with one other at a time.
LEAVES = 64
ROLE = np.uint64(1)
#: Node numbers that different sets may share; a million is what some 10**12 sets would have.
SHARED = 1 << 20
#: Parities that a set has at least and at most for comparison in tiles, and at most for that of two sets.
PARITY, WIDE = (128, 2048), 1 << 16


class Band(NamedTuple):
    """How sets of a band of sizes, and of the next, are partitioned to find each other."""

    number: int
    most: int  # elements in which a linked pair can differ, at most, its smaller set being of this band
    spare: int  # segments beyond most + 1
    segments: int


@lru_cache(4)
def bands(percent: int, top: int = 1 << 40) -> tuple[np.ndarray, tuple[Band, ...]]:
    """Least sizes of the bands, and their partitions.

    A set and any linked larger set are of one band or of neighbouring ones. With most + 1 + spare segments, spare + 1 of a
    linked pair's segments are equal at least. An empty segment is no evidence and is left out; a set with more empty
    segments than ``spare`` has to index one-deletion neighbourhoods too. ``spare`` is where the expected number of
    signatures, segments plus the neighbourhoods of such sets, is least.
    """
    low = [1, 2]
    while low[-1] < top:
        low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // percent + 1))
    found = []
    for k in range(len(low) - 1):
        most, n = (low[k + 1] - 1) * (100 - percent) // percent, (low[k] + low[k + 1]) / 2
        costs, usual = {}, (most + 1) * exp(-n / (most + 1))
        start, end = int(max(0, usual - 3 * sqrt(usual) - 2)), int(1.3 * usual + 9 * sqrt(usual) + 6)
        for spare in range(start, end, 1 + (end - start) // 200):
            m = most + 1 + spare
            mean = m * exp(-n / m)
            costs[spare] = m + n * 0.5 * erfc((spare + 0.5 - mean) / sqrt(2 * mean))
        spare = min(costs, key=costs.get)
        found.append(Band(k, most, spare, most + 1 + spare))
    return np.array(low), tuple(found)


def shingles(data: np.ndarray, at: np.ndarray, words: int = WORDS, seed: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; of fewer words, of all of them as one; of none, nothing."""
    h, _, _, first = hashed(LOWER[data], at)
    n = len(h)
    run = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(run)]
    run = mix(run, 50 + seed)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            x = np.sort(run[a : b - words + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            yield mix((h[a:b] * mix(np.arange(b - a, dtype=np.uint64), 8)).sum(keepdims=True), 60 + seed + b - a)
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(x: np.ndarray) -> tuple[int, int]:
    """126 bits of a set: a node number, whose lowest two bits are 0, and a check."""
    n = np.uint64(len(x))
    with np.errstate(over="ignore"):
        a, b = mix(np.array([mix(x, 1).sum(dtype=np.uint64) + n, mix(x, 2).sum(dtype=np.uint64) ^ n]), 3)
    return int(a & ~np.uint64(3)), int(b)


def numbered(both: tuple[int, int], moved: frozenset[int]) -> int:
    """The node number of a set of this fingerprint: its check stands in for numbers in ``moved``, which different sets have."""
    return both[1] & ~3 if both[0] in moved else both[0]


def parity(x: np.ndarray, most: int = PARITY[1]) -> bytes:
    """A power of 2 of bits, at least four times as many as elements up to ``most``, each the parity of how many elements fall on it."""
    bits = min(max(PARITY[0], 1 << (4 * len(x) - 1).bit_length()), most) if len(x) else PARITY[0]
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


class Parities:
    """Parities of many sets: of two sets, no more parities differ than elements do."""

    def __init__(self, bits: list[bytes]) -> None:
        self.width = np.array([len(b) // 8 for b in bits], np.int64)
        self.folds: dict[int, np.ndarray] = {}
        above, most = None, PARITY[1] // 64
        while most >= PARITY[0] // 64:
            fold = np.zeros((len(bits), most), np.uint64) if above is None else above[:, :most] ^ above[:, most:]
            own = np.flatnonzero(self.width == most)
            if len(own):
                fold[own] = np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(-1, most)
            self.folds[most] = above = fold
            most //= 2

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Parities that differ, the longer of two folded to the shorter: a lower bound of the elements that do."""
        out, width = np.zeros(len(a), np.int64), np.minimum(self.width[a], self.width[b])
        for w, fold in self.folds.items():
            at = np.flatnonzero(width == w)
            for k in range(0, len(at), 1 << 14):
                here = at[k : k + (1 << 14)]
                out[here] = np.bitwise_count(fold[a[here]] ^ fold[b[here]]).sum(axis=1)
        return out


def signatures(x: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, bool]]:
    """(signatures, whether they are of sets less one element) of a set of sorted hashes, for each band that it takes part in.

    The universe of hashes is cut into ranges, so segments are slices; a segment's hash is the sum of its elements', and one
    element less is one subtraction. For a pair with spare + 1 equal segments or more:
    - if either has no more than ``spare`` empty segments, an equal segment is not empty: full signatures meet;
    - else, if no equal segment has elements, at least segments + 1 + spare - e - e' segments (e, e': empty ones) hold elements in both
      and differ in one: a full signature meets that of a set less one element, unless
    - one set has more than half of its segments empty; such sets are met in one signature for all of the band's.
    """
    low, parts = bands(percent)
    own = int(np.searchsorted(low, len(x), "right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x, 4))])
    for k in (own, own - 1):
        if k < 0 or parts[k].most < 1:
            continue
        band, m = parts[k], parts[k].segments
        seg = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        cuts = np.searchsorted(seg, np.arange(m + 1))
        sizes = np.diff(cuts)
        on = sizes > 0
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 40), 5)
        whole = sums[cuts[1:]] - sums[cuts[:-1]]
        yield mix((whole ^ salt)[on], 6), False
        empty = m - int(on.sum())
        if empty > band.spare:
            of = seg.astype(np.int64)
            many = sizes[of] > 1
            yield mix((whole[of] - (sums[1:] - sums[:-1]) ^ salt[of])[many], 6), True
            yield mix(np.array([k], np.uint64), 7), 2 * empty <= m


def _thin(words: int, seed: int) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, prints, maps, wide = [], [], [], []
            for _, _, data, at in blocks(b.column("text")):
                for x in shingles(data, at, words, seed):
                    sizes.append(len(x))
                    prints.append(fingerprint(x))
                    maps.append(parity(x))
                    wide.append(parity(x, WIDE) if 4 * len(x) > PARITY[1] else None)
            both = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            cols = [b.column("doc_id"), b.column("uid"), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(maps, pa.binary()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "uid", "n", "node", "check", "bits", "wide"])

    return run


def _grouped(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records without repeats, by key, those with full signatures first and then by node; and where each key begins, with the end.

    A node that has both a full and a deletion record of one key keeps the full one.
    """
    if not len(keys):
        return keys, nodes, np.zeros(1, np.int64)
    order = np.lexsort((nodes, keys))  # the full record of a node comes before its deletion records
    keys, nodes = keys[order], nodes[order]
    one = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] | ROLE != nodes[:-1] | ROLE)])
    keys, nodes = keys[one], nodes[one]
    order = np.lexsort((nodes, nodes & ROLE, keys))
    keys, nodes = keys[order], nodes[order]
    return keys, nodes, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))


def _signed(words: int, percent: int, seed: int, n: int, moved: frozenset[int] = frozenset()) -> "callable":
    def packed(keys: np.ndarray, nodes: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        twice = repeated(keys)
        k, v, begin = _grouped(keys[twice], nodes[twice])
        size = np.repeat(np.diff(begin), np.diff(begin))
        hot = size > 2
        if hot.any():
            cols = [pa.array([-1 - (turn + int(v[0] >> np.uint64(2))) % n], pa.int32()), *(pa.array([x[hot].tobytes()], pa.binary()) for x in (short_keys(k, n), v))]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "vals"])
        lead = np.zeros(len(k), bool)
        lead[begin[:-1]] = True
        send = ~hot | lead
        # bit 1 of a leader's node says that the others of its signature stay in the other bucket
        v = v[send] | (hot[send].astype(np.uint64) << np.uint64(1))
        yield from packets(np.concatenate([keys[~twice], k[send]]), np.concatenate([nodes[~twice], v]), n, short=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packets of (signature; node, kept here) for about RECORDS records at a time. A signature that three or more of their nodes have goes to a bucket below 0
        with all of them, and only with the first of them to its own bucket."""
        keys, nodes, held, turn = [], [], 0, 0
        for b in batches:
            for _, _, data, at in blocks(b.column("text")):
                for x in shingles(data, at, words, seed):
                    if len(x):
                        node = numbered(fingerprint(x), moved)
                        for s, less in signatures(x, percent):
                            keys.append(s)
                            nodes.append((len(s), node + less))
                            held += len(s)
                if held >= RECORDS:
                    yield from packed(np.concatenate(keys), np.repeat(np.array([v for _, v in nodes], np.uint64), [c for c, _ in nodes]), turn)
                    keys, nodes, held, turn = [], [], 0, turn + 1
        if keys:
            yield from packed(np.concatenate(keys), np.repeat(np.array([v for _, v in nodes], np.uint64), [c for c, _ in nodes]), turn)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (each node with the first of its signature), and the records of signatures that three nodes or more have."""
    for keys, vals in gathered(batches, 1, short=True):
        twice = repeated(keys)
        k, v, begin = _grouped(keys[twice], vals[twice, 0] & ~np.uint64(2))
        hot = np.zeros(len(k), bool)
        flagged = np.unique(keys[(vals[:, 0] & np.uint64(2)) > 0])
        if len(flagged):
            at = np.minimum(np.searchsorted(flagged, k), len(flagged) - 1)
            hot = flagged[at] == k
        lens = np.diff(begin)
        size = np.repeat(lens, lens)
        head = np.repeat(v[begin[:-1]], lens)
        other = (v & ~ROLE) != (head & ~ROLE)
        pair = other & ((head & ROLE) == 0)
        a, b = head[pair] & ~ROLE, v[pair] & ~ROLE
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        many = (size > 2) | hot
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (both[:, 0].copy(), both[:, 1].copy(), k[many], v[many])], ["a", "b", "keys", "nodes"])


def _longs(*names: str) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in names)):
                cols = [np.frombuffer(x, np.int64) for x in r]
                for s in range(0, len(cols[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 100_000]) for c in cols], list(names))

    return run


def _sets(words: int, seed: int) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Goals and set of each node, of equal rows in a task once."""
        seen = set()
        for b in batches:
            nodes = b.column("node").to_pylist()
            b = b.take(pa.array([k for k, node in enumerate(nodes) if node not in seen and not seen.add(node)], pa.int64()))
            for i, j, data, where in blocks(b.column("text")):
                x = list(shingles(data, where, words, seed))
                flat = pa.array(np.concatenate(x).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column("goals").slice(i, j - i), lists], ["goals", "x"])

    return run


def _possible(percent: int) -> "callable":
    def far(a: bytes | None, b: bytes | None) -> int:
        if a is None or b is None:
            return 0
        x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
        return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose sizes and parities allow a link, and how far apart these are."""
        for b in batches:
            n_a, n_b = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            b = b.filter(pa.array(100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)))
            at = np.arange(b.num_rows)
            apart = Parities([*b.column("bits_a").to_pylist(), *b.column("bits_b").to_pylist()]).differ(at, at + len(at))
            apart = np.maximum(apart, [far(x, y) for x, y in zip(b.column("wide_a").to_pylist(), b.column("wide_b").to_pylist())]).astype(np.int64)
            both = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(apart / both)], ["a", "b", "apart"])
            yield out.filter(pa.array(apart * (100 + percent) <= both * (100 - percent)))

    return run


def _pairs(group: np.ndarray, side: np.ndarray, own: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), some at a time, of records of one group whose sizes allow a link. Records are sorted by group, side and size; those of side 0 are
    paired with those of side 1 and, where ``own``, with each other."""
    seg = np.cumsum(np.concatenate([[False], (group[1:] != group[:-1]) | (side[1:] != side[:-1])])) if len(group) else group
    of = (seg << 40) + n
    left, with_own = side == 0, (side == 0) & own
    follows = np.searchsorted(seg, seg + 1)  # where the next side, or the next group, begins
    inner = np.minimum(follows, len(seg) - 1)
    crosses = left & (follows < len(seg)) & (group[inner] == group)
    own_end = np.searchsorted(of, (seg << 40) + n * 100 // percent, "right")
    low = np.searchsorted(of, ((seg + 1) << 40) + -(-n * percent // 100))
    high = np.searchsorted(of, ((seg + 1) << 40) + n * 100 // percent, "right")
    at = np.arange(len(seg))
    for start, end, on in ((at + 1, own_end, with_own), (low, high, crosses)):
        count = np.where(on, np.maximum(end - start, 0), 0)
        total = np.concatenate([[0], np.cumsum(count)])
        first = 0
        while first < len(seg):
            last = max(first + 1, int(np.searchsorted(total, total[first] + (1 << 17), "right")) - 1)
            c = count[first:last]
            i = np.repeat(at[first:last], c)
            yield i, start[i] + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            first = last


def _tiles(percent: int, most: bool) -> "callable":
    """(a, b) of different components in a group whose sizes and parities allow a link. With ``most``, where a group has more such pairs than nodes, of each
    node only the pair that differs least, and a row that has the group's key as ``more``."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        col = lambda c: t.column(c).to_numpy()
        node, n, component, less = col("node"), col("n"), col("component"), col("less")
        group = np.cumsum(np.concatenate([[False], np.any([col(c)[1:] != col(c)[:-1] for c in ("keys", "lo", "hi")], axis=0)]))
        bits, found = Parities(t.column("bits").to_pylist()), [np.zeros((3, 0))]
        for i, j in _pairs(group, col("side"), col("own"), n, percent):
            ok = (component[i] != component[j]) & ~(less[i] & less[j])
            i, j = i[ok], j[ok]
            apart = bits.differ(i, j)
            ok = apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            found.append(np.stack([i[ok], j[ok], (apart / (n[i] + n[j]))[ok]]))
        i, j, apart = np.concatenate(found, axis=1)
        i, j = i.astype(np.int64), j.astype(np.int64)
        more = np.zeros(0, np.int64)
        if most:
            many = np.bincount(group[i], minlength=group[-1] + 1) > np.bincount(group)
            more = np.unique(col("keys")[many[group]])
            far = np.flatnonzero(many[group[i]])
            nearest = []
            for x in (i[far], j[far]):
                order = np.lexsort((apart[far], x))
                nearest.append(far[order[np.concatenate([[True], x[order][1:] != x[order][:-1]])[: len(x)]]])
            stay = np.concatenate([np.flatnonzero(~many[group[i]]), *nearest])
            i, j = i[stay], j[stay]
        both = np.unique(np.sort(np.stack([node[i], node[j]], axis=1), axis=1), axis=0)
        none = pa.nulls(len(both), pa.int64()), pa.nulls(len(more), pa.int64())
        cols = [pa.concat_arrays([pa.array(both[:, k].copy()), none[1]]) for k in (0, 1)] + [pa.concat_arrays([none[0], pa.array(more)])]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted; those that are whole are taken some thousand rows at a time."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 1 << 14:
                keys = np.any([(x := held.column(c).to_numpy())[1:] != x[:-1] for c in ("keys", "lo", "hi")], axis=0)
                cut_ = int(np.flatnonzero(keys)[-1]) + 1 if keys.any() else 0
                if cut_:
                    yield pairs(held.slice(0, cut_))
                    held = held.slice(cut_).combine_chunks()
        if held is not None and held.num_rows:
            yield pairs(held)

    return run


def _intersected(percent: int) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Linked pairs: of each (a, chunk) the set of a comes first, then those of its partners."""
        key, hub = None, None
        for batch in batches:
            a, chunk, leaf, x = (batch.column(c) for c in ("a", "chunk", "b", "x"))
            out = []
            for k in range(batch.num_rows):
                this = np.asarray(x[k].values)
                if not leaf[k].is_valid:
                    key, hub = (a[k].as_py(), chunk[k].as_py()), this
                    continue
                assert key == (a[k].as_py(), chunk[k].as_py())
                both = len(this) + len(hub) - len(np.union1d(this, hub))
                if 100 * both >= percent * (len(this) + len(hub) - both):
                    out.append((key[0], leaf[k].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, uid, doc_id, text): the rows of ``docs`` as structs and as ``links`` takes them."""
    return identified(batched(docs), doc_id, text).select("row", "uid", F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].alias("text"))


def links(rows: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): a row per row of ``rows`` (doc_id, uid, text; see ``known``) with doc_id, uid, n and node; and each node's component, by number and by the smallest doc_id in it.

    A-Z is lower-cased; sets are of shingles of ``words`` words of whole texts, of all words where they are fewer, and
    empty sets link with nothing. Two rows are linked if 100 * intersection >= percent * union. Rows with one set are one node.

    1. Sets, as 128-bit fingerprints: rows with one set become one node.
    2. Signatures (see ``signatures``) meet in packets. Each node is a candidate with the first node of its signature, and candidates are
       verified on whole sets; so near copies fall into one component by as many pairs as there are copies and signatures.
    3. Of signatures that three or more nodes have, those with several components are left. In tiles, their nodes of different components are compared by
       size and parities inside a task. Where more pairs may be linked than there are nodes, each node is a candidate with the nearest one only: that
       joins most of what step 2 left apart.
    4. Signatures that step 3 has cut short, or split into several tiles, and that still have several components, are compared in full, tile by tile. Every
       linked pair shares a signature, so it has been verified or joined by others: no component is missed.
    Should different sets have one node number (62 bits), those few get another one, from their fingerprints' other half; rows are told apart by 128 bits
    (see ``identified``). Null ids are no smallest ids; extra columns are ignored.
    """
    spark, rows = rows.sparkSession, rows.select("doc_id", "uid", "text")
    thin = cut(rows.mapInArrow(_thin(words, seed), f"doc_id {dict(rows.dtypes)['doc_id']}, uid long, n long, node long, check long, bits binary, wide binary"))

    def sets_of(thin: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes, and the numbers that several of them have."""
        same = thin.where("n > 0").groupBy("node", "n", "check")
        nodes = cut(same.agg(F.min("doc_id").alias("least"), F.min_by(F.struct("uid", "bits", "wide"), "uid").alias("x")).select("node", "n", "check", "least", "x.*"))
        return nodes, cut(nodes.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").select("node", F.lit(True).alias("shared")))

    nodes, shared = sets_of(thin)
    moved = frozenset(r.node % 2**64 for r in shared.limit(SHARED + 1).select("node").collect())  # a few, see SHARED
    if moved:
        free = F.when(F.col("shared"), F.col("check").bitwiseAND(F.lit(-4))).otherwise(F.col("node"))
        thin = cut(thin.join(small(shared), "node", "left").withColumn("node", free).drop("shared"))
        nodes, shared = sets_of(thin)
        if len(moved) > SHARED or not shared.isEmpty():
            raise ValueError("too many sets for numbers of 62 bits")
    count = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("elements")).first()
    n, many = buckets(rows, count["elements"] * (100 - percent) * 2 // percent, 2)
    signed = exchanged(rows.mapInArrow(_signed(words, percent, seed, many, moved), KIND), n)
    met = cut(signed.mapInArrow(_met, "a binary, b binary, keys binary, nodes binary"))

    def possible(pairs: DataFrame) -> DataFrame:
        """(a, b, apart) of pairs that may be linked by size and parities."""
        ends = trim(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        ends = pick(nodes.select("node", "n", "bits", "wide"), ends, "node")
        for side in ("a", "b"):
            pairs = pairs.join(ends.withColumnsRenamed({"node": side} | {c: f"{c}_{side}" for c in ("n", "bits", "wide")}), side)
        return pairs.mapInArrow(_possible(percent), "a long, b long, apart double")

    def exact(pairs: DataFrame) -> DataFrame:
        """Pairs that are linked. The sets of b's go to those of a's, LEAVES at a time, from the texts again, and are intersected."""
        pairs = trim(pairs)
        degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEAVES).alias("chunks"))
        pairs = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"))
        goals = pairs.select(F.col("b").alias("node"), "a", "chunk", "b").union(pairs.select(F.col("a"), "a", "chunk", F.lit(None).cast("long")).distinct())
        goals = goals.coalesce(ceil(max(pairs.count(), 1) / TRIM)).groupBy("node").agg(F.collect_list(F.struct("a", "chunk", "b")).alias("goals"))
        needed = trim(pick(nodes.select("node", "uid", "n"), trim(goals), "node"))
        sent = needed.agg(F.sum(F.col("n") * F.size("goals"))).first()[0] or 0
        sets = pick(rows.select("uid", "text"), needed.select("uid", "node", "goals"), "uid").select("node", "goals", "text")
        sets = sets.mapInArrow(_sets(words, seed), "goals array<struct<a:long, chunk:int, b:long>>, x array<long>").select(F.explode("goals").alias("goal"), "x").select("goal.*", "x")
        dealt = sets.repartition(partitions(spark, 8 * sent), "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
        return trim(dealt.mapInArrow(_intersected(percent), "a long, b long").distinct())

    def grown(parts: DataFrame, found: DataFrame) -> DataFrame:
        """Components by the stars of those so far and the new links."""
        return parts if found.isEmpty() else trim(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)))

    def marked(table: DataFrame, node: str, into: str) -> DataFrame:
        return table.join(small(parts).select(F.col("node").alias(node), F.col("component").alias(into)), node, "left").withColumn(into, F.coalesce(into, node))

    def apart(pairs: DataFrame) -> DataFrame:
        return marked(marked(pairs, "a", "x"), "b", "y").where("x <> y").select("a", "b")

    def tiled(left: DataFrame, most: bool) -> DataFrame:
        """Candidates among records with keys, lo, hi, side and own."""
        left = left.join(nodes.select("node", "n", "bits"), "node").select("keys", "lo", "hi", "side", "own", "node", "n", "component", "less", "bits")
        left = left.repartition(partitions(spark, 200 * size), "keys", "lo", "hi").sortWithinPartitions("keys", "lo", "hi", "side", "n")
        return trim(left.mapInArrow(_tiles(percent, most), "a long, b long, more long").distinct())

    stars = met.select("a", "b").mapInArrow(_longs("a", "b"), "a long, b long").distinct()
    stars = trim(possible(stars))
    first = stars.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")
    parts = trim(components(exact(first)))
    records = met.select("keys", "nodes").mapInArrow(_longs("keys", "nodes"), "keys long, nodes long")
    records = cut(records.select("keys", (F.col("nodes").bitwiseAND(F.lit(-2))).alias("node"), (F.col("nodes") % 2 != 0).alias("less")).distinct())
    size = records.count()
    tiles = lambda x: F.ceil(x / TILE).cast("int")
    deal = lambda x: F.pmod(F.xxhash64("node"), x).cast("int")
    large = trim(records.groupBy("keys").agg(F.count("*").alias("k")).where(f"k > {TILE}").select("keys", tiles(F.col("k")).alias("tiles")))
    left = marked(records, "node", "component").join(small(large), "keys", "left").withColumn("lo", deal(F.coalesce("tiles", F.lit(1))))
    near = tiled(left.select("*", F.lit(0).alias("hi"), F.lit(0).alias("side"), F.lit(True).alias("own")), True)
    pairs = possible(near.where("more is null").select("a", "b")).select("a", "b").union(apart(stars.select("a", "b"))).distinct()
    parts = grown(parts, exact(pairs))
    # in full: signatures of which step 3 has not sent all pairs, and those of several tiles
    keys = trim(near.where("more is not null").select(F.col("more").alias("keys")).union(large.select("keys")).distinct())
    left = cut(marked(records.join(small(keys), "keys", "left_semi"), "node", "component"))
    mixed = left.groupBy("keys", "component").agg(F.count("*").alias("k")).groupBy("keys")
    mixed = mixed.agg(F.sum("k").alias("k"), F.max("k").alias("m"), F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("several")).where("several > 1")
    left = left.join(small(trim(mixed.select("keys", "main", tiles(F.col("k") - F.col("m")).alias("tiles"), tiles(F.col("m")).alias("rest")))), "keys")
    # nodes of a signature's largest component need no comparison with each other: their tiles come after the others', and only meet those
    left = left.withColumn("tile", F.when(F.col("component") == F.col("main"), F.col("tiles") + deal(F.col("rest"))).otherwise(deal(F.col("tiles"))))
    as_lo = "case when tile < tiles then transform(sequence(tile + 1, tiles + rest - 1), x -> struct(tile as lo, x as hi, 0 as side, x = tiles as own)) end"
    as_hi = "case when tile > 0 then transform(sequence(0, least(tile, tiles) - 1), x -> struct(x as lo, tile as hi, 1 as side, false as own)) end"
    left = left.select("*", F.explode(F.expr(f"flatten(filter(array({as_lo}, {as_hi}), x -> x is not null))")).alias("x")).select("*", "x.*")
    pairs = possible(tiled(left, False).select("a", "b")).select("a", "b")
    parts = grown(parts, exact(pairs))
    joined = cut(nodes.select("node", "least").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = cut(joined.join(least, "component").select("node", "component", "component_id"))
    return thin.select("doc_id", "uid", "n", "node"), classes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; a row without words, or of null id alone, is its own component. See ``links``."""
    rows, classes = links(known(docs.select(doc_id, text), doc_id, text), words, percent)
    found = rows.where("n > 0").join(classes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(rows.where("n = 0").select("doc_id", F.col("n"), F.col("doc_id")))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``: that of its smallest id, null ids last. A component is one whatever ids its rows have, so rows that
    share an id, or have none, stay each for its own component; a row that stays and its repeats (id and text) are one. Rows without words all stay."""
    every = known(docs, doc_id, text)
    rows, classes = links(every, words, percent)
    found = rows.where("n > 0").join(classes, "node")
    stay = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("x"))
    stay = cut(stay.select(F.col("x.uid").alias("uid")).distinct())
    bare = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kept = every.where(~bare).join(stay, "uid", "left_semi").dropDuplicates(["uid"])
    return kept.select("row").unionByName(every.where(bare).select("row")).select("row.*")
