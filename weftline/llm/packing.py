"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import batched, cut

LIMIT = 2048
#: Pieces that are packed together, islands that search for each such set, and what each island does.
CELL, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 2, 2, 5, 10
#: Generations without a better individual that end an epoch.
STILL = 3
#: Bins of a first round with more room than this are opened again and packed together.
ROOM = 32
#: Bytes of words and their ids that a Python worker keeps at most, and what a word takes besides.
KNOWN, ENTRY = 192 << 20, 170


@lru_cache(2)
def _encoder(path: str) -> tuple:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
    return tokenizer, ends, {}, [0]


def _words(text: bytes) -> list[bytes]:
    """A-Z fall to lower case, as the vocabulary has it, unless that could make a special token of what is none."""
    return (text if b"<|" in text else text.lower()).split()


#: Signs that stand as a token run of their own after letters (no apostrophe: some letters after it belong to it).
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _encoded(tokenizer: "Tokenizer", ends: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of each word. Words of letters alone are one run each, whose last id ends it, so they are encoded in one text."""
    plain = [k for k, w in enumerate(words) if w.isalpha()]
    out: list[bytes | None] = [None] * len(words)
    if plain:
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words[k] for k in plain)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) == len(plain):
            raw, a = ids.tobytes(), 0
            for k, c in zip(plain, (4 * cuts).tolist()):
                out[k] = raw[a:c]
                a = c
    rest = [k for k, x in enumerate(out) if x is None]
    for k, e in zip(rest, tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
        out[k] = array("I", e.ids).tobytes()
    return out


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of texts as little-endian unsigned 32-bit numbers, with the end id 0.

    The vocabulary splits at white space before all else, so a text's ids are those of its words in a row, and each word is
    encoded once. It also splits letters from signs, so letters with signs after them have the ids of both.
    """
    tokenizer, ends, known, held = _encoder(path)
    words = [_words(t) for t in texts]
    missing = [w for w in set().union(*words) if w not in known]
    if missing:
        if held[0] > KNOWN:
            known.clear()
            held[0] = 0
            missing = list(set().union(*words))
        parts = {}
        for w in missing:
            s = w.decode()
            head = s.rstrip(SIGNS)
            parts[w] = (head, s[len(head) :]) if len(head) < len(s) and head.isalpha() and head.lower().isalpha() else (s,)
        new = {p: p.encode() for x in parts.values() for p in x}
        new = {p: e for p, e in new.items() if e not in known}
        known.update(zip(new.values(), _encoded(tokenizer, ends, list(new))))
        for w, x in parts.items():
            if len(x) > 1:
                known[w] = known[x[0].encode()] + known[x[1].encode()]
            held[0] += ENTRY + len(w) + len(known[w])
    return [b"".join([known[w] for w in x]) + b"\0\0\0\0" for x in words]


def _grouped(texts: Iterator[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of whole texts of about ``size`` bytes."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def tokenised(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: one piece, or as many of ``limit`` ids as it needs."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column("text").cast(pa.large_string()).cast(pa.large_binary()))
            for d, ids in zip(b.column("doc_id").to_pylist(), (i for g in _grouped(texts) for i in token_ids(g, path))):
                for p, a in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[a : a + 4 * limit]
                    for c, v in zip(out, (d, p, a // 4, len(part) // 4, zlib.crc32(part), part)):
                        c.append(v)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[: len(names)], types)], names)

    return batched(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kind)


class Bins:
    """Bins under best fit: the fullest bin that an item still fits in takes it."""

    def __init__(self, lengths: list[int], limit: int) -> None:
        self.lengths, self.limit, self.rooms, self.items = lengths, limit, [], []

    def keep(self, items: list[int]) -> None:
        insort(self.rooms, (self.limit - sum(self.lengths[i] for i in items), len(self.items)))
        self.items.append(items)

    def exchange(self, loose: list[int]) -> list[int]:
        """Fill kept bins better: one item of each goes for the largest loose one that there is room for instead. What is loose then."""
        lengths = self.lengths
        held = sorted((lengths[i], i) for i in loose)
        rooms = []
        for room, b in self.rooms:
            best = None
            for i in self.items[b] if room else ():
                at = bisect_left(held, (lengths[i] + room + 1, -1)) - 1
                if at >= 0 and (gain := held[at][0] - lengths[i]) > 0 and (best is None or gain > best[0]):
                    best = gain, at, i
            if best:
                gain, at, i = best
                self.items[b] = [x for x in self.items[b] if x != i] + [held.pop(at)[1]]
                insort(held, (lengths[i], i))
                room -= gain
            if room:
                rooms.append((room, b))
        self.rooms = sorted(rooms)
        return [i for _, i in held]

    def add(self, items: list[int]) -> None:
        """Largest first."""
        rooms, held, lengths = self.rooms, self.items, self.lengths
        for i in sorted(items, key=lambda i: -lengths[i]):
            need = lengths[i]
            at = bisect_left(rooms, (need, -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
                held[b].append(i)
            else:
                room, b = self.limit, len(held)
                held.append([i])
            if room > need:
                insort(rooms, (room - need, b))


def _fit(bins: list[list[int]], lengths: list[int], limit: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the sum of squared fills, so that what room there is lies together."""
    return -len(bins), sum((sum(lengths[i] for i in b) / limit) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], limit: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject whole well-filled bins of ``b`` into ``a``, drop the bins of ``a`` that hold any of their items, best-fit what that displaces.

    Some of the worst-filled other bins are opened too (mutation), and before best fit loose items go for smaller ones of kept bins.
    """
    fills = np.array([sum(lengths[i] for i in x) for x in b])
    good = np.argsort(-fills, kind="stable")[: max(1, len(b) // 2)]
    chosen = [b[k] for k in rng.choice(good, size=max(1, len(good) // 4), replace=False)]
    inside = {i for x in chosen for i in x}
    child, loose = Bins(lengths, limit), []
    for x in chosen:
        child.keep(list(x))
    rest = []
    for x in a:
        if inside.isdisjoint(x):
            rest.append(x)
        else:
            loose += [i for i in x if i not in inside]
    rest.sort(key=lambda x: -sum(lengths[i] for i in x))
    kept = len(rest) - max(1, len(rest) // 20)
    for x in rest[kept:]:
        loose += x
    for x in rest[:kept]:
        child.keep(list(x))
    child.add(child.exchange(loose))
    return child.items


def evolve(population: list[list[list[int]]], lengths: list[int], limit: int, rng: np.random.Generator, size: int, generations: int) -> list[list[list[int]]]:
    """Individuals after some generations, best first; an island without any begins with best fit, largest first and nearly so.

    An individual with as few bins as the sum of lengths allows ends the search, and so do STILL generations that find none with fewer.
    """
    least = -(-sum(lengths) // limit)
    while len(population) < size:
        noise = rng.normal(1, 0.03 * len(population), len(lengths))
        bins = Bins(lengths, limit)
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * noise[i])
        for i in order if population else [order]:
            bins.add([i] if population else i)
        population.append(bins.items)
        if len(bins.items) == least:
            break
    population = sorted(population, key=lambda x: _fit(x, lengths, limit), reverse=True)[:size]
    still, best = 0, len(population[0])
    for _ in range(generations):
        still = 0 if len(population[0]) < best else still + 1
        best = len(population[0])
        if best == least or len(population) < 2 or still > STILL:
            break
        i, j = sorted(rng.choice(len(population), 2, replace=False))
        population.append(crossover(population[i], population[j], lengths, limit, rng))
        population.append(crossover(population[j], population[i], lengths, limit, rng))
        population = sorted(population, key=lambda x: _fit(x, lengths, limit), reverse=True)[:size]
    return population


def _coded(bins: list[list[int]], n: int) -> list[int]:
    """The bin of each of n items."""
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tolist()


def _bins(of: list[int]) -> list[list[int]]:
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(of))[:-1])] if len(of) else []


STATE = "cell long, island int, lengths array<int>, population array<array<int>>"


def _epoch(limit: int, size: int, generations: int, epoch: int) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cell, island, lengths, population = (b.column(c)[r].as_py() for c in ("cell", "island", "lengths", "population"))
                best = evolve([_bins(c) for c in population], lengths, limit, np.random.default_rng([epoch, cell, island]), size, generations)
                best = pa.array([[_coded(x, len(lengths)) for x in best]], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(r, 1) for c in ("cell", "island", "lengths")), best], ["cell", "island", "lengths", "population"])

    return run


def _round(items: DataFrame, n: int, limit: int, islands: int, epochs: int, size: int, generations: int, cell: int) -> DataFrame:
    """``items`` (key, length) with cell and bin. Each epoch an island's best individual moves to the next island of its cell."""
    cells = -(-n // cell)
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("long"))
    packed = dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("x"))
    packed = cut(packed.select("cell", F.col("x.key").alias("keys"), F.col("x.length").alias("ls")))
    state = packed.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("ls").alias("lengths"), F.expr("cast(array() as array<array<int>>)").alias("population"))
    state = state.repartition(min(cells * islands, 4096), "cell", "island")
    for e in range(epochs):
        state = state.mapInArrow(_epoch(limit, size, generations, e), STATE)
        if e < epochs - 1 and islands > 1:
            state = cut(state)
            elite = state.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("population", 1, 1).alias("elite"))
            state = state.join(elite, ["cell", "island"]).select("cell", "island", "lengths", F.concat("elite", "population").alias("population"))
    found = state.select("cell", F.element_at("population", 1).alias("bins"))
    found = found.groupBy("cell").agg(F.min_by("bins", F.struct(F.array_max("bins"), F.col("bins"))).alias("bins"))
    each = packed.join(found, "cell").select("cell", F.explode(F.arrays_zip("keys", "ls", "bins")).alias("x"))
    return each.select(F.col("x.keys").alias("key"), F.col("x.ls").alias("length"), "cell", F.col("x.bins").alias("bin"))


def pack(pieces: DataFrame, limit: int = LIMIT, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS, room: int = ROOM) -> DataFrame:
    """``pieces`` (with a length of 1 to ``limit``) with sequence_id and offset (gapless from 0) columns, which replace columns of these names; others stay as they are.

    Full pieces are sequences by themselves. The others are dealt by hash to cells of about ``cell`` pieces, each of which is packed by
    its islands; then the bins that were left with more than ``room`` free, and the last bins of all cells, are opened and packed again in
    cells of their own. A task holds one cell's lengths. Repeated pieces are packed like any others; no pieces give no rows.
    """
    spark = pieces.sparkSession
    rows = cut(pieces.select(F.struct(*pieces.columns).alias("row"), F.monotonically_increasing_id().alias("key")))
    items = rows.where(F.col("row.length") < limit).select("key", F.col("row.length").cast("int").alias("length"))
    n = items.count()
    got = None
    if n:
        got = cut(_round(items, n, limit, islands, epochs, population, generations, cell))
        if n > cell:
            fill = got.groupBy("cell", "bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < limit - room).select("cell", "bin")
            open_ = cut(got.join(fill, ["cell", "bin"]))
            m = open_.count()
            if m:
                again = _round(open_.select("key", "length"), m, limit, islands, epochs, population, generations, cell)
                again = again.withColumn("cell", -F.col("cell") - 1)
                got = cut(got.join(fill, ["cell", "bin"], "left_anti").select("key", "length", "cell", "bin").unionByName(again))
    else:
        got = spark.createDataFrame([], "key long, length int, cell long, bin int")
    number = F.when(F.col("bin").isNotNull(), F.col("cell") * 65536 + F.col("bin")).otherwise(F.col("key") + F.lit(1 << 61))
    got = got.groupBy("cell", "bin").agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("x"))
    got = got.withColumn("x", F.expr("transform(x, (a, i) -> struct(a.key as key, aggregate(slice(x, 1, i), 0L, (s, y) -> s + y.length) as `offset`))"))
    got = got.select("cell", "bin", F.explode("x").alias("x")).select("cell", "bin", "x.key", "x.offset")
    out = rows.join(got, "key", "left").select("row", number.alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))
    return out.select(*(F.col("row")[c].alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")), "sequence_id", "offset")
