"""Token ids of a corpus in grammar-compressed files: Re-Pair over blocks of ids, with expansion lengths for random access.

A file is a Parquet folder; each row is a block of whole documents of one shard, and shards and blocks follow ascending doc_id:

| column | what |
| --- | --- |
| shard, block, n_ids | place of the block, and ids in it |
| docs | of each document: doc_id, its first symbol, ids before it in the block, its ids |
| base | ids below it stand for themselves, base + k for rule k |
| rules | two little-endian unsigned 32-bit symbols a rule, each an id or an earlier rule |
| spans | ids that a rule stands for, a little-endian unsigned 32-bit number each |
| symbols | the block's sequence, little-endian unsigned 32-bit |
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.store import batched, partitions, stage
from weftline.llm.words import powers

#: Ids of a block, unless one document has more.
BLOCK = 1 << 19
#: A pair must come so often to get a rule; rounds end at the latest after so many, or when one replaces less than this share of symbols.
LEAST, ROUNDS, SHARE = 8, 24, 0.01
#: Bytes of pieces and their ids that a Python worker keeps at most, and what a piece takes besides.
KNOWN, ENTRY = 256 << 20, 170
#: Bytes of text for each shard, where the session's partitions would hold more.
SHARD = 64 << 20

#: Bytes of text whose pieces are looked at together; a longer text by itself.
GROUP = 1 << 20
#: Kinds of ASCII signs that the vocabulary's pattern keeps in runs: letters, digits, other printable ones. The apostrophe may belong to what follows.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[48:58] = 1, 2
_KIND[[x for x in range(0x21, 0x7F) if not _KIND[x]]] = 3
_KIND[ord("'")] = 4
#: First bytes of what is no white space, ASCII or not, for certain.
_SOLID = np.ones(256, bool)
_SOLID[[*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_WHITE = re.compile(rb"[\x00-\x20\xc2\xe1-\xe3]")
_T = np.random.default_rng(9).integers(1, 2**63, (2, 256), dtype=np.uint64)


def _cuts(b: np.ndarray) -> np.ndarray:
    """Bytes of a text at which a piece begins whose ids don't depend on what stands before: single spaces before what is no white space, changes between
    runs of ASCII letters, digits and signs, and a line end alone between printable ASCII signs, with what follows it."""
    kind = _KIND[b]
    cut = np.zeros(len(b), bool)
    cut[:-1] = (b[:-1] == 0x20) & _SOLID[b[1:]]
    cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (kind[:-1] < 4) & ~((kind[:-1] == 3) & (kind[1:] == 4))
    line = np.flatnonzero((b[1:-1] == 0x0A) & (kind[:-2] > 0) & (kind[2:] > 0)) + 1
    cut[line] = cut[line + 1] = True
    return cut


class Encoder:
    """Ids of whole texts by a byte-level vocabulary, each piece encoded once: a text's ids are those of its pieces in a row.

    The pieces of a group of texts are told apart by two 64-bit hashes and known by their bytes. Texts that hold an added token, which is looked for
    before all else, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.size = 1 + max(vocab.values())
        self.begins = np.zeros(self.size, bool)  # tokens that begin with a space, written as this letter
        self.begins[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.line = vocab["Ċ"]
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Make sure that all of ``new`` are known. Pieces without other white space are encoded a thousand in one text, and parted where a token begins with a space or is a line end."""
        if self.held > KNOWN:
            self.known.clear()
            self.held = 0
        new = list(set(new).difference(self.known))
        plain = [r for r in new if not _WHITE.search(r, 1)]
        for part, mark in [(x[i : i + 1000], m) for x, m in (([r for r in plain if r[0] == 0x20], b""), ([r for r in plain if _SOLID[r[0]]], b"\n")) for i in range(0, len(x), 1000)]:
            ids = np.frombuffer(self._whole([mark.join(part)])[0], np.uint32)
            cuts = np.flatnonzero(ids == self.line if mark else self.begins[ids])
            first, last = (np.append(0, cuts + 1), np.append(cuts, len(ids))) if mark else (cuts, np.append(cuts[1:], len(ids)))
            if len(first) == len(part):
                raw = ids.tobytes()
                self.known.update(zip(part, (raw[a:z] for a, z in zip((4 * first).tolist(), (4 * last).tolist()))))
        rest = [r for r in new if r not in self.known]
        self.known.update(zip(rest, self._whole(rest)))
        self.held += ENTRY * len(new) + sum(map(len, new)) + sum(map(len, map(self.known.__getitem__, new)))

    def _joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, each with the end id 0, and where each text's ids end."""
        raw = b"\0".join([*texts, b""])  # nothing is cut beside this sign, so no text is cut for what another holds
        b, ends = np.frombuffer(raw, np.uint8), np.cumsum([len(t) + 1 for t in texts])
        cut = _cuts(b)
        cut[0] = cut[ends - 1] = cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(b))
        up, down = powers(len(b) + 1)
        hashes = []
        for t in _T:
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(t[b] * up[: len(b)], out=sums[1:])
            hashes.append((sums[stops] - sums[starts]) * down[starts])
        order = np.argsort(hashes[0])
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or(*(h[order[1:]] != h[order[:-1]] for h in hashes))  # what shares one hash alone may be looked up more than once
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        pieces = [raw[a:z] for a, z in zip(starts[first].tolist(), stops[first].tolist())]
        self._learn(pieces)
        ids = list(map(self.known.__getitem__, pieces))
        flat = np.frombuffer(b"".join([*ids, b"\0\0\0\0"]), np.uint32)
        size = np.array(list(map(len, ids)), np.int64) // 4
        begin, n = (np.cumsum(size) - size)[which], size[which]
        mark = np.searchsorted(starts, ends - 1)
        begin[mark], n[mark] = len(flat) - 1, 1
        upto = np.cumsum(n)
        return flat[np.repeat(begin - upto + n, n) + np.arange(int(upto[-1]))], upto[mark]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id 0."""
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        out = dict(zip(whole, (x + b"\0\0\0\0" for x in self._whole([texts[k] for k in whole]))))
        rest = [k for k in range(len(texts)) if k not in out]
        if rest:
            ids, ends = self._joined([texts[k] for k in rest])
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            out.update(zip(rest, (raw[a:z] for a, z in zip([0, *ends], ends))))
        return [out[k] for k in range(len(texts))]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_BITS = 18


def _frequent(symbols: np.ndarray, last: np.ndarray, least: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs that come ``least`` times or more within documents, a slot for each one's pair, and the pair and the count of each slot.

    Pairs are counted by 18 bits of a hash, another one each ``turn``; of those that share a slot one is looked at, so counts are exact.
    """
    keys = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
    slot = ((keys * np.uint64((0x9E3779B97F4A7C15 * (2 * turn + 1)) % 2**64)) >> np.uint64(64 - _BITS)).astype(np.int64)
    slot[last[:-1]] = 1 << _BITS
    count = np.bincount(slot, minlength=(1 << _BITS) + 1)
    count[-1] = 0
    at = np.flatnonzero(count[slot] >= least)
    slot, keys = slot[at], keys[at]
    pair = np.zeros(1 << _BITS, np.uint64)
    pair[slot] = keys
    same = pair[slot] == keys
    at, slot = at[same], slot[same]
    count = np.bincount(slot, minlength=1 << _BITS)
    often = count[slot] >= least
    at, slot = at[often], slot[often]
    return at, slot, pair, count


def _apart(at: np.ndarray, slot: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of overlapping places those whose pair comes more often than both neighbours'; every other one in a run of one symbol."""
    number = np.arange(len(at))
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (at[1:] == at[:-1] + 1) & (slot[1:] == slot[:-1])
    if goes_on.any():
        even = (number - np.maximum.accumulate(np.where(goes_on, 0, number))) % 2 == 0
        at, slot = at[even], slot[even]
    rank = (count[slot] << _BITS) | slot
    touch = at[1:] == at[:-1] + 1
    keep = np.ones(len(at), bool)
    keep[1:] &= ~touch | (rank[1:] > rank[:-1])
    keep[:-1] &= ~touch | (rank[:-1] > rank[1:])
    return at[keep], slot[keep]


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, spans, symbols, first symbol of each document) of ids whose documents end before ``ends``.

    A round gives a rule to every pair that comes often and, where pairs overlap, more often than its neighbours: the most frequent pair that it
    looks at always among them. No pair spans documents.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[ends - 1] = True
    rules, spans = [np.zeros((0, 2), np.uint32)], np.ones(0, np.uint32)
    for turn in range(rounds if len(symbols) > 1 else 0):
        at, slot, pair, count = _frequent(symbols, last, least, turn)
        at, slot = _apart(at, slot, count)
        enough = np.bincount(slot, minlength=1 << _BITS) >= least
        taken = enough[slot]
        at, slot = at[taken], slot[taken]
        if not len(at):
            break
        slots = np.flatnonzero(enough)
        pairs = np.stack([pair[slots] >> np.uint64(32), pair[slots] & np.uint64(2**32 - 1)], 1).astype(np.uint32)
        name = np.zeros(1 << _BITS, np.uint32)
        name[slots] = base + len(spans) + np.arange(len(slots))
        spans = np.append(spans, (_spans(pairs[:, 0], spans, base) + _spans(pairs[:, 1], spans, base)).astype(np.uint32))
        rules.append(pairs)
        symbols[at] = name[slot]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last = symbols[keep], last[keep]
        if len(at) < SHARE * len(symbols):
            break
    return np.concatenate(rules), spans, symbols, np.append(0, np.flatnonzero(last)[:-1] + 1)


def _spans(symbols: np.ndarray, spans: np.ndarray, base: int) -> np.ndarray:
    """Ids that each symbol stands for."""
    out = np.ones(len(symbols), np.int64)
    rule = symbols >= base
    out[rule] = spans[symbols[rule].astype(np.int64) - base]
    return out


def expanded(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: a pass replaces all rules by what they stand for, until none is left."""
    while len(symbols) and (rule := symbols >= base).any():
        out = np.repeat(symbols, 1 + rule)
        at = np.flatnonzero(rule) + np.arange(np.count_nonzero(rule))
        pairs = rules[symbols[rule] - base]
        out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
    return symbols


def between(symbols: np.ndarray, rules: np.ndarray, spans: np.ndarray, base: int, a: int, z: int) -> np.ndarray:
    """Ids ``a`` up to ``z`` of a document's symbols; only symbols that cover some of them are expanded."""
    length = _spans(symbols, spans, base)
    end = np.cumsum(length)
    a, z = max(a, 0), min(z, int(end[-1]) if len(end) else 0)
    if a >= z:
        return np.zeros(0, np.uint32)
    i, j = int(np.searchsorted(end, a, "right")), int(np.searchsorted(end, z, "left")) + 1
    skip = a - int(end[i] - length[i])
    return expanded(symbols[i:j], rules, base)[skip : skip + z - a]


DOCS = "array<struct<doc_id: long, symbol: long, start: long, n_tokens: long>>"
FILE = f"shard int, block int, n_ids long, docs {DOCS}, base long, rules binary, spans binary, symbols binary"
_DOC = pa.struct([("doc_id", pa.int64()), ("symbol", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_FILE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("docs", pa.list_(_DOC)), ("base", pa.int64()), ("rules", pa.binary()), ("spans", pa.binary()), ("symbols", pa.binary())])


def _block(shard: int, number: int, ids: list[bytes], doc_ids: list[int | None], base: int, least: int) -> pa.RecordBatch:
    n = np.array([len(x) // 4 for x in ids], np.int64)
    ends = np.cumsum(n)
    rules, spans, symbols, first = compress(np.frombuffer(b"".join(ids), "<u4"), ends, base, least)
    docs = [dict(doc_id=d, symbol=s, start=e - k, n_tokens=k) for d, s, e, k in zip(doc_ids, first.tolist(), ends.tolist(), n.tolist())]
    row = dict(shard=shard, block=number, n_ids=int(ends[-1]), docs=docs, base=base, rules=rules.astype("<u4").tobytes(), spans=spans.astype("<u4").tobytes(), symbols=symbols.astype("<u4").tobytes())
    return pa.RecordBatch.from_pylist([row], _FILE)


def blocks(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """The rows of a file over ``docs``: every whole text's ids and the end id 0, documents in ascending doc_id, nulls first.

    Rows of one id stand in a row, ordered by a hash of their text and the part of the input that they come from; so an id that holds a third of all rows
    is still spread over shards. A null text is empty and has the end id alone. Other columns take no part. Empty tables give no blocks. A task
    holds a block of about ``block`` ids (a longer document by itself) and 8 MB of texts; texts are shuffled once, to shards by ranges of ids.
    """
    rows = batched(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, SHARD)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("part")]
    shards = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id()).select("shard", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard, number, held, ids, of = encoder(path), 0, 0, 0, [], []
        for b in batches:
            texts = (x.as_buffer().to_pybytes() for x in b.column("text").cast(pa.large_string()).cast(pa.large_binary()))
            shard = b.column("shard")[0].as_py() if b.num_rows else shard
            for d, x in zip(b.column("doc_id").to_pylist(), (i for g in _grouped(texts) for i in known.ids(g))):
                if held and held + len(x) // 4 > block:
                    yield _block(shard, number, ids, of, known.size, least)
                    number, held, ids, of = number + 1, 0, [], []
                held += len(x) // 4
                ids.append(x)
                of.append(d)
        if ids:
            yield _block(shard, number, ids, of, known.size, least)

    return shards.mapInArrow(run, FILE)


def _grouped(texts: Iterator[bytes], size: int = GROUP) -> Iterator[list[bytes]]:
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


def write(docs: DataFrame, path: str, name: str = "token-ids", **options) -> DataFrame:
    """``blocks`` written to the shared folder, and the file as it is read again."""
    return stage(blocks(docs, path, **options), name)


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    symbols, rules, spans = (np.frombuffer(row.get(c, b""), "<u4") for c in ("symbols", "rules", "spans"))
    return symbols, rules.reshape(-1, 2), spans, row["base"]


def starts(file: DataFrame) -> DataFrame:
    """(shard, block, base_start): ids before each block. Blocks are summed within their shard, and only shards, a row each, in one task."""
    each = file.select("shard", "block", "n_ids")
    shards = each.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("all_before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("within", within).join(shards, "shard").select("shard", "block", (F.col("all_before") + F.col("within")).alias("base_start"))


def read(file: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a file, decoded; ids are little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                symbols, rules, _, base = _arrays(row)
                raw, docs = expanded(symbols, rules, base).astype("<u4").tobytes(), row["docs"]
                parts = [raw[4 * d["start"] : 4 * (d["start"] + d["n_tokens"])] for d in docs]
                cols = [pa.array([row[c]] * len(docs), pa.int32()) for c in ("shard", "block")] + [pa.array([d[c] for d in docs], pa.int64()) for c in ("doc_id", "start", "n_tokens")]
                cols += [pa.array([zlib.crc32(p) for p in parts], pa.int64())] + ([pa.array(parts, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(cols, ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    kind = "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    found = batched(file).select("shard", "block", "docs", "base", "rules", "symbols").mapInArrow(run, kind).join(starts(file), ["shard", "block"])
    return found.select("doc_id", (F.col("base_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def read_spans(file: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, first, ids) for ``wanted`` (doc_id, first, length): some ids of some documents, without expanding the rest.

    What lies beyond a document's end is left out; ids that aren't there have no row, null ids match none, repeated requests a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                symbols, rules, spans, base = _arrays(row)
                for w in row["wanted"]:
                    ids = between(symbols[w["symbol"] : w["symbol_end"]], rules, spans, base, w["first"], w["first"] + w["length"])
                    out.append(dict(doc_id=w["doc_id"], first=w["first"], ids=ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())]))

    places = file.select("shard", "block", F.octet_length("symbols").alias("size"), "docs").select("shard", "block", F.expr("transform(docs, (d, i) -> struct(d.doc_id as doc_id, d.symbol as symbol, coalesce(get(docs, i + 1).symbol, size div 4) as symbol_end))").alias("docs"))
    places = places.select("shard", "block", F.inline("docs"))
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("first").cast("long").alias("first"), F.col("length").cast("long").alias("length")).join(places, "doc_id")
    # requests of one block in groups of a bounded number, each of which takes the block's symbols once
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("doc_id", "first", "length"), F.lit(64))).groupBy("shard", "block", "turn").agg(F.collect_list(F.struct("doc_id", "first", "length", "symbol", "symbol_end")).alias("wanted"))
    return batched(asked).join(file.select("shard", "block", "base", "rules", "spans", "symbols"), ["shard", "block"]).drop("turn").mapInArrow(run, "doc_id long, first long, ids binary")
