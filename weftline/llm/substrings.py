"""Removal of word runs that stand elsewhere too: recompression names runs and pairs, shared symbols reveal long repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.exchange import KIND, exchanged, gathered, packets, repeated, split_repeats
from weftline.llm.identity import identified
from weftline.llm.store import batched
from weftline.llm.words import blocks, hashed, mix, powers

WINDOW = 35
#: Records that a task holds before it sends them.
RECORDS = 1 << 20


def reach(window: int) -> tuple[int, int, int]:
    """(rounds, words on either side that settle a boundary and the symbols about it, words on either side that these symbols lie in) that a window allows.

    A round of runs joins exactly two equal neighbours: whether it does depends on two words on either side, and symbols
    are two words at most. Each round of pairs doubles the words of a symbol and adds the words of one to what settles a boundary. The symbols about a
    boundary are those wholly within one and a half times the longest symbol. A window needs a boundary in its settled middle: more words there than a symbol can have.
    """
    found, rounds, side, span = (0, 0, 0), 1, 2, 2
    while window - 2 * (side + span * 3 // 2) + 1 > span:
        found = rounds, side + span * 3 // 2, span * 3 // 2
        rounds, side, span = rounds + 1, side + span, 2 * span
    return found


def boundaries(h: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word and name of every symbol after some rounds, of texts that begin at words ``first``.

    A name is a hash of what it stands for, so equal runs and pairs have one name in all tasks without a common dictionary.
    Round 1 names runs: of exactly two equal words. Later rounds name pairs: a bit of each name's hash, new each round, says
    whether it may stand left or right in a pair.
    """
    at, name = np.arange(len(h)), h
    begin = np.zeros(len(h) + 1, bool)
    begin[first] = True
    for r in range(rounds):
        inner = ~begin[at[1:]]
        if r == 0:
            join = (name[1:] == name[:-1]) & inner
            longer = join[1:] & join[:-1]
            join[1:] &= ~longer
            join[:-1] &= ~longer
        else:
            side = (mix(name, 100 + r) >> np.uint64(63)).astype(bool)
            join = ~side[:-1] & side[1:] & inner
        left = np.flatnonzero(join)
        name = name.copy()
        name[left] = mix(name[left] * np.uint64(0x9E3779B97F4A7C15) + name[left + 1], 200 + r)
        keep = np.ones(len(name), bool)
        keep[left + 1] = False
        at, name = at[keep], name[keep]
    return at, name


def _running(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each n neighbours, by doubling."""
    f, done = (np.minimum if least else np.maximum), 1
    while done < n:
        step = min(done, n - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def spans(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row: a sum of hashes times powers, in Horner's way by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    p = 0xC2B2AE3D27D4EB4F
    out, have, block, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out = block
            else:
                m = min(len(out), len(block) - have)
                out = out[:m] * np.uint64(pow(p, size, 2**64)) + block[have : have + m]
            have += size
        if size * 2 > n:
            return mix(out[: len(h) - n + 1])
        block = block[:-size] * np.uint64(pow(p, size, 2**64)) + block[size:]
        size *= 2


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) by which equal windows know each other: in the settled middle of each window, the symbol boundaries with the least key.

    A key is a hash of the names of the symbols about the boundary, and of where they begin, so two equal windows choose the same places with the same
    keys. Windows too short for that choose every place, with the window's hash as its key.
    """
    rounds, side, about = reach(window)
    n = len(h)
    of = np.zeros(n + 1, np.int64)
    np.add.at(of, first[1:-1], 1)
    of = np.cumsum(of)[:n]
    inside = np.flatnonzero(of[: n - window + 1] == of[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    if not len(inside):
        return inside, np.zeros(0, np.uint64)
    if not rounds:
        return inside, spans(h, window)[inside]
    at, name = boundaries(h, first, rounds)
    top = np.uint64(2**64 - 1)
    value = np.full(n, top)
    lo, hi = np.searchsorted(at, at - about), np.searchsorted(at, at + about, "right") - 1
    up, down = powers(len(at) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(name, 300) * up[: len(at)])])
    key = mix((sums[hi] - sums[lo]) * down[lo] + mix(((at - at[lo]) * 64 + at[hi] - at).astype(np.uint64), 301), 302)
    on = (at >= side) & (at <= n - side)
    value[at[on]] = np.minimum(key[on], top - np.uint64(1))
    wide = window - 2 * side + 1  # places in the middle of a window: side .. window - side
    value = np.concatenate([value, np.full(1, top)])
    least = _running(value, wide, True)[side:]  # of the window that starts at i
    best = np.zeros(n + 1, np.uint64)
    ok = np.zeros(len(least), np.uint64)
    ok[inside] = least[inside]
    # a place is chosen if a window that it is in the middle of has no smaller value
    padded = np.concatenate([np.zeros(wide - 1, np.uint64), ok, np.zeros(wide, np.uint64)])
    over = _running(padded, wide, False)
    m = min(len(over), n + 1 - side)
    best[side : side + m] = over[:m]
    chosen = np.flatnonzero((value == best) & (value != top) & (best != 0))
    return chosen, value[chosen]


def _text(b: pa.RecordBatch, text: str) -> pa.Array:
    return pc.struct_field(b.column("row"), text)


def _texts(b: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, data, at in blocks(_text(b, text)):
        yield i, j, data, *hashed(data, at)


def _records(uid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row and place in 12 bytes."""
    return np.column_stack([uid.view(np.uint32).reshape(-1, 2), at.astype(np.uint32)])


def _owner(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, "right") - 1


def _keyed(text: str, window: int, n: int) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packets of (anchor key; row, place)."""
        for b in batches:
            uid = b.column("uid").to_numpy().view(np.uint64)
            keys, vals = [], []
            for i, j, _, h, _, _, first in _texts(b, text):
                at, key = anchors(h, first, window)
                doc = _owner(first, at)
                keys.append(key)
                vals.append(_records(uid[i:j][doc], at - first[doc]))
            if keys:
                yield from split_repeats(np.concatenate(keys), np.concatenate(vals), n, int(uid[0]))

    return run


def _twice(n: int) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packets of (row; place) of records whose key stands there more than once."""
        held, count = [], 0
        for keys, vals in gathered(batches, 3, np.uint32):
            held.append(vals[repeated(keys)])
            count += len(held[-1])
            if count >= RECORDS:
                yield from _to_rows(np.concatenate(held), n)
                held, count = [], 0
        if held:
            yield from _to_rows(np.concatenate(held), n)

    return run


def _to_rows(records: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    yield from packets(np.ascontiguousarray(records[:, :2]).view(np.uint64)[:, 0], records[:, 2:], n)


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, places), a row for each uid."""
    for uid, place in gathered(batches, 1, np.uint32):
        cuts = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1], [True]]))
        places = [place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(uid[cuts[:-1]].view(np.int64)), pa.array(places, pa.binary())], ["uid", "places"])


def _windowed(text: str, window: int, n: int) -> "callable":
    rounds, side, _ = reach(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packets of (window hash; row, start) of the windows that a repeated anchor is in the middle of."""
        for b in batches:
            uid, places = b.column("uid").to_numpy().view(np.uint64), b.column("places").to_pylist()
            keys, vals = [], []
            for i, j, _, h, _, _, first in _texts(b, text):
                if len(h) < window:
                    continue
                change = np.zeros(len(h) + 2, np.int64)
                for d, p in enumerate(places[i:j]):
                    at = np.frombuffer(p, np.uint32).astype(np.int64)
                    lo = np.maximum(at - (window - side if rounds else 0), 0)
                    hi = np.minimum(at - side if rounds else at, first[d + 1] - first[d] - window)
                    on = lo <= hi
                    np.add.at(change, first[d] + lo[on], 1)
                    np.add.at(change, first[d] + hi[on] + 1, -1)
                at = np.flatnonzero(np.cumsum(change[:-2]) > 0)
                doc = _owner(first, at)
                keys.append(spans(h, window)[at])
                vals.append(_records(uid[i:j][doc], at - first[doc]))
            if keys:
                yield from split_repeats(np.concatenate(keys), np.concatenate(vals), n, int(uid[0]))

    return run


def _removed(text: str, window: int) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is left of each text: (row, n_words, n_removed, kept), kept words joined by one blank."""
        for b in batches:
            texts = _text(b, text).cast(pa.large_string()).cast(pa.large_binary())
            n_words, n_removed, kept = [], [], []
            for t, p in zip(texts, b.column("places").to_pylist()):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                n_words.append(len(words))
                gone = 0
                if p:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.frombuffer(p, np.uint32)).astype(np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    stay = np.cumsum(change[:-1]) <= 0
                    gone = len(words) - int(stay.sum())
                    words = [words[k] for k in np.flatnonzero(stay)]
                n_removed.append(gone)
                kept.append(b" ".join(words))
            cols = [b.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` as a struct ``row``, with n_words, n_removed and kept: the words that no repeated window covers, joined by one blank.

    A window is ``window`` consecutive words of one text, read whole; it is repeated if its words also start anywhere else, in the same text
    too, and windows are judged on the input. Null and empty texts have no words. Rows that repeat an id, or are equal altogether, are texts
    of their own, so equal rows lose all their windows. No rows give no rows.

    Two passes exchange records: names of recompression symbols about chosen boundaries (about one in nine words), then windows around those that are shared. A window's
    own hash decides, so shared symbols alone remove nothing. Records are of fixed size and dealt by hash, in packets; a key sends one record a
    packet to its bucket, and only the row and place of repeated ones go on. Hashes of 64 bits stand for word sequences; rows are told apart by 128 bits (see ``identified``).
    Texts are dealt by row once: all three passes read whole rows, so that Spark finds one exchange in the plan thrice and writes it once.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = identified(batched(docs), doc_id, text).repartition(n, "uid")
    many = n  # a bucket a partition: packets are one a task and bucket at most
    keyed = exchanged(rows.mapInArrow(_keyed(text, window, many), KIND), n)
    shared = exchanged(keyed.mapInArrow(_twice(many), KIND), n).mapInArrow(_by_row, "uid long, places binary")
    seen = exchanged(rows.join(shared, "uid").mapInArrow(_windowed(text, window, many), KIND), n)
    starts = exchanged(seen.mapInArrow(_twice(many), KIND), n).mapInArrow(_by_row, "uid long, places binary")
    whole = rows.join(starts, "uid", "left")
    kind = whole.select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).schema
    for f in kind:
        f.nullable = True
    return whole.mapInArrow(_removed(text, window), kind)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    left = without_repeats(docs.select(doc_id, text), doc_id, text, window)
    return left.select(F.col(f"row.{doc_id}").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, window: int = WINDOW) -> DataFrame:
    """``docs`` with what is left of each text; a text that loses nothing stays as it is. ``n_chars`` names a column with the text's length."""
    left = without_repeats(docs, doc_id, text, window)
    now = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"row.{text}"))
    out = {c: F.col("row")[c] for c in docs.columns} | {text: now} | ({n_chars: F.length(now).cast(dict(docs.dtypes)[n_chars])} if n_chars else {})
    return left.select(*(v.alias(k) for k, v in out.items()))
