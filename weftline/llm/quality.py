"""Supervised subword embeddings that tell good documents from bad ones: hashed n-grams, averaged, softmax, numpy SGD."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import batched, cut, pick
from weftline.llm.words import LOWER, SPACE, blocks, hashed, mix, powers

#: Buckets of hashed n-grams, after a few that stand for one feature each.
OWN, HASHED = 8, 1 << 18
BUCKETS = OWN + HASHED
#: Lengths, in bytes, of character n-grams. They lie within a word, one blank before and after it included.
CHARS = (3, 4)
SAMPLE = 3000


def features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) arrays of all features of a block: words, pairs of words, character n-grams, and one for every text.

    A pair of one word twice is one feature whichever word it is, in a bucket of its own, and so are two places of one word that are two to four,
    or five to eight, words apart: n-grams known by their repetition and not by their words, which hashing can't see.
    """
    yield np.arange(len(at) - 1), np.zeros(len(at) - 1, np.int64)
    lower = LOWER[data]
    h, starts, _, first = hashed(lower, at)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    bucket = lambda x: (x >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64) + OWN
    yield text, bucket(mix(h, 1))
    same = text[1:] == text[:-1]
    yield text[1:][same], np.where(h[1:] == h[:-1], 1, bucket(mix(mix(h[:-1] * np.uint64(3) + h[1:], 2), 3)))[same]
    for gap in range(2, 9):
        again = np.flatnonzero((h[gap:] == h[:-gap]) & (text[gap:] == text[:-gap]))
        yield text[gap:][again], np.full(len(again), 2 + (gap > 4), np.int64)
    n = len(data)
    blank = SPACE[lower]
    signs = np.where(blank, np.uint8(32), data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for size in CHARS:
        if n < size:
            continue
        inner = np.zeros(n - size + 1, bool)
        for k in range(1, size - 1):
            inner |= blank[k : n - size + 1 + k]
        k = np.flatnonzero(~inner & (owner[: n - size + 1] == owner[size - 1 :]))
        yield owner[k], bucket(mix((sums[k + size] - sums[k]) * down[k], 10 + size))


class Model(NamedTuple):
    """What the softmax of two classes makes of one occurrence of each bucket: (output[1] - output[0]) . vector."""

    weight: np.ndarray

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        for text, bucket in features(data, at):
            total += np.bincount(text, self.weight[bucket], len(at) - 1)
            count += np.bincount(text, minlength=len(at) - 1)
        return 1 / (1 + np.exp(-total / count))


class Counts:
    """Distinct buckets of texts and their shares of a text's features; kept compressed and unpacked one text at a time."""

    def __init__(self, packed: list[bytes]) -> None:
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        steps, n = np.frombuffer(zlib.decompress(self.packed[i]), np.int32).reshape(2, -1)
        return np.cumsum(steps), (n / n.sum()).astype(np.float32)

    @staticmethod
    def pack(buckets: np.ndarray, n: np.ndarray) -> bytes:
        return zlib.compress(np.concatenate([np.diff(buckets, prepend=0), n]).astype(np.int32).tobytes(), 1)


def fit(texts: Counts, labels: np.ndarray, dim: int = 8, epochs: int = 4, rate: float = 0.6, seed: int = 0) -> Model:
    """Learn vectors and outputs by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, dim), np.float32) * 2 - 1) / np.float32(dim)
    used = np.zeros(BUCKETS, bool)
    out = np.zeros((dim, 2), np.float32)
    out[:, 1] = 0.01
    shares = np.bincount(labels, minlength=2)[labels] / max(1, len(labels)) if len(labels) else np.zeros(0)
    weigh = np.clip(0.5 / np.maximum(shares, 1e-9), 0.2, 5).astype(np.float32)
    steps, done = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            at, share = texts[i]
            used[at] = True
            lr = np.float32(rate * weigh[i] * (1 - done / steps))
            done += 1
            held = vectors[at]
            hidden = share @ held
            z = hidden @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= lr / 4 * np.outer(hidden, p)
            vectors[at] = held - np.outer(share * (lr * 40), back)
    return Model(np.where(used, vectors @ (out[:, 1] - out[:, 0]), np.float32(0)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each labelled text and how often it has them."""
    for b in batches:
        for i, j, data, at in blocks(b.column("text")):
            text, bucket = (np.concatenate(x) for x in zip(*features(data, at)))
            both, n = np.unique(text * BUCKETS + bucket, return_counts=True)
            row, cuts = both // BUCKETS, np.searchsorted(both // BUCKETS, np.arange(j - i + 1))
            packed = pa.array([Counts.pack(both[x:y] % BUCKETS, n[x:y]) for x, y in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("label").slice(i, j - i), packed], ["doc_id", "label", "packed"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, **more: float) -> Model:
    """Fit on the ``sample`` labelled documents whose ids have the smallest MD5: the one bounded sample that is taken.

    Labels other than 0 and 1, null ids and ids without a document count for nothing; an id with several labels takes the larger. Of
    each chosen text, whole, only its distinct buckets (at most 2**18) and their counts come to the driver, compressed (about 5 KB). Without labels all scores are 0.5.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = cut(known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample))
    chosen = pick(batched(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), known, "doc_id")
    rows = chosen.mapInArrow(_counted, f"doc_id {dict(chosen.dtypes)['doc_id']}, label int, packed binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.packed))
    return fit(Counts([r.packed for r in rows]), np.array([r.label for r in rows], np.int64), **more)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1; higher: good likelier) of each whole text; null and empty texts get that of no words.

    The average of a text's vectors times the output layer is the average of one number a bucket, so scoring looks up
    those (1 MB, broadcast). Other columns pass through; one named like ``into`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.weight)
    kept = batched(docs).drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [Model(sent.value).scores(data, at) for _, _, data, at in blocks(pc.struct_field(b.column("row"), text))]
            out = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("row"), out], ["row", "s"])

    kind = kept.select(F.struct("*").alias("row"), F.lit(0.0).alias("s")).schema
    for f in kind:
        f.nullable = True
    rows = kept.select(F.struct("*").alias("row")).mapInArrow(run, kind)
    return rows.select(*(F.col("row")[c].alias(c) for c in kept.columns), F.col("s").alias(into))
