"""Exchange of many small fixed-size records as a few packed ones: Spark deals the packets, numpy sorts what is in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import partitions

#: Packets of a task are spread over this many times as many buckets as there are partitions.
SPREAD = 4
KIND = "bucket int, keys binary, vals binary"


def short_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys cut to the bucket and 32 bits. Buckets grow in number with the records, so keys that are one thereby stay as rare."""
    return ((((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (keys & np.uint64(2**32 - 1))


def packets(keys: np.ndarray, vals: np.ndarray, buckets: int, short: bool = False) -> Iterator[pa.RecordBatch]:
    """Records dealt to buckets by the high bits of their 64-bit keys; ``vals`` holds a row of numbers for each.

    ``short``: only the low 32 bits of keys are sent, see ``short_keys``.
    """
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, vals = keys[order], vals[order]
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    on = np.flatnonzero(np.diff(cuts))
    keys = keys.astype(np.uint32) if short else keys
    cols = [pa.array(on.astype(np.int32)), *(pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in on], pa.binary()) for x in (keys, vals))]
    yield pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "vals"])


def split_repeats(keys: np.ndarray, vals: np.ndarray, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Packets for finding keys that stand more than once anywhere, where a key may stand in a third of all records.

    Records whose key repeats among these are found already: they go to a bucket below 0 by themselves, and one of them
    goes with the rest to its key's bucket, for the records of other tasks. So a key sends one record a call there.
    """
    order = np.argsort(keys, kind="stable")
    keys, vals = keys[order], vals[order]
    twice = repeated(keys)
    if twice.any():
        cols = [pa.array([-1 - turn % buckets], pa.int32()), *(pa.array([x[twice].tobytes()], pa.binary()) for x in (keys, vals))]
        yield pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "vals"])
    one = np.ones(len(keys), bool)
    one[1:] = keys[1:] != keys[:-1]
    yield from packets(keys[one], vals[one], buckets)


def buckets(df: DataFrame, records: int, width: int) -> tuple[int, int]:
    """(partitions, buckets) for so many records of ``width`` 64-bit values: at most about 64 MB to a partition."""
    n = partitions(df.sparkSession, records * width * 8)
    return n, n * SPREAD


def exchanged(df: DataFrame, n: int) -> DataFrame:
    """Packets by bucket, a bucket whole in one of ``n`` partitions."""
    return df.repartition(n, F.xxhash64("bucket"))


def gathered(batches: Iterator[pa.RecordBatch], width: int, kind: type = np.uint64, short: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (keys, vals) of each bucket of a partition; of buckets below 0 each packet by itself."""
    held: dict[int, list] = {}
    for b in batches:
        for bucket, k, v in zip(b.column("bucket").to_pylist(), b.column("keys").to_pylist(), b.column("vals").to_pylist()):
            if bucket < 0:
                yield np.frombuffer(k, np.uint64), np.frombuffer(v, kind).reshape(-1, width)
            else:
                held.setdefault(bucket, []).append((k, v))
    for bucket in sorted(held):
        parts = held.pop(bucket)
        keys = np.frombuffer(b"".join(k for k, _ in parts), np.uint32 if short else np.uint64)
        keys = keys | np.uint64(bucket << 32) if short else keys
        vals = np.frombuffer(b"".join(v for _, v in parts), kind).reshape(-1, width)
        order = np.argsort(keys, kind="stable")
        yield keys[order], vals[order]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of some sorted keys stand there more than once."""
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        eq = keys[1:] == keys[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    return same
