import random
from collections import Counter

import pytest

from weftline.llm import mixing


def documents(seed):
    r = random.Random(seed)
    return [(i, None if r.random() < 0.05 else "w " * r.randrange(0, 60), r.choice(["a", "a", "a", "b", "c", "é", "Z", None]), 5) for i in range(400)] + [(900, "x y z", "alone", 1), (900, "x y z", "alone", 1), (None, "n n", "a", 1)]


SCHEMA = "doc_id long, text string, source string, start long"


def goal(rows):
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(size.values()), set(names), {}
    while free:
        f = left / sum(w[s] for s in free)
        over = {s for s in free if f * w[s] > 2 * size[s]}
        for s in over or free:
            out[s] = 2.0 * size[s] if over else f * w[s]
        left -= sum(out[s] for s in over)
        free = free - over if over else set()
    return size, out


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_are_met_and_blocks_disjoint(spark, seed):
    rows = documents(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    plan, pieces = mixing.mix(docs, block=64, shard_blocks=4)
    got = mixing.digest(plan, pieces).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.digest(*mixing.mix(docs.repartition(5), block=64, shard_blocks=4)).collect()))
    size, target = goal(rows)
    source = {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert pieces.groupBy("shard").count().count() > 3
    out = mixing.mixed(docs, block=64, shard_blocks=4).collect()
    words = Counter()
    for r in out:
        words[r.source] += len((r.text or "").split())
    assert all(abs(words[s] - target[s]) <= 0.5 for s in target)


def test_shards_hold_every_block_once(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 3), (3, 0), (4, 517)], "source long, n long")
    got = mixing.shards(quotas, 700).collect()
    assert len(got) == 1520 == len({(r.source, r.block) for r in got}) and max(Counter(r.shard for r in got).values()) <= 3


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.digest(*mixing.mix(none)).collect() == [] and mixing.mixed(none).collect() == []
