"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(e, scale=256):
    return [int(np.clip(np.floor(scale * float(np.float32(x))), -(2.0**63), 2.0**63 - 1025)) if abs(x) > 1e15 else int(np.floor(scale * float(np.float32(x)))) for x in e]


def brute(rows, anchor, k=5, percent=80):
    usable = [(i, whole(e), l) for i, e, l in rows if i is not None and e is not None and l is not None and all(v is not None and np.isfinite(v) for v in e)]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, e, l in usable:
        if anchor(i):
            scored = [(-dot(e, f), j, m) for j, f, m in usable]
            pos = sorted((s, j) for s, j, m in scored if m == l and j != i)[:k]
            for s, j in pos:
                neg = sorted((t, n) for t, n, m in scored if m != l and percent * -s <= 100 * -t <= 100 * -s)[:k]
                out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(neg)]
    return sorted(out)


def clustered(n, dim=8, seed=0, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    x = (centres[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, dim))).astype(np.float32)
    return [(int(i), x[i].tolist(), int(l)) for i, l in enumerate(r.integers(0, labels, n))]


def mined(spark, rows, **options):
    return sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id % 10 = 0", **options).collect()))


@pytest.mark.parametrize("sample, pivots, segment", [(64, 6, 16), (2048, 48, 1024)])
def test_as_brute_force(spark, monkeypatch, sample, pivots, segment):
    monkeypatch.setattr(hard_negatives, "SAMPLE", sample)
    rows = clustered(600, seed=sample)
    rows += [(10, None, 1), (20, [float("nan")] * 8, 1), (30, [None] * 8, 1), (40, rows[3][1], None), (None, rows[4][1], 1), (1001, [], 1), (1010, [], 2), (1020, [1.0, -2.0], 3), (1030, [0.0] * 8, 0), (1040, rows[0][1], 99)]
    rows += [(2000 + i, rows[7][1], i % 2) for i in range(100)] + [rows[50], rows[50], (50, rows[70][1], 2)]  # one vector often, one id over several rows
    want = brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, pivots=pivots, segment=segment, together=32) == want
    assert len(want) > 300 and {w[2] for w in want} == {1, 2, 3, 4, 5}


def test_ties_go_to_smaller_ids_and_few_rows_give_all(spark):
    same = [(i, [1.0, 0.0], 1) for i in range(10, 17)] + [(i, [1.0, 0.0], 2) for i in range(1, 8)]
    assert mined(spark, same) == brute(same, lambda i: i % 10 == 0)
    few = [(0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.9, 0.5], 2), (3, [-1.0, 0.0], 2)]
    got = mined(spark, few)
    assert got == brute(few, lambda i: i % 10 == 0) and len(got) == 1
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]) == []  # a negative positive score leaves no band


def test_scores_beyond_64_bits(spark):
    rows = [(0, [3e38, 1.0], 0), (1, [3e38, 2.0], 0), (2, [3e38, 0.0], 1), (3, [-3e38, 5.0], 1), (4, [1e10, 1.0], 0), (5, [1e10, 1.0], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_clashing_columns_and_no_rows(spark):
    rows = clustered(60, seed=5)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("uid", "pivot", "key", "terms", "rank", "segment")})
    got = sorted(map(tuple, hard_negatives.mine(df, "vec_id % 10 = 0").collect()))
    assert got == brute(rows, lambda i: i % 10 == 0)
    none = hard_negatives.mine(df.limit(0), "vec_id % 10 = 0")
    assert none.collect() == [] and none.columns == hard_negatives.mine(df, "vec_id = -1").columns
    assert hard_negatives.mine(df, "vec_id = -1").collect() == []
