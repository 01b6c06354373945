import numpy as np

from weftline.llm import embed_dedup, topk


def vectors(n=300, dim=8, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    for i in range(60, 160):
        x[i] = x[i % 7] + r.normal(size=dim).astype(np.float32) * r.choice([0.0, 0.05, 0.1, 0.2])
    rows = [(i, x[i].tolist(), int(i % 3)) for i in range(n)]
    rows += [(900, None, 0), (901, [0.0] * dim, 0), (902, [float("nan")] + [1.0] * (dim - 1), 0), (903, x[0].tolist(), None), (904, [None] * dim, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, (3 * x[0]).tolist(), 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_near_duplicates_as_brute_force(spark):
    rows = vectors()
    rows += [rows[0], (5, rows[70][1], rows[70][2]), (5, rows[0][1], 2), (5, rows[7][1], rows[7][2])]
    got = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=16).collect()))
    unit = {}
    for k, (i, e, l) in enumerate(rows):
        if l is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            v = np.array(e, np.float32).astype(float)
            unit[k] = (l, v / np.linalg.norm(v))
    links = {k: [j for j in unit if j != k and unit[j][0] == unit[k][0] and len(unit[j][1]) == len(unit[k][1]) and unit[j][1] @ unit[k][1] >= 0.98] for k in unit}
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        want.append((i, len(links.get(k, [])), least, least == i))
    assert got == sorted(want)
    assert sum(w[1] for w in want) > 100


def test_bounds_lose_no_pair():
    r = np.random.default_rng(1)
    a = r.normal(size=(200, 64))
    b = a + r.normal(size=a.shape) * 0.2
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    i, j = embed_dedup.linked(a, b, 0.98, False)
    assert set(zip(i, j)) == set(zip(*np.nonzero(a @ b.T >= 0.98)))


def test_top_k_as_brute_force(spark):
    rows = vectors(seed=2)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id % 20 = 0", k=5, block=32).collect()
    terms = {i: np.floor(1024 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in rows if e is not None and all(v is not None and np.isfinite(v) for v in e)}
    dot = lambda a, b: int(a[: len(b)] @ b[: len(a)])
    want = []
    for q in terms:
        if q % 20 == 0:
            s = sorted(((-dot(terms[q], terms[c]), c) for c in terms if c != q))[:5]
            want += [(q, k + 1, c, -n) for k, (n, c) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embed_dedup.near_duplicates(none).collect() == [] and topk.top_k(none, "vec_id % 20 = 0").collect() == []


def test_one_id_over_several_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(7, a, 1), (7, b, 1), (9, [1.0, 0.01, 0.0], 1)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert sorted(map(tuple, got)) == [(7, 0, 7, True), (7, 1, 7, True), (9, 1, 7, False)]


def test_scores_beyond_64_bits_stop_at_their_ends(spark):
    rows = [(0, [3e38, 1.0], 0), (1, [3e38, 2.0], 0), (2, [-3e38, 0.0], 0), (3, [0.0, 1.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), "vec_id = 0", k=3).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 2**63 - 1), (2, 3, 1024 * 1024), (3, 2, -(2**63))]
