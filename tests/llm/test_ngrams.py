import random

import pytest

from weftline.llm import ngrams


def brute(rows, words, percent=80, k=5):
    table = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = words((t or "").translate(table))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(r.choice([3, 50, 1000]))] + ["É", "The"]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    texts, line = [], prose(12)
    for _ in range(n):
        w = prose(r.choice([0, 1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 200])) if not texts or r.random() < 0.3 else list(r.choice(texts))
        for _ in range(r.choice([0, 1, 1, 2, 5])):
            if w:
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = r.choice([[], prose(1), [w[at].upper()]])
        if r.random() < 0.2:
            w = w + line
        texts.append(w)
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [(i, r.choice([" ", "\n\t "]).join(t)) for i, t in zip(ids, texts)] + [(9001, None), (9002, "")]


@pytest.mark.parametrize("seed", range(4))
def test_as_brute_force(spark, brute_words, seed):
    rows = corpus(seed)
    got = ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == brute(rows, brute_words)


def test_many_near_copies_and_a_bridge(spark, brute_words):
    r = random.Random(7)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 2, 3])):
            w[r.randrange(60)] = f"z{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(tuple, got)) == brute(rows, brute_words)


def test_signatures_of_linked_sets_always_meet():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(3000):
        s = int(r.integers(1, 80))
        x = r.integers(0, 2**63, s, dtype=np.uint64) * np.uint64(2)
        if r.random() < 0.5:
            x = x >> np.uint64(int(r.integers(0, 8)))  # all in a few segments
        y = np.concatenate([x[int(r.integers(0, s // 8 + 1)) :], r.integers(0, 2**63, int(r.integers(0, s // 8 + 1)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
            continue
        sides = [[(k, less) for sig, less in ngrams.signatures(z) for k in sig.tolist()] for z in (x, y)]
        full = [{k for k, less in z if not less} for z in sides]
        every = [{k for k, _ in z} for z in sides]
        assert full[0] & every[1] or full[1] & every[0] or (x.tolist() == y.tolist())


def test_one_of_each_group_stays(spark):
    text = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text, "x", 1), (1, text + " w", "y", 1), (2, "other words", "z", 1), (4, None, None, 1), (5, " ", "e", 1), (5, " ", "e", 1), (2, "other words", "z", 1)], "doc_id long, text string, node string, component_id long")
    got = sorted(map(tuple, ngrams.without_near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, text + " w", "y", 1), (2, "other words", "z", 1), (4, None, None, 1), (5, " ", "e", 1), (5, " ", "e", 1)], key=str)
    assert ngrams.near_duplicates(docs.limit(0)).collect() == []


def test_one_of_each_group_stays_whatever_the_ids(spark):
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, text("a"), "1"), (None, text("b"), "1"), (None, text("b") + " w", "1"), (None, text("c"), "1"), (1, text("d"), "1"), (2, text("d") + " w", "1"), (2, text("e"), "1"), (None, text("e") + " w", "1"), (3, text("f"), "1"), (3, text("f") + " w", "1"), (3, text("f"), "1"), (4, text("g"), "1"), (4, text("g"), "1"), (5, text("h"), "1"), (5, text("k"), "1")]
    got = sorted((str(r.doc_id), r.text.split()[0]) for r in ngrams.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect())
    assert got == [("1", "d0"), ("2", "e0"), ("3", "f0"), ("4", "g0"), ("5", "h0"), ("5", "k0"), ("None", "a0"), ("None", "b0"), ("None", "c0")]
