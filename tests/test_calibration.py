"""Graded names, calibrated orders and cross-validation against a plain version."""

import random

import pytest

from weftline.operators import calibration as c


def alike(a, b):
    return a == b or a.endswith(f".{b}") or b.endswith(f".{a}")


def plain_edges(s, m):
    out = []
    for k in {k for k, _ in s + m}:
        ours, theirs = {n for q, n in s if q == k}, {n for q, n in m if q == k}
        out += [(k, n, "agree" if any(alike(n, x) for x in theirs) else "sql_qual" if "." in n else "sql_bare") for n in ours]
        out += [(k, n, "model_qual" if "." in n else "model_bare") for n in theirs if not any(alike(n, x) for x in ours)]
    return sorted(out)


def fit(rows, gold, least):
    n, good = dict.fromkeys(c.TIERS, 0), dict.fromkeys(c.TIERS, 0)
    for k, name, tier in rows:
        n[tier] += 1
        good[tier] += any(alike(name, g) for g in gold[k])
    order = sorted((t for t in c.TIERS if n[t]), key=lambda t: (-good[t] / n[t], c.TIERS.index(t)))
    accept, a, g = [], 0, 0
    for t in order:
        a, g = a + n[t], g + good[t]
        if g / a < least:
            break
        accept.append(t)
    return accept


def made(seed, n=40):
    r = random.Random(seed)
    name = lambda: r.choice(["", "db.", "x.db."]) + r.choice("abcdef")
    s, m, g = ([(k, name()) for k in range(n) for _ in range(r.randrange(a, 5))] for a in (0, 0, 0))
    return s, m, g


@pytest.mark.parametrize("seed, k, least", [(1, 5, 0.5), (2, None, 0.6), (3, 3, 0.99)])
def test_cross_validation(spark, seed, k, least):
    s, m, g = made(seed)
    df = lambda x: spark.createDataFrame(x, "k long, name string")
    edges = c.candidates(df(s), df([*m, (1, None)]), "k")
    assert sorted(map(tuple, edges.collect())) == plain_edges(s, m)
    gold = {q: {n for p, n in g if p == q} for q, _ in g}
    keys = sorted(gold)
    folds = min(k or len(keys), len(keys))
    rows = [e for e in plain_edges(s, m) if e[0] in gold]
    want = []
    for f in range(folds):
        own = set(keys[f::folds])
        accept = fit([e for e in rows if e[0] not in own], gold, least)
        taken = [(q, n) for q, n, t in rows if q in own and t in accept]
        hit = [any(alike(n, x) for x in gold[q]) for q, n in taken]
        covered = sum(any(alike(n, x) for q, n in taken if q == own_key) for own_key in own for x in gold[own_key])
        want.append((f, accept, len(own), len(taken), sum(hit), covered, sum(len(gold[q]) for q in own)))
    sets = c.fold_sets(edges, df(g), "k", k, least)
    assert sorted(map(tuple, sets.collect())) == want
    p = c.pooled(sets).first()
    total = [sum(w[i] for w in want) for i in range(3, 7)]
    assert p.folds == folds and p.precision == (round(total[1] / total[0], 6) if total[0] else 1) and p.recall == round(total[2] / total[3], 6)
    chosen = [w[1] for w in want]
    assert p.modal == max(chosen, key=chosen.count) and p.modal_folds == chosen.count(p.modal)


def test_nothing_to_judge(spark):
    none = spark.createDataFrame([], "k long, name string")
    assert c.candidates(none, none, "k").collect() == [] and c.curve(c.candidates(none, none, "k"), none, "k", True).collect() == []
    assert c.fold_sets(c.candidates(none, none, "k"), none, "k", 5, 0.5).collect() == []


def test_grafted_columns(spark):
    schema = "k long, name string, columns array<string>, pos long"
    tables = spark.createDataFrame([(1, " DB.T ", ["old"], 0), (1, "u", ["own"], 1), (1, "v", None, 2), (1, "v", ["later"], 3), (1, " ", ["x"], 4), (1, None, ["x"], 5)], schema)
    columns = spark.createDataFrame([(1, "t", ["a"], 0), (1, "x.db.t", ["b"], 1), (1, "u", None, 2), (1, "w", ["w"], 3), (2, "v", ["other key"], 0)], schema)
    got = lambda union: {(r.k, r.name): r.columns for r in c.grafted(tables, columns, ["k"], union).collect()}
    assert got(False) == {(1, "db.t"): ["a"], (1, "u"): None, (1, "v"): ["later"]}
    exact = c.grafted(tables, columns.union(spark.createDataFrame([(1, "Db.t", ["exact"], 9)], schema)), ["k"])
    assert {r.name: r.columns for r in exact.collect()}["db.t"] == ["exact"]
    assert got(True) == got(False) | {(1, "t"): ["a"], (1, "x.db.t"): ["b"], (1, "w"): ["w"], (2, "v"): ["other key"]}


def test_what_several_joins_read_is_computed_once_and_no_pair_comes_twice(spark):
    names = lambda *x: spark.createDataFrame([(1, n) for n in x], "k long, name string")
    a, b = ["s", "db.s", "x.db.s", "a.s.s"], ["s", "db.s", "y.s", "x.db.s"]
    got = sorted((r.name, r.other) for r in c.alike(names(*a), names(*b), ["k"], "other").collect())
    assert got == sorted((x, y) for x in a for y in b if x == y or x.endswith(f".{y}") or y.endswith(f".{x}"))
    edges = c.candidates(names(*a), names(*b), "k")
    covered = c.judged(edges, names("s"), "k")[1]
    assert "Join" not in covered._jdf.queryExecution().optimizedPlan().toString()
