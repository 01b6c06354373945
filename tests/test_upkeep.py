"""Counts kept by a stream: order, repeats, reruns and restarts change nothing."""

import tempfile
from datetime import datetime

from weftline.sources.versions import Versions
from weftline.streaming.maintainer import Maintainer

NEEDS = [("a", "u1", "STRONG"), ("a", "u2", "STRONG"), ("b", "u2", "WEAK"), ("b", "u3", "STRONG"), ("c", "u9", "STRONG"), ("gone", "u1", "STRONG")]
DAY = lambda n: datetime(2024, 1, n)


def keeper(spark, root, waiting=("a", "b", "c", "d"), every=2):
    needs = lambda: spark.createDataFrame(NEEDS, "dependent string, need string, strength string")
    return Maintainer(spark, root, needs, lambda: spark.createDataFrame([(w,) for w in waiting], "dependent string"), every)


def signals(spark, rows):
    return spark.createDataFrame(rows, "instance string, need string, state string, at timestamp_ntz")


def counts(m, batch=2**62):
    return {r.dependent: r.unmet for r in m.current(batch).collect()}


def test_counts_from_signals(spark):
    m = keeper(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    assert counts(m) == {"a": 2, "b": 2, "c": 1, "d": 0}
    m.apply(signals(spark, [("i1", "u1", "SUCCESS", DAY(1)), ("i2", "u2", "FAILED", DAY(1)), ("i1", "u1", "SUCCESS", DAY(1)), ("x", "u9", "RUNNING", DAY(1))]), 0)
    assert counts(m) == {"a": 1, "b": 1, "c": 1, "d": 0}
    m.apply(signals(spark, [("i3", "u3", "SUCCESS", DAY(2)), ("i2", "u2", "SUCCESS", DAY(3)), ("i1", "u1", "FAILED", DAY(0 + 1))]), 1)  # an equal time: success stays
    assert counts(m) == {"a": 0, "b": 0, "c": 1, "d": 0}
    m.apply(signals(spark, [("i2", "u2", "FAILED", DAY(2)), ("i4", "u2", "FAILED", DAY(5))]), 2)  # too late to count; another instance of a met need
    assert counts(m) == {"a": 0, "b": 0, "c": 1, "d": 0}
    m.apply(signals(spark, [("i2", "u2", "FAILED", DAY(9))]), 3)  # a rerun that fails takes its success back
    assert counts(m) == {"a": 1, "b": 0, "c": 1, "d": 0}
    assert {r.dependent: r.ready_since for r in m.current().collect()} == {"a": None, "b": 1, "c": None, "d": -1}
    assert [counts(m, b)["a"] for b in range(5)] == [2, 1, 0, 0, 1]


def test_a_batch_that_runs_again_and_a_restart(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    batches = [[("i1", "u1", "SUCCESS", DAY(1))], [("i2", "u2", "SUCCESS", DAY(2))], [("i3", "u3", "FAILED", DAY(3))]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            keeper(spark, root).apply(signals(spark, rows), number)
    assert counts(keeper(spark, root)) == {"a": 0, "b": 1, "c": 1, "d": 0}
    keeper(spark, root).apply(signals(spark, batches[1]), 1)
    assert counts(keeper(spark, root)) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_any_order_of_signals(spark):
    rows = [("i1", "u1", "SUCCESS", DAY(1)), ("i1", "u1", "FAILED", DAY(2)), ("i2", "u2", "FAILED", DAY(1))]
    for order in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        m = keeper(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        m.apply(signals(spark, [order[0], order[1]]), 0)
        m.apply(signals(spark, [order[2]]), 1)
        assert counts(m) == {"a": 2, "b": 1, "c": 1, "d": 0}


def test_only_waiting_dependents_are_kept_up(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    keeper(spark, root, waiting=("a", "c"))
    m = keeper(spark, root, waiting=("c", "b"))
    m.apply(signals(spark, [("i1", "u1", "SUCCESS", DAY(1)), ("i9", "u9", "SUCCESS", DAY(1))]), 0)
    assert counts(m) == {"a": 2, "b": 2, "c": 0}  # a was claimed: its count stays; b came later


def test_versions_keep_the_last_row_of_a_key(spark):
    v = Versions(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), ["k"], "k string, v long", every=3)
    v.start(spark.createDataFrame([("a", 0), ("b", 0)], "k string, v long"))
    for batch in range(7):
        v.put(spark.createDataFrame([("a", batch + 1)] + [("c", batch)] * (batch == 4), "k string, v long"), batch)
    got = lambda b: {r.k: r.v for r in v.before(b).collect()}
    assert got(0) == {"a": 0, "b": 0} and got(4) == {"a": 4, "b": 0} and got(7) == {"a": 7, "b": 0, "c": 4}
    v.put(spark.createDataFrame([], "k string, v long"), 6)
    assert got(7) == {"a": 6, "b": 0, "c": 4}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_base_without_changes_is_read_as_it_is(spark):
    v = Versions(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), ["k"], "k string, v long", every=2)
    v.start(spark.createDataFrame([("a", 0), ("b", 0), (None, 0), ("b", 0)], "k string, v long"))
    assert not any(x in _plan(v.before(0)) for x in ("Aggregate", "Join"))
    v.put(spark.createDataFrame([("a", 1), (None, 1)], "k string, v long"), 0)
    assert "Aggregate" not in _plan(v.before(1)) and sorted(map(str, ((r.k, r.v) for r in v.before(1).collect()))) == ["('a', 1)", "('b', 0)", "(None, 1)"]
    v.put(spark.createDataFrame([("c", 2)], "k string, v long"), 1)
    assert not any(x in _plan(v.before(2)) for x in ("Aggregate", "Join")) and v.before(2).count() == 4
    v.put(spark.createDataFrame([("d", 2)], "k string, v long"), 1)  # runs again: its base is made anew, not from itself
    assert sorted(map(str, (r.k for r in v.before(2).collect()))) == ["None", "a", "b", "d"]


def test_needs_are_computed_once_for_all_batches(spark, monkeypatch):
    from weftline.adapt import Tables
    from weftline.plans import upkeep

    given = []

    class Watched(Maintainer):
        def __init__(self, spark, root, needs, waiting, every):
            given.extend((needs(), waiting()))
            super().__init__(spark, root, needs, waiting, every)

    monkeypatch.setattr(upkeep, "Maintainer", Watched)
    upkeep._maintained(Tables(spark, "/root/testdata/sf0.001"))
    assert len(given) == 6 and not any("Relation" in _plan(x) for x in given)  # neither reads the tables again
