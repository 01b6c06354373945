"""Fires by bit sets against a walk through seconds."""

from datetime import datetime, timedelta

import pytest

from weftline.functions import schedules
from weftline.operators import fires

CRONS = ["0 0 0 * * ?", "0 */15 8-9 * * MON-FRI", "30 59 23 31 * ?", "0 0 12 29 2 ?", "5,35 * * * * *", "0 0 0 29 FEB MON", "59 59 23 31 12 ?", "0 0 6 ? * SUN", "0 0 0 30 2 ?", "broken", "0 0 99 * * ?"]
BASES = [datetime(2024, 1, 31, 23, 59, 59), datetime(2024, 2, 28, 12, 0), datetime(2023, 12, 31, 23, 59, 59), datetime(2024, 3, 3, 5, 59, 59, 500000), datetime(2024, 1, 1)]


def slow_next(cron, base, years=41):
    """Day by day, then over the day's allowed times."""
    try:
        second, minute, hour, day, month, weekday = schedules.fields(cron)
    except ValueError:
        return None
    t = base.replace(microsecond=0) + timedelta(seconds=1)
    for k in range(366 * years):
        d = (t + timedelta(days=k)).date()
        if d.month in month and d.day in day and (d.weekday() + 1) % 7 in weekday:
            for h in sorted(hour):
                for m in sorted(minute):
                    for s in sorted(second):
                        if h < 24 and datetime(d.year, d.month, d.day, h, m, s) >= t:
                            return datetime(d.year, d.month, d.day, h, m, s)
    return None


@pytest.mark.parametrize("crons", [CRONS[:10]])
def test_next_fires_as_a_walk(spark, crons):
    rows = [(k, b, c, 90) for k, (c, b) in enumerate((c, b) for c in [*crons, None] for b in BASES)]
    got = {r.k: r.next for r in schedules.next_fires(spark.createDataFrame(rows, "k int, base timestamp_ntz, cron string, seconds int"), "base", "cron", "seconds").collect()}
    assert got == {k: slow_next(c, b) if c else b + timedelta(seconds=90) for k, b, c, _ in rows}
    assert got[25] == datetime(2044, 2, 29) and got[40] is None


def test_fires_within_a_window(spark):
    a, z = datetime(2024, 2, 27, 8, 15), datetime(2024, 3, 1, 9, 0)
    rows = [(k, a, z, c, 40000) for k, c in enumerate([*CRONS[:10], None])] + [(99, z, a, CRONS[0], 1)]
    got = {}
    for r in schedules.fires(spark.createDataFrame(rows, "k int, a timestamp_ntz, z timestamp_ntz, cron string, seconds int"), "a", "z", "cron", "seconds").collect():
        got.setdefault(r.k, []).append(r.due)
    want = {10: [a + timedelta(seconds=40000 * n) for n in range(1, 7) if a + timedelta(seconds=40000 * n) <= z]}
    for k, c in enumerate(CRONS[:10]):
        t, points = slow_next(c, a), []
        while t and t <= z:
            points.append(t)
            t = slow_next(c, t)
        if points:
            want[k] = points
    assert {k: sorted(v) for k, v in got.items()} == want


PLANS = "task_id long, last timestamp_ntz, cron string, seconds int, policy string, starts timestamp_ntz, stops timestamp_ntz"


def test_policies_terms_and_guards(spark):
    last, day = datetime(2024, 1, 10, 12), "0 0 0 * * ?"
    rows = [
        (1, last, day, None, "all", None, None), (2, last, day, None, "fire_once", None, None), (3, last, day, None, "skip", None, None), (4, datetime(2024, 1, 12, 3), day, None, "skip", None, None), (5, last, day, None, None, None, None),
        (6, last, day, None, "all", datetime(2024, 1, 12), None), (7, last, day, None, "all", None, datetime(2024, 1, 11)), (8, last, None, None, "all", None, None), (9, last, "no cron", None, "all", None, None), (1, last, day, None, "all", None, None),
    ]
    plans = spark.createDataFrame(rows, PLANS)
    found = sorted((r.task_id, r.due.day, r.missed) for r in fires.due(plans, "2024-01-13 06:00:00", 86400).collect())
    ahead = [(k, 14, False) for k in (1, 2, 3, 4, 5, 6)]
    assert found == sorted([*ahead, (1, 11, True), (1, 12, True), (1, 13, True), (2, 11, True), (4, 13, True), (5, 11, True), (6, 12, True), (6, 13, True), (7, 11, True)])
    guards = spark.createDataFrame([(1, datetime(2024, 1, 11), "FIRED"), (1, datetime(2024, 1, 12), "DEAD"), (1, datetime(2024, 1, 13), None)], "task_id long, due timestamp_ntz, status string")
    left = fires.due(plans.where("task_id = 1"), "2024-01-13 06:00:00", 0, guards).collect()
    assert [r.due.day for r in left] == [12]
    nexts = {r.task_id: r.next and r.next.day for r in fires.advanced(plans, "2024-01-13 06:00:00").collect()}
    assert nexts == {1: 14, 2: 14, 3: 14, 4: 14, 5: 14, 6: 14, 7: None, 8: None, 9: None}


def test_reconciled(spark):
    now, at = "2024-01-13 06:00:00", lambda h: datetime(2024, 1, 13, 6) - timedelta(hours=h)
    rows = [(1, at(3), at(3), None, "PENDING"), (2, at(3), at(3), None, "PENDING"), (3, at(3), at(3), None, "PENDING"), (4, at(50), at(50), None, "PENDING"), (5, at(0), at(0), None, "PENDING"), (6, at(3), at(3), "x", "FIRED"), (7, at(3), at(3), None, "DEAD")]
    guards = spark.createDataFrame(rows, "task_id long, due timestamp_ntz, made timestamp_ntz, instance string, status string")
    online = spark.createDataFrame([(k,) for k in (1, 2, 4, 5, 6, 7)], "task_id long")
    there = spark.createDataFrame([(2, at(3)), (1, at(4))], "task_id long, due timestamp_ntz")
    got = {r.task_id: (r.action, r.biz_date) for r in fires.reconciled(guards, online, there, now, 3600, 86400).collect()}
    assert got == {1: ("REPLAY", "2024-01-12"), 2: ("FILLED", "2024-01-12"), 3: ("DEAD", "2024-01-12"), 4: ("DEAD", "2024-01-10")}
