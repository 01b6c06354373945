"""Fire times of six-field crons, as bit sets, and of fixed intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_RANGES = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
_NAMES = {n: i for i, n in enumerate("SUN MON TUE WED THU FRI SAT".split())} | {n: i + 1 for i, n in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}


def fields(cron: str) -> list[set[int]]:
    """Allowed values of second, minute, hour, day, month and weekday (Sunday 0); lists, ranges and steps."""
    parts = cron.upper().split()
    if len(parts) != 6:
        raise ValueError(f"not six fields: {cron}")
    out = []
    for text, (low, high) in zip(parts, _RANGES):
        allowed = set()
        for item in text.split(","):
            span, _, step = item.partition("/")
            a, _, b = span.partition("-")
            start = low if a in ("*", "?") else int(_NAMES.get(a, a))
            end = int(_NAMES.get(b, b)) if b else high if a in ("*", "?") or step else start
            allowed |= {x % 7 if high == 6 else x for x in range(start, end + 1, int(step or 1))}
        out.append(allowed)
    return out


#: Allowed values of each field as the bits of a long, bit n for value n.
_NAMED = ("second", "minute", "hour", "day", "month", "weekday")


@F.pandas_udf(StructType([StructField(x, LongType()) for x in _NAMED]))
def _masks(cron: pd.Series) -> pd.DataFrame:
    def bits(text: str) -> list[int | None]:
        try:
            return [sum(1 << v for v in allowed) for allowed in fields(text)]
        except ValueError:
            return [None] * 6

    return pd.DataFrame({x: pd.array(list(v), dtype="Int64") for x, v in zip(_NAMED, zip(*map(bits, cron)))}, columns=_NAMED, index=cron.index)  # 60 bits are no floats


def with_masks(rows: DataFrame, cron: str, into: str = "_masks") -> DataFrame:
    """``rows`` with the bit sets of their crons; each different cron is read once. A null or malformed one has none, and so never fires."""
    known = rows.select(F.col(cron).alias("_cron")).where("_cron is not null").distinct().withColumn(into, _masks("_cron"))
    return rows.join(known, rows[cron] == known["_cron"], "left").drop("_cron")


def _has(mask: str | Column, value: Column) -> Column:
    return F.call_function("shiftright", mask, value.cast("int")).bitwiseAND(F.lit(1)) == 1


def _least(mask: Column, above: Column | None = None) -> Column:
    """The smallest allowed value, or the smallest above another; null if there is none."""
    if above is not None:
        up = F.call_function("shiftright", mask, (above + 1).cast("int"))
        return _least(up) + above + 1
    low = mask.bitwiseAND(-mask)
    return F.when(mask != 0, F.bit_count(low - 1))


def _on_day(masks: str, day: Column) -> Column:
    """Whether a date's month, day and weekday are allowed."""
    return _has(F.col(f"{masks}.month"), F.month(day)) & _has(F.col(f"{masks}.day"), F.day(day)) & _has(F.col(f"{masks}.weekday"), F.dayofweek(day) - 1)


def _at(day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.call_function("make_timestamp_ntz", F.year(day), F.month(day), F.day(day), hour, minute, second)


#: Beyond so many years after the last base date a cron that has not fired counts as one that never does; the calendar repeats after 28, or 40 about a century without a leap day.
YEARS = 40


def next_fires(rows: DataFrame, base: str, cron: str, seconds: str, into: str = "next") -> DataFrame:
    """``rows`` with the first fire strictly after ``base`` (a timestamp without zone): by cron where there is one, else the base plus an interval.

    Within the base's day bits tell the next time. The next allowed date is looked up in a calendar of the different sets of days among the crons, one row a
    date, so rare dates are found like others and no row walks through days.
    """
    rows = with_masks(rows.withColumn("_base", F.col(base)).withColumn("_date", F.to_date("_base")), cron)
    m = lambda f: F.col(f"_masks.{f}")
    key = ["_month", "_day", "_weekday"]
    rows = rows.withColumns(dict(zip(key, (m("month"), m("day"), m("weekday")))))
    ends = rows.where("_masks is not null and _date is not null").agg(F.min("_date").alias("a"), F.max("_date").alias("z"))
    sets = rows.where("_masks is not null").select(*key).distinct()
    day = sets.crossJoin(F.broadcast(ends)).select(*key, "z", F.explode(F.sequence("a", F.add_months("z", 12 * YEARS))).alias("_date"))  # a calendar for each set of days
    fits = _has(F.col("_month"), F.month("_date")) & _has(F.col("_day"), F.day("_date")) & _has(F.col("_weekday"), F.dayofweek("_date") - 1)
    later = Window.partitionBy(*key).orderBy("_date").rowsBetween(1, Window.unboundedFollowing)
    day = day.withColumn("_fits", fits).withColumn("_then", F.min(F.when(fits, F.col("_date"))).over(later)).where("_date <= z").drop("z")
    found = rows.join(day, [*key, "_date"], "left")
    h, mi, s = F.hour("_base"), F.minute("_base"), F.second("_base")
    s0, m0 = _least(m("second")), _least(m("minute"))
    s1, m1, h1 = _least(m("second"), s), _least(m("minute"), mi), _least(m("hour"), h)
    in_hour, in_minute = _has(m("hour"), h), _has(m("hour"), h) & _has(m("minute"), mi)
    today = F.when(in_minute & s1.isNotNull(), _at(F.col("_date"), h, mi, s1)).when(in_hour & m1.isNotNull(), _at(F.col("_date"), h, m1, s0)).when(h1.isNotNull(), _at(F.col("_date"), h1, m0, s0))
    by_cron = F.coalesce(F.when(F.col("_fits"), today), F.when(F.col("_then").isNotNull(), _at(F.col("_then"), _least(m("hour")), m0, s0)))
    value = F.when(F.col(cron).isNotNull(), by_cron).otherwise(F.col("_base") + F.make_dt_interval(secs=F.col(seconds)))
    return found.withColumn(into, value).drop(*key, "_base", "_date", "_masks", "_fits", "_then")


def fires(rows: DataFrame, after: str, upto: str, cron: str, seconds: str, into: str = "due") -> DataFrame:
    """A row for each fire of each row strictly after ``after`` and up to ``upto``: by cron, or at ``after`` plus each multiple of an interval.

    Dates, then hours, minutes and seconds are laid out, and those out of the window or not allowed left out each time.
    """
    rows = with_masks(rows.withColumn("_a", F.col(after)).withColumn("_z", F.col(upto)).where("_a < _z"), cron)
    m = lambda f: F.col(f"_masks.{f}")
    allowed = lambda f, n: F.filter(F.sequence(F.lit(0), F.lit(n)), lambda v: _has(m(f), v))
    timed = rows.where("_masks is not null").withColumn("_date", F.explode(F.sequence(F.to_date("_a"), F.to_date("_z")))).where(_on_day("_masks", F.col("_date")))
    timed = timed.withColumn("_h", F.explode(allowed("hour", 23))).withColumn("_at", _at(F.col("_date"), F.col("_h"), F.lit(0), F.lit(0))).where("_at <= _z and _at + interval 1 hour > _a")
    timed = timed.withColumn("_m", F.explode(allowed("minute", 59))).withColumn("_at", F.expr("_at + make_dt_interval(0, 0, _m, 0)")).where("_at <= _z and _at + interval 1 minute > _a")
    timed = timed.withColumn("_s", F.explode(allowed("second", 59))).withColumn(into, F.expr("_at + make_dt_interval(0, 0, 0, _s)")).where(f"{into} > _a and {into} <= _z").drop("_date", "_h", "_m", "_s", "_at")
    steps = F.expr(f"cast(floor((unix_micros(cast(_z as timestamp)) - unix_micros(cast(_a as timestamp))) / 1000000 / {seconds}) as int)")
    every = rows.where(F.col(cron).isNull() & (F.col(seconds) > 0)).withColumn("_n", steps).where("_n > 0")
    every = every.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn(into, F.expr(f"_a + make_dt_interval(0, 0, 0, _k * {seconds})")).drop("_n", "_k")
    return timed.drop("_masks", "_a", "_z").unionByName(every.drop("_masks", "_a", "_z"))
