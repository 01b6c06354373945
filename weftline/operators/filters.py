"""Filters, projections, orders and pages of run lists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(conditions: Iterable[Column | None]) -> Column:
    """All of the conditions that are there; none of them lets every row pass."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def one_of(column: str, csv: str | None) -> Column | None:
    """In a comma-separated selection; blank entries count for nothing, an empty selection is no condition."""
    values = [v.strip() for v in (csv or "").split(",") if v.strip()]
    return F.col(column).isin(values) if values else None


def between(column: str, low: object | None = None, high: object | None = None) -> Column | None:
    """Within an inclusive range with optional ends."""
    ends = [F.col(column) >= low if low is not None else None, F.col(column) <= high if high is not None else None]
    return every(ends) if any(e is not None for e in ends) else None


def infix(word: str | None, *columns: str) -> Column | None:
    """LIKE '%word%' in any column, in which % and _ of the word are wildcards."""
    return reduce(lambda a, b: a | b, (F.col(c).cast("string").like(f"%{word}%") for c in columns)) if word else None


def infix_any_case(word: str | None, column: str) -> Column | None:
    return F.upper(column).like(f"%{word.upper()}%") if word else None


BANDS = {"high": (0, 2), "normal": (3, 9)}


def priority_band(band: str | None, column: str = "priority") -> Column | None:
    return between(column, *BANDS[band]) if band in BANDS else None


def overlaps(start: str, end: str, low: str | None, high: str | None) -> Column:
    """Rows whose interval meets [low, high]."""
    return every([F.col(end) >= low if low is not None else None, F.col(start) <= high if high is not None else None])


def pairs(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key tuple is in ``keys``."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def client_filter(spec: Iterable[Mapping]) -> Column:
    """One condition of a table's filter bar: search, select, segmented, date, multiSelect, toggle and dateRange entries.

    Empty values are no condition; a null cell fails a date range.
    """
    out = []
    for f in spec:
        value, c = f.get("value"), F.col(f["column"])
        if value in (None, "", [], {}):
            continue
        kind = f["kind"]
        if kind == "search":
            out.append(F.lower(c.cast("string")).contains(str(value).lower()))
        elif kind == "multiSelect":
            out.append(c.isin(list(value)))
        elif kind == "toggle":
            out.append(c if value else F.lit(True))
        elif kind == "dateRange":
            out.append(c.isNotNull() & every([c >= value["from"] if value.get("from") else None, c <= value["to"] if value.get("to") else None]))
        else:
            out.append(c == value)
    return every(out)


def duration_ms(start: str, end: str) -> Column:
    """Milliseconds from start to end; null if either is."""
    return F.unix_millis(F.col(end).cast("timestamp")) - F.unix_millis(F.col(start).cast("timestamp"))


def running_ms(start: str, end: str, as_of: str) -> Column:
    """Milliseconds so far, at least 0; a missing end is ``as_of``."""
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(F.coalesce(F.col(end), F.lit(as_of).cast("timestamp_ntz")).cast("timestamp")) - F.unix_millis(F.col(start).cast("timestamp")))


def state_rank(state: str = "state") -> Column:
    """Failed first, then active, then the rest."""
    return F.when(F.col(state) == "FAILED", 0).when(F.col(state).isin("RUNNING", "WAITING"), 1).otherwise(2)


def layer(name: Column) -> Column:
    """Warehouse layer from the last dotted part of a table name: ods alone or with a prefix sign, others with one."""
    leaf = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.when((leaf == "ods") | leaf.startswith("ods_"), "ODS").when(leaf.startswith("dwd_"), "DWD").when(leaf.startswith("dws_"), "DWS").when(leaf.startswith("ads_"), "ADS")


def schedule_text(kind: Column, cron: Column, seconds: Column) -> Column:
    """A schedule in words: six-field crons of the common shapes, fixed intervals, or the cron as it is."""
    part = lambda i: F.element_at(F.split(F.trim(cron), r"\s+"), i)
    clock = F.concat(F.lpad(part(3), 2, "0"), F.lit(":"), F.lpad(part(2), 2, "0"))
    number = lambda c: c.rlike(r"^\d+$")
    daily = number(part(2)) & number(part(3)) & (part(5) == "*")
    return (F.when(kind == "INTERVAL", F.concat(F.lit("every "), seconds.cast("string"), F.lit(" s")))
            .when(cron.isNull() | (F.size(F.split(F.trim(cron), r"\s+")) != 6), F.coalesce(cron, F.lit("manual")))
            .when(part(2).rlike(r"^(\*|0)/\d+$"), F.concat(F.lit("every "), F.element_at(F.split(part(2), "/"), 2), F.lit(" min")))
            .when(number(part(2)) & (part(3) == "*"), F.concat(F.lit("hourly at minute "), part(2)))
            .when(daily & part(4).isin("*", "?") & part(6).isin("*", "?"), F.concat(F.lit("daily "), clock))
            .when(daily & part(4).isin("*", "?"), F.concat(F.lit("weekly on "), part(6), F.lit(" "), clock))
            .when(daily & number(part(4)), F.concat(F.lit("monthly on "), part(4), F.lit(" "), clock))
            .otherwise(cron))


def ordered(df: DataFrame, key: str | None, descending: bool, allowed: Iterable[str], unique: str = "id") -> DataFrame:
    """By an allowed column, nulls last, ties by id in the same direction; by id descending for any other."""
    if key not in set(allowed):
        return df.orderBy(F.col(unique).desc())
    return df.orderBy(F.col(key).desc_nulls_last(), F.col(unique).desc()) if descending else df.orderBy(F.col(key).asc_nulls_last(), F.col(unique).asc())


def page(df: DataFrame, number: int, size: int, most: int = 200) -> DataFrame:
    """A zero-based page of an ordered frame; sizes are held within 1 and ``most``, numbers at 0 or more."""
    size = min(max(size, 1), most)
    return df.offset(max(number, 0) * size).limit(size)


def after(df: DataFrame, time: str, unique: str, last_time: object, last_id: object) -> Column:
    """Keyset condition: beyond (last_time, last_id) in ascending order."""
    return (F.col(time) > last_time) | ((F.col(time) == last_time) & (F.col(unique) > last_id))


def held_limit(limit: int, default: int = 100, most: int = 2000) -> int:
    return default if limit <= 0 else min(limit, most)


def held_depth(depth: int, most: int = 20) -> int:
    return most if depth <= 0 or depth > most else depth


def held_depths(depth: Column, most: int = 20) -> Column:
    """``held_depth`` for a column; a null depth asks for none and so gets the most."""
    return F.when((depth <= 0) | (depth > most) | depth.isNull(), most).otherwise(depth)


def capped_count(df: DataFrame, cap: int = 10_000) -> DataFrame:
    """(n, lower_bound): distinct rows up to ``cap``, and whether there may be more."""
    n = df.distinct().limit(cap).agg(F.count("*").alias("n"))
    return n.withColumn("lower_bound", F.col("n") >= cap)
