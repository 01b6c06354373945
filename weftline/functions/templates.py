"""Schedule templates: {{expr}} with dates, offsets and parameters, resolved for a business date."""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EXPR = re.compile(r"^([ymd\-/_ ]*[ymd])\s*(?:([+-])\s*(\d+)(?:\s*\*\s*(\d+))?)?$")


class TemplateError(ValueError):
    """A template that can't be resolved."""


def parse_date(text: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{8}", text or ""):
        raise TemplateError(f"no date: {text}")
    d = text.replace("-", "")
    try:
        return date(int(d[:4]), int(d[4:6]), int(d[6:]))
    except ValueError as e:
        raise TemplateError(f"no date: {text}") from e


def format_date(day: date, pattern: str) -> str:
    """y, m and d runs: yy has two digits, m and d two at least."""
    put = lambda m: str(day.year)[-2:] if m[0] == "yy" else str(day.year).rjust(len(m[0]), "0") if m[0][0] == "y" else str(day.month if m[0][0] == "m" else day.day).rjust(max(2, len(m[0])), "0")
    return re.sub(r"y+|m+|d+", put, pattern)


def shift(day: date, pattern: str, n: int) -> date:
    if "d" in pattern:
        return day + timedelta(days=n)
    months = day.year * 12 + day.month - 1 + (n if "m" in pattern else 12 * n)
    y, m = divmod(months, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(y, m + 1, min(day.day, last))


def resolve(text: str, biz_date: str, today: str, params: dict[str, str] | None = None, _open: tuple[str, ...] = ()) -> str:
    """Every {{...}} of a text: bizdate, bizmonth, a date pattern with an offset, or a parameter, whose value is resolved likewise."""
    day = parse_date(biz_date)
    if re.search(r"\{\{[^{}]*\{\{", text) or text.count("{{") != text.count("}}"):
        raise TemplateError("nested or unclosed")

    def value(m: re.Match) -> str:
        e = m[1].strip()
        if not e:
            raise TemplateError("empty")
        if params and e in params:
            if e in _open:
                raise TemplateError(f"{e} refers to itself")
            return resolve(params[e], biz_date, today, params, (*_open, e))
        if e == "bizdate":
            return format_date(day, "yyyymmdd")
        if e == "bizmonth":
            now = parse_date(today)
            return format_date(shift(day, "m", -1) if (day.year, day.month) == (now.year, now.month) else day, "yyyymm")
        if d := _EXPR.match(e):
            n = int(d[3] or 0) * int(d[4] or 1) * (-1 if d[2] == "-" else 1)
            return format_date(shift(day, d[1], n), d[1])
        raise TemplateError(f"unknown: {e}")

    return re.sub(r"\{\{(.*?)\}\}", value, text)


def resolve_lenient(text: str, biz_date: str, today: str, params: dict[str, str] | None = None) -> str:
    """Every ${...} that can be resolved; the others stay, trimmed inside."""
    def value(m: re.Match) -> str:
        try:
            return resolve("{{" + m[1] + "}}", biz_date, today, params)
        except TemplateError:
            return "${" + m[1].strip() + "}"

    return re.sub(r"\$\{([^}]*)\}", value, text)


def resolved(rows: DataFrame, template: str, biz_date: str, today: str, into: str = "resolved", lenient: bool = False) -> DataFrame:
    """``rows`` with their templates resolved for their business dates; each different pair is resolved once. What can't be resolved is null, or, ``lenient``, stays."""
    @F.pandas_udf("string")
    def each(texts: pd.Series, days: pd.Series) -> pd.Series:
        def one(text: str, day: str) -> str | None:
            try:
                return (resolve_lenient if lenient else resolve)(text, day, today)
            except TemplateError:
                return None

        return pd.Series([one(a, b) for a, b in zip(texts, days)], dtype=object)

    pairs = rows.select(F.col(template).alias("_text"), F.col(biz_date).alias("_day")).where("_text is not null and _day is not null").distinct().withColumn(into, each("_text", "_day"))
    return rows.join(pairs, [rows[template] == pairs["_text"], rows[biz_date] == pairs["_day"]], "left").drop("_text", "_day")


def is_date(text: str | None) -> bool:
    return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text or ""))
