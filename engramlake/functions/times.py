"""Time functions."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-life of a memory's recency in seconds: 30 days (a fixed value).
HALF_LIFE = 30 * 86400


def age_seconds(ts: Column, now: str) -> Column:
    at = F.lit(now).cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", ts, at)


def recency(ts: Column, now: str) -> Column:
    """exp(-ln 2 age / 30 days); 0.5 without a time."""
    return F.coalesce(F.exp(F.lit(-math.log(2)) * age_seconds(ts, now) / HALF_LIFE), F.lit(0.5))


def step_bonus(ts: Column, now: str) -> Column:
    """0.1 within an hour, 0.05 within a day."""
    age = age_seconds(ts, now)
    return F.when(age < 3600, 0.1).when(age < 86400, 0.05).otherwise(0.0)


def bounds(ts: Column, unit: str) -> tuple[Column, Column]:
    """First and last microsecond of the day, ISO week, month or year."""
    first = F.date_trunc(unit, ts).cast("timestamp_ntz")
    last = first + F.expr({"day": "interval 1 day", "week": "interval 7 day", "month": "interval 1 month", "year": "interval 1 year"}[unit]) - F.expr("interval 1 microsecond")
    return first, last


def hop_decay(confidence: Column, factor: float, depth: Column) -> Column:
    """round(max(confidence, 0.01) * factor ** depth, 4)."""
    return F.round(F.greatest(confidence, F.lit(0.01)) * F.pow(F.lit(factor), depth), 4)


#: Chinese digits and units (fixed values).
DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000, "亿": 100000000}


def chinese_number(text: str) -> int | None:
    """A numeral in Arabic or Chinese digits; a large unit multiplies all that stands before it (十二万 is 120000)."""
    if text.isdigit():
        return int(text)
    total = section = digit = 0
    for c in text:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in UNITS and UNITS[c] < 10000:
            section += (digit or 1) * UNITS[c]
            digit = 0
        elif c in UNITS:
            total = (total + section + digit) * UNITS[c]
            section = digit = 0
        else:
            return None
    return total + section + digit


def _day(at: datetime) -> tuple[datetime, datetime]:
    first = at.replace(hour=0, minute=0, second=0, microsecond=0)
    return first, first + timedelta(days=1) - timedelta(microseconds=1)


def parse_phrase(phrase: str, now: datetime) -> tuple[datetime, datetime] | None:
    """Range that an English or Chinese phrase about time names, seen from ``now``; the first rule that fits decides."""
    import re

    text = phrase.lower().strip()
    months = {"day": 1, "week": 7, "month": 30, "year": 365, "天": 1, "周": 7, "个月": 30, "年": 365}
    day = timedelta(days=1)

    def month(shift: int) -> tuple[datetime, datetime]:
        k = now.year * 12 + now.month - 1 + shift
        first = datetime(k // 12, k % 12 + 1, 1)
        return first, datetime((k + 1) // 12, (k + 1) % 12 + 1, 1) - timedelta(microseconds=1)

    def week(shift: int) -> tuple[datetime, datetime]:
        first = _day(now)[0] - day * now.weekday() + 7 * day * shift
        return first, first + 7 * day - timedelta(microseconds=1)

    def year(shift: int) -> tuple[datetime, datetime]:
        return datetime(now.year + shift, 1, 1), datetime(now.year + shift + 1, 1, 1) - timedelta(microseconds=1)

    fixed = [
        (r"day before yesterday|前天", lambda: _day(now - 2 * day)),
        (r"yesterday|昨天", lambda: _day(now - day)),
        (r"tomorrow|明天", lambda: _day(now + day)),
        (r"today|今天", lambda: _day(now)),
        (r"last week|上周", lambda: week(-1)),
        (r"this week|这周|本周", lambda: week(0)),
        (r"last month|上个月|上月", lambda: month(-1)),
        (r"this month|这个月|本月", lambda: month(0)),
        (r"last year|去年", lambda: year(-1)),
        (r"this year|今年", lambda: year(0)),
    ]
    if m := re.search(r"(\d{4})-(\d{1,2})-(\d{1,2})", text):
        try:
            return _day(datetime(*map(int, m.groups())))
        except ValueError:
            return None
    if m := re.search(r"(?:past|last)\s+(\d+)\s+(day|week|month|year)s?|(\d+)\s+(day|week|month|year)s?\s+ago", text):
        n, unit = (m[1], m[2]) if m[1] else (m[3], m[4])
        return now - int(n) * months[unit] * day, now
    if m := re.search(r"(?:最近|过去)?([\d零一二两三四五六七八九十百千万]+)(天|周|个月|年)[前内]?", text):
        n = chinese_number(m[1])
        if n is not None:
            return now - n * months[m[2]] * day, now
    for pattern, made in fixed:
        if re.search(pattern, text):
            return made()
    return None


def numeral(text: Column) -> Column:
    """``chinese_number`` as a column; null where a character is neither digit nor unit, or the text is empty."""
    many = F.create_map(*[x for k, v in {**DIGITS, **UNITS}.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("digit"))

    def state(total: Column, section: Column, digit: Column) -> Column:
        return F.struct(total.alias("total"), section.alias("section"), digit.alias("digit"))

    def step(s: Column, c: Column) -> Column:
        v = F.element_at(many, c)
        small = state(s["total"], s["section"] + F.greatest(s["digit"], F.lit(1)) * v, zero)
        large = state((s["total"] + s["section"] + s["digit"]) * v, zero, zero)
        return F.when(v < 10, state(s["total"], s["section"], v)).when(v < 10000, small).when(v >= 10000, large)

    spoken = F.aggregate(F.split(text, ""), start, step, lambda s: s["total"] + s["section"] + s["digit"])
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")).when(text != "", spoken)


def phrase_range(phrase: Column, now: Column) -> tuple[Column, Column]:
    """``parse_phrase`` as columns: first and last microsecond of the range that a phrase names, seen from ``now``.

    The first rule that fits decides; both are null where none fits, for dates that don't exist, for counts of over a million days,
    and for null phrases.
    """
    text = F.trim(F.lower(phrase))
    days = {"day": 1, "week": 7, "month": 30, "year": 365, "天": 1, "周": 7, "个月": 30, "年": 365}
    length = F.create_map(*[F.lit(x) for kv in days.items() for x in kv])
    date = F.regexp_extract(text, r"(\d{4}-\d{1,2}-\d{1,2})", 1)
    back, ago = r"(?:past|last)\s+(\d+)\s+(day|week|month|year)s?", r"(\d+)\s+(day|week|month|year)s?\s+ago"
    spoken = r"(?:最近|过去)?([0-9零一二两三四五六七八九十百千万]+)(天|周|个月|年)[前内]?"

    def span(pattern: str, n) -> tuple[Column, Column, Column]:
        many = n(F.regexp_extract(text, pattern, 1)) * F.element_at(length, F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")))
        first = F.timestamp_add("DAY", F.when(many <= 1_000_000, -many).cast("int"), now)
        return text.rlike(pattern), first.cast("timestamp_ntz"), F.when(first.isNotNull(), now)

    def unit(pattern: str, name: str, shift: str) -> tuple[Column, Column, Column]:
        return text.rlike(pattern), *bounds(now + F.expr(f"interval {shift}"), name)

    day = date.try_cast("date").cast("timestamp_ntz")
    rules = [
        (date != "", *bounds(day, "day")),
        span(back, lambda n: n.try_cast("bigint")),
        span(ago, lambda n: n.try_cast("bigint")),
        span(spoken, numeral),
        unit("day before yesterday|前天", "day", "-2 day"),
        unit("yesterday|昨天", "day", "-1 day"),
        unit("tomorrow|明天", "day", "1 day"),
        unit("today|今天", "day", "0 day"),
        unit("last week|上周", "week", "-7 day"),
        unit("this week|这周|本周", "week", "0 day"),
        unit("last month|上个月|上月", "month", "-1 month"),
        unit("this month|这个月|本月", "month", "0 day"),
        unit("last year|去年", "year", "-1 year"),
        unit("this year|今年", "year", "0 day"),
    ]

    def chosen(k: int) -> Column:
        out = F.when(rules[0][0], rules[0][k])
        for rule in rules[1:]:
            out = out.when(rule[0], rule[k])
        return out

    return chosen(1), chosen(2)
