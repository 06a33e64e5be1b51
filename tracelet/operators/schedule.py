"""When a schedule runs next, as a pure function of the time asked."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

# Names of days and months in schedules.
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _clock(text: str | None, pattern: str) -> tuple | None:
    m = re.fullmatch(pattern + r"(\d{1,2}):(\d{2})", text or "", re.IGNORECASE)
    return m.groups() if m and int(m[m.lastindex]) < 60 and int(m[m.lastindex - 1]) < 24 else None


def _days_in(year: int, month: int) -> int:
    return ((datetime(year + month // 12, month % 12 + 1, 1)) - timedelta(days=1)).day


def next_run(as_of: datetime, frequency: str, time: str | None = None, cron: str | None = None, enabled: bool = True) -> datetime | None:
    """``time``: MM (hourly), HH:MM (daily), ``mon HH:MM`` (weekly), ``D HH:MM`` (monthly); anything else means the time asked. An unknown frequency is daily."""
    if not enabled:
        return None
    minute0 = as_of.replace(second=0, microsecond=0)
    if frequency == "cron":
        return next_cron(as_of, cron) if cron else None
    if frequency == "hourly":
        minute = int(time) if time and re.fullmatch(r"[0-5]\d", time) else 0
        return minute0.replace(minute=0) + timedelta(hours=1, minutes=minute)
    if frequency == "weekly":
        found = _clock(time, r"(mon|tue|wed|thu|fri|sat|sun)\s+")
        day, hour, minute = (DAYS.index(found[0].lower()), int(found[1]), int(found[2])) if found else ((as_of.weekday() + 1) % 7, as_of.hour, as_of.minute)
        at = minute0.replace(hour=hour, minute=minute)
        at += timedelta(days=(day - (at.weekday() + 1)) % 7)
        return at if at > as_of else at + timedelta(days=7)
    if frequency == "monthly":
        found = _clock(time, r"(\d{1,2})\s+")
        day, hour, minute = (min(31, max(1, int(found[0]))), int(found[1]), int(found[2])) if found else (as_of.day, as_of.hour, as_of.minute)
        at = minute0.replace(day=1, hour=hour, minute=minute)
        here = at.replace(day=min(day, _days_in(at.year, at.month)))
        if here > as_of:
            return here
        year, month = at.year + at.month // 12, at.month % 12 + 1
        return at.replace(year=year, month=month, day=min(day, _days_in(year, month)))
    found = _clock(time, "")
    hour, minute = (int(found[0]), int(found[1])) if found else (as_of.hour, as_of.minute)
    at = minute0.replace(hour=hour, minute=minute)
    return at if at > as_of else at + timedelta(days=1)


def _field(text: str, low: int, high: int, names: tuple[str, ...] = (), first: int = 0) -> set[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        number = lambda x: names.index(x) + first if x in names else int(x)
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = (number(x) for x in span.split("-"))
        else:
            a = number(span)
            b = high if step else a
        if not (low <= a <= high and low <= b <= high) or (step and int(step) < 1):
            raise ValueError(part)
        out.update(range(a, b + 1, int(step) if step else 1))
    return out


# Names for common expressions.
ALIASES = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}


def next_cron(as_of: datetime, expression: str) -> datetime | None:
    """The next minute after ``as_of`` that five fields allow, or None for what can't be read or never comes. With both day fields given either may hold."""
    try:
        minute, hour, dom, month, dow = ALIASES.get(expression.strip(), expression).split()
        minutes, hours, months = _field(minute, 0, 59), _field(hour, 0, 23), _field(month, 1, 12, MONTHS, 1)
        doms, dows = _field(dom, 1, 31), {d % 7 for d in _field(dow, 0, 7, DAYS)}
    except ValueError:
        return None
    any_dom, any_dow = dom in ("*", "?"), dow in ("*", "?")
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    start = as_of.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 8):
        in_dom, in_dow = day.day in doms, (day.weekday() + 1) % 7 in dows
        fits = (in_dom and in_dow) if any_dom or any_dow else (in_dom or in_dow)
        if day.month in months and fits:
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = day + timedelta(hours=h, minutes=m)
                    if at >= start:
                        return at
        day += timedelta(days=1)
    return None
