"""Instants and durations as epoch milliseconds, UTC."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.sources.tables import DAY_MS, HOUR_MS

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
_COUNT = r"(\d+|" + "|".join(NUMBERS[1:]) + ")"
_MONTH = "(" + "|".join(f"{m}|{m[:3]}" + ("|sept" if m == "september" else "") for m in MONTHS) + ")"
_WEEKDAY = "(" + "|".join((*WEEKDAYS, "tues", "thurs", "thur", *(d[:3] for d in WEEKDAYS))) + ")"
#: Days that messages are kept in each tier.
TTL_DAYS = {"free": 7, "starter": 30, "pro": 30, "ultra": 90, "unlimited": 365}


def age_days(now_ms: int, c: Column) -> Column:
    return (F.lit(now_ms) - c) / DAY_MS


def decayed(days: Column, k: float) -> Column:
    """exp(-k days), from 0 to 1; instants to come count as now."""
    return F.exp(-k * F.greatest(F.lit(0.0), days))


def day_key(c: Column) -> Column:
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")


def minute_text(c: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def day_start(c: Column) -> Column:
    return c - F.pmod(c, F.lit(DAY_MS))


def week_start(c: Column) -> Column:
    """Monday 00:00; 1970-01-01 was a Thursday."""
    return c - F.pmod(c + 3 * DAY_MS, F.lit(7 * DAY_MS))


def month_start(c: Column) -> Column:
    return F.unix_millis(F.date_trunc("month", F.timestamp_millis(c)))


def month_end(c: Column) -> Column:
    return F.unix_millis(F.date_trunc("month", F.add_months(F.date_trunc("month", F.timestamp_millis(c)), 1).cast("timestamp"))) - 1


def weekday_before(c: Column, weekday: int, today: bool) -> Column:
    """Start of the last day of this kind (0 Monday) before the instant, or on it if ``today``."""
    now = F.pmod(F.floor(c / DAY_MS) + 3, F.lit(7))
    back = F.pmod(now - weekday, F.lit(7))
    return day_start(c) - F.when(back == 0, 0 if today else 7).otherwise(back) * DAY_MS


def interval_tier(c: Column) -> Column:
    """Milliseconds between runs: rounded, from one hour to a day; what isn't a number is one hour."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, HOUR_MS).otherwise(F.least(F.lit(DAY_MS), F.greatest(F.lit(HOUR_MS), F.floor(c + 0.5)))).cast("long")


def runs_in(interval: Column, days: int) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(days * DAY_MS) / interval))


def expires_at(now: Column, tier: Column, days: Column | None = None) -> Column:
    """The instant at which a row of this tier goes; a positive ``days`` overrides the tier's."""
    by_tier = F.coalesce(*[F.when(tier == t, d) for t, d in TTL_DAYS.items()], F.lit(TTL_DAYS["free"]))
    own = by_tier if days is None else F.when(days > 0, days).otherwise(by_tier)
    return now + own.cast("long") * DAY_MS


def _ms(d: datetime) -> int:
    return int(d.timestamp() * 1000)


def _days(first: datetime, n: int = 1) -> tuple[int, int]:
    return _ms(first), _ms(first + timedelta(days=n)) - 1


def _month(year: int, month: int) -> tuple[int, int]:
    return _days(datetime(year, month, 1, tzinfo=UTC), calendar.monthrange(year, month)[1])


def _date(year: int, month: int, day: int) -> tuple[int, int] | None:
    try:
        return _days(datetime(year, month, day, tzinfo=UTC))
    except ValueError:
        return None


def _month_number(name: str) -> int:
    return next(i for i, m in enumerate(MONTHS, 1) if m[:3] == name[:3])


def parse_range(phrase: str | None, now_ms: int) -> tuple[int, int] | None:
    """The first and last millisecond that a phrase names, or None.  Rules in order: the first that matches decides.

    ISO date, today, yesterday, N days ago, last week, N weeks ago, last month,
    in or last <month>, written dates, on or last <weekday>.  Weeks begin on
    Monday; a date to come is last year's.
    """
    text = (phrase or "").strip().lower()
    now = datetime.fromtimestamp(now_ms / 1000, UTC)
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    week = today - timedelta(days=today.weekday())
    count = lambda s: int(s) if s.isdigit() else NUMBERS.index(s)
    if not text:
        return None
    if m := re.search(r"\b(\d{4})-(\d{2})-(\d{2})\b", text):
        return _date(*map(int, m.groups()))
    if "today" in text:
        return _days(today)
    if "yesterday" in text:
        return _days(today - timedelta(days=1))
    if (m := re.search(rf"\b{_COUNT}\s+days?\s+ago\b", text)) and count(m[1]):
        return _days(today - timedelta(days=count(m[1])))
    if "last week" in text:
        return _days(week - timedelta(days=7), 7)
    if (m := re.search(rf"\b{_COUNT}\s+weeks?\s+ago\b", text)) and count(m[1]):
        return _days(week - timedelta(days=7 * count(m[1])), 7)
    if "last month" in text:
        last = today.replace(day=1) - timedelta(days=1)
        return _month(last.year, last.month)
    if m := re.search(rf"\b(in|last)\s+{_MONTH}\b", text):
        month = _month_number(m[2])
        earlier = f"last {m[2]}" in text or month > now.month
        return _month(now.year - earlier, month)
    written = re.search(rf"\b{_MONTH}\s+(\d{{1,2}})(?:\s+(\d{{4}}))?\b", text)
    order = (1, 2, 3)
    if not written:
        written, order = re.search(rf"\b(\d{{1,2}})\s+{_MONTH}(?:\s+(\d{{4}}))?\b", text), (2, 1, 3)
    if written:
        month, day, year = (written[i] for i in order)
        month, day = _month_number(month), int(day)
        found = _date(int(year) if year else now.year, month, day)
        if found and not year and found[0] > now_ms:
            found = _date(now.year - 1, month, day)
        return found
    if m := re.search(rf"\b(on|last)\s+{_WEEKDAY}\b", text):
        wanted = next(i for i, d in enumerate(WEEKDAYS) if d[:3] == m[2][:3])
        back = (today.weekday() - wanted) % 7
        return _days(today - timedelta(days=back or (0 if m[1] == "on" else 7)))
    return None
