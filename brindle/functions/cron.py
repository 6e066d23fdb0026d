"""Cron schedules of five fields: minute, hour, day of month, month, day of week (0 is Sunday), in UTC.

Lists, ranges and steps; the day of month takes lists only. Both day fields must fit. The next time is
looked for from one minute after the given one, at most a year ahead, and keeps its seconds.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE_MS, HORIZON = 60_000, 365 * 24 * 60


class CronError(ValueError):
    pass


def _number(text: str) -> int:
    if not text.isdigit():
        raise CronError(f"not a number: {text!r}")
    return int(text)


def _field(text: str, low: int, high: int, lists_only: bool = False) -> frozenset[int]:
    found: set[int] = set()
    for part in text.split(","):
        if part == "*" and (lists_only or text == "*"):
            return frozenset(range(low, high + 1))
        if lists_only or not set(part) & set("/-"):
            value = _number(part)
            if not low <= value <= high:
                raise CronError(f"{value} is not from {low} to {high}")
            found.add(value)
            continue
        span, slash, step = part.partition("/")
        every = _number(step) if slash else 1
        if not every:
            raise CronError("a step can't be zero")
        first, dash, last = span.partition("-")
        start = low if span == "*" else _number(first)
        stop = _number(last) if dash else high
        found.update(v for v in range(start, stop + 1, every) if low <= v <= high)
    if not found:
        raise CronError(f"nothing fits {text!r}")
    return frozenset(found)


@dataclass(frozen=True)
class Cron:
    minutes: frozenset[int]
    hours: frozenset[int]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]

    @classmethod
    def parse(cls, text: str) -> Cron:
        parts = text.split()
        if len(parts) != 5:
            raise CronError(f"five fields are needed, not {len(parts)}")
        minute, hour, day, month, weekday = parts
        return cls(_field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31, True), _field(month, 1, 12), _field(weekday, 0, 6))

    def next_after(self, ms: int) -> int | None:
        """Epoch milliseconds of the first fitting minute; days and hours that don't fit are leapt over."""
        t = datetime.fromtimestamp(ms // 1000, UTC).replace(microsecond=ms % 1000 * 1000) + timedelta(minutes=1)
        end = t + timedelta(minutes=HORIZON)
        while t < end:
            if t.month not in self.months or t.day not in self.days or t.isoweekday() % 7 not in self.weekdays:
                t = (t + timedelta(days=1)).replace(hour=0, minute=0)
            elif t.hour not in self.hours:
                t = (t + timedelta(hours=1)).replace(minute=0)
            elif t.minute not in self.minutes:
                t += timedelta(minutes=1)
            else:
                return int(t.timestamp()) * 1000 + t.microsecond // 1000
        return None


@F.pandas_udf(T.LongType())
def next_fire(expressions, after_ms):
    """Next fire time of each row's expression after its time; null for what isn't a schedule or has none."""
    import pandas as pd

    known: dict[str, Cron | None] = {}

    def one(text, ms):
        if text not in known:
            try:
                known[text] = Cron.parse(text)
            except (CronError, AttributeError):
                known[text] = None
        return None if known[text] is None or pd.isna(ms) else known[text].next_after(int(ms))

    return pd.Series([one(e, m) for e, m in zip(expressions, after_ms)], dtype="Int64")
