"""Sampling rates: the grid of intervals of a time window, and the interval and bucket of a timestamp as expressions."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAILY, WEEKLY, MONTHLY, QUARTERLY, YEARLY = "D", "W", "ME", "QE", "YE"
RATES = (DAILY, WEEKLY, MONTHLY, QUARTERLY, YEARLY)
LEAST_INTERVALS, LEAST_FOR_FORECAST = 4, 13


def period_end(day: date, rate: str) -> date:
    """The last day of the period that the day lies in."""
    if rate == DAILY:
        return day
    if rate == WEEKLY:
        return day + timedelta((6 - day.weekday()) % 7)
    month = {MONTHLY: day.month, QUARTERLY: (day.month + 2) // 3 * 3, YEARLY: 12}[rate]
    return date(day.year, month, calendar.monthrange(day.year, month)[1])


@dataclass(frozen=True)
class Grid:
    """Intervals (left, right], edges at midnight; ``edges`` are their right edges after the first left one."""

    rate: str
    edges: tuple[date, ...]

    @property
    def left(self) -> date:
        return self.edges[0]

    @property
    def rights(self) -> tuple[date, ...]:
        return self.edges[1:]

    def needs_forecast_length(self) -> None:
        """Forecasts and Granger tests need more intervals than the other analyses."""
        if len(self.rights) < LEAST_FOR_FORECAST:
            raise ValueError(f"{len(self.rights)} intervals; {LEAST_FOR_FORECAST} are the least for forecasts and causality")

    def right(self, idx: Column) -> Column:
        """The right edge of an interval by its number, behind the grid too, as a day."""
        first = F.lit(self.rights[0].isoformat()).cast("date")
        months = {MONTHLY: 1, QUARTERLY: 3, YEARLY: 12}.get(self.rate)
        idx = idx.cast("int")
        return F.last_day(F.add_months(F.trunc(first, "month"), idx * months)) if months else F.date_add(first, idx * (7 if self.rate == WEEKLY else 1))


def grid(first: date, last: date, rate: str) -> Grid:
    """The grid from the day ``first`` to the day ``last``.

    It starts at the last period end that isn't after ``first``; a quarterly grid that would start within the third
    month of a quarter, after its first day, starts at that quarter's end. It stops at the first period end that isn't
    before ``last``, a weekly one at the first Sunday after it.
    """
    if rate not in RATES:
        raise ValueError(f"rate must be one of {RATES}")
    end = period_end(first, rate)
    if rate == QUARTERLY and first.month % 3 == 0 and first.day >= 2:
        left = end
    elif end == first:
        left = first
    else:
        start = {WEEKLY: first - timedelta(first.weekday()), MONTHLY: first.replace(day=1), QUARTERLY: date(first.year, (first.month - 1) // 3 * 3 + 1, 1), YEARLY: date(first.year, 1, 1)}[rate]
        left = start - timedelta(1)
    stop = period_end(last + timedelta(1) if rate == WEEKLY else last, rate)
    edges = [left]
    while edges[-1] < stop:
        edges.append(period_end(edges[-1] + timedelta(1), rate))
    if len(edges) - 1 < LEAST_INTERVALS:
        raise ValueError(f"{len(edges) - 1} intervals; {LEAST_INTERVALS} are the least")
    return Grid(rate, tuple(edges))


def label(ts: Column, rate: str) -> Column:
    """The day that names the bucket of a timestamp. Daily buckets run from after midnight to the next midnight, the others over whole days."""
    day = F.to_date(ts)
    return {
        DAILY: F.date_add(F.to_date(F.timestamp_micros(F.unix_micros(ts) - 1)), 1),
        WEEKLY: F.next_day(F.date_sub(day, 1), "SU"),
        MONTHLY: F.last_day(day),
        QUARTERLY: F.last_day(F.add_months(F.trunc(day, "quarter"), 2)),
        YEARLY: F.make_date(F.year(day), F.lit(12), F.lit(31)),
    }[rate]


def interval(ts: Column, g: Grid) -> Column:
    """The number of the interval (left, right] that holds a timestamp: below 0 before the grid, the number of intervals or more behind it."""
    up = F.date_add(F.to_date(F.timestamp_micros(F.unix_micros(ts) - 1)), 1)  # the first midnight at or after it
    number = {
        DAILY: F.datediff(up, F.lit("1970-01-01").cast("date")),
        WEEKLY: F.ceil((F.datediff(up, F.lit("1970-01-01").cast("date")) - 3) / 7),
        MONTHLY: F.year(up) * 12 + F.month(up),
        QUARTERLY: F.year(up) * 4 + F.quarter(up),
        YEARLY: F.year(up),
    }[g.rate]
    day = g.rights[0]
    first = {DAILY: (day - date(1970, 1, 1)).days, WEEKLY: -(-((day - date(1970, 1, 1)).days - 3) // 7), MONTHLY: day.year * 12 + day.month, QUARTERLY: day.year * 4 + (day.month + 2) // 3, YEARLY: day.year}[g.rate]
    return (number - first).cast("int")
