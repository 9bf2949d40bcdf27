"""Assignment of events and objects to intervals of a grid: (key, start, stop) rows get times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid, interval

MECHANISMS = ("starting", "ending", "contains", "overlaps")


def _within(ts: Column, g: Grid) -> Column:
    edge = lambda d: F.lit(d.isoformat()).cast("timestamp")
    return (ts > edge(g.left)) & (ts <= edge(g.rights[-1]))


def counts(start: Column, stop: Column, g: Grid, mechanism: str | None) -> Column:
    """Whether a row with these times counts anywhere on the grid, as ``assign`` has it."""
    if mechanism is None or mechanism == "starting":
        return _within(start, g)
    if mechanism == "ending":
        return _within(stop, g)
    if mechanism == "contains":
        return (interval(start, g) == interval(stop, g)) & _within(stop, g)
    if mechanism == "overlaps":
        return F.greatest(interval(start, g), F.lit(0)) <= F.least(interval(stop, g), F.lit(len(g.rights) - 1))
    raise ValueError(f"mechanism must be one of {MECHANISMS}")


def touched(rows: DataFrame, g: Grid) -> DataFrame:
    """``rows`` (start, stop, more) that touch the grid, with the numbers of the first and the last interval touched: low, high."""
    low, high = F.greatest(interval(F.col("start"), g), F.lit(0)), F.least(interval(F.col("stop"), g), F.lit(len(g.rights) - 1))
    return rows.withColumn("low", low).withColumn("high", high).filter("low <= high")


def each_interval(rows: DataFrame, g: Grid, low: str = "low", high: str = "high") -> DataFrame:
    """A row for each interval from low to high, with its right edge as ``t``."""
    rights = F.array(*[F.lit(d.isoformat()) for d in g.rights])
    at = rows.withColumn("at", F.explode(F.sequence(low, high)))
    return at.withColumn("t", F.element_at(rights, F.col("at") + 1).cast("timestamp")).drop(low, high, "at")


def assign(rows: DataFrame, g: Grid, mechanism: str | None) -> DataFrame:
    """``rows`` (start, stop, more) with ``t``, the time that a row counts at.

    starting: its start, if that lies in the grid; ending: its stop; contains: its stop, if one interval holds start
    and stop; overlaps: the right edge of every interval that it touches, a row each. None: for rows without duration,
    their start. Intervals are found by arithmetic on dates, without a join.
    """
    if mechanism == "overlaps":
        return each_interval(touched(rows, g), g)
    placed = rows.filter(counts(F.col("start"), F.col("stop"), g, mechanism))
    return placed.withColumn("t", F.col("start" if mechanism is None or mechanism == "starting" else "stop"))
