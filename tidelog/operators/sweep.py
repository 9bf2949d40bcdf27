"""Aggregates of spans over the intervals of a grid, without a row for each interval that a span touches.

Sums of whole numbers: a span adds its value at its first interval and takes it back behind its last one; these
differences are added up by series and place, and a running sum along the grid gives every interval. Minima, maxima and
sums of fractions, which can't be taken back exactly: a span is cut into at most 2 log2(n) aligned blocks of 1, 2, 4 ...
intervals, blocks are aggregated, and an interval is made of the blocks that hold it. What follows the first aggregation
is as large as series times grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("param1", "param2")
#: Of each aggregate: how values become one, and how parts become a whole.
STATS = {"n": (F.count, F.sum), "total": (F.sum, F.sum), "least": (F.min, F.min), "most": (F.max, F.max)}


def differences(spans: DataFrame, n: int) -> DataFrame:
    """``spans`` (param1, param2, low, high, v: whole numbers) to (param1, param2, idx, n, total) of each of ``n`` intervals with a span."""
    mark = lambda at, sign: F.struct(F.expr(at).alias("at"), F.lit(sign).alias("n"), (F.col("v") * sign).alias("v"))
    marks = spans.filter("v is not null").select(*KEYS, F.inline(F.array(mark("low", 1), mark("high + 1", -1))))
    steps = marks.groupBy(*KEYS, "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    along = Window.partitionBy(*KEYS).orderBy("at")
    level = steps.select(*KEYS, "at", F.sum("n").over(along).alias("n"), F.sum("v").over(along).alias("total"), F.lead("at", 1, n).over(along).alias("stop"))
    return level.filter("n > 0").select(*KEYS, F.explode(F.expr("sequence(at, stop - 1)")).alias("idx"), "n", "total")


def blocks(low: Column, high: Column, n: int) -> Column:
    """The aligned blocks (level, block) that make up the intervals from low to high of ``n``: block b of a level has the 2^level intervals from b * 2^level on."""
    out = []
    for level in range(max(1, n.bit_length())):
        left, right = F.shiftright(low + ((1 << level) - 1), level), F.shiftright(high + 1, level)
        some = left < right
        out.append(F.when(some & (left % 2 == 1), F.struct(F.lit(level).alias("level"), left.alias("block"))))
        out.append(F.when(some & (right % 2 == 1), F.struct(F.lit(level).alias("level"), (right - 1).alias("block"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def dyadic(spans: DataFrame, n: int) -> DataFrame:
    """``spans`` (param1, param2, low, high, v) to (param1, param2, idx, n, total, least, most) of each of ``n`` intervals with a span."""
    # Spans of the same intervals are one before they are cut, so that what is cut is bounded by types and grid.
    same = spans.filter("v is not null").groupBy(*KEYS, "low", "high").agg(*[f("v").alias(c) for c, (f, _) in STATS.items()])
    cut = same.select(*KEYS, *STATS, F.inline(blocks(F.col("low"), F.col("high"), n)))
    of_blocks = cut.groupBy(*KEYS, "level", "block").agg(*[f(c).alias(c) for c, (_, f) in STATS.items()])
    first = F.expr("shiftleft(block, level)")
    last = F.least(F.expr("shiftleft(block + 1, level)") - 1, F.lit(n - 1))
    each = of_blocks.withColumn("idx", F.explode(F.sequence(first, last)))
    return each.groupBy(*KEYS, "idx").agg(*[f(c).alias(c) for c, (_, f) in STATS.items()])
