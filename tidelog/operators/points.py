"""Points of a series by thresholds, and differenced series, over (property, param1, param2, idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from .series import TSID

COMPARISONS = ("between", ">=", "<=")


def _compared(value: Column, operator: str, one: Column, other: Column | None) -> Column:
    if operator not in COMPARISONS:
        raise ValueError(f"operator must be one of {COMPARISONS}")
    if operator == "between":
        if other is None:
            raise ValueError("between needs two thresholds")
        return value.between(one, other)
    return value >= one if operator == ">=" else value <= one


def quantile_points(series: DataFrame, operator: str, one: float, other: float | None = None) -> DataFrame:
    """Points compared with quantiles of their series; a quantile that falls between two values is the higher one."""

    def quantile(q: float) -> Column:
        place = F.ceil((F.size("sorted") - 1) * F.lit(q)).cast("int")
        return F.element_at("sorted", place + 1)

    levels = series.groupBy(*TSID).agg(F.sort_array(F.collect_list("value")).alias("sorted"))  # as long as the grid
    levels = levels.select(*TSID, quantile(one).alias("one"), quantile(one if other is None else other).alias("other"))
    joined = series.alias("s").join(levels.alias("l"), [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in TSID])
    return joined.filter(_compared(F.col("value"), operator, F.col("one"), None if other is None else F.col("other"))).select("s.*")


def changes_beyond(series: DataFrame, operator: str, one: float, other: float | None = None) -> DataFrame:
    """Points whose relative change from the point before compares with the thresholds; value is the change. From 0 a change is infinite, of 0 to 0 it is none."""
    before = F.lag("value").over(Window.partitionBy(*TSID).orderBy("idx"))
    step = series.withColumn("before", before).filter("before is not null")
    sign = F.signum("value") * F.lit(float("inf"))
    change = F.when(F.col("before") != 0, F.try_divide(F.col("value") - F.col("before"), F.col("before"))).when(F.col("value") != 0, sign)
    changed = step.withColumn("value", change).drop("before").filter("value is not null")
    return changed.filter(_compared(F.col("value"), operator, F.lit(one), None if other is None else F.lit(other)))


def extremes(series: DataFrame, k: int, largest: bool) -> DataFrame:
    """The k largest or smallest points of each series; of equal ones the first."""
    order = F.col("value").desc() if largest else F.col("value").asc()
    return series.withColumn("rank", F.row_number().over(Window.partitionBy(*TSID).orderBy(order, "idx"))).filter(F.col("rank") <= k).drop("rank")


def differences(series: DataFrame, lag: int, times: int = 1) -> DataFrame:
    """The series differenced ``times`` times at a lag; points without a predecessor go."""
    w = Window.partitionBy(*TSID).orderBy("idx")
    for _ in range(times):
        series = series.withColumn("value", F.col("value") - F.lag("value", lag).over(w)).filter("value is not null")
    return series


def as_series(points: DataFrame, g: Grid, *more: str) -> DataFrame:
    """Points (property, param1, param2, idx, more) as series on the whole grid: 1 at a point, else 0. ``more`` names further columns that tell series apart."""
    ids = [*TSID, *more]
    wanted = points.select(*ids).distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(len(g.rights) - 1))))
    hits = points.select(*ids, "idx").distinct().withColumn("hit", F.lit(1.0))
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ids] + [F.col("w.idx") == F.col("h.idx")]
    joined = wanted.alias("w").join(hits.alias("h"), same, "left")
    return joined.select(*[F.col(f"w.{c}").alias(c) for c in ids], F.col("w.idx").alias("idx"), g.right(F.col("w.idx")).alias("t"), F.coalesce("h.hit", F.lit(0.0)).alias("value"))


def places(marked: DataFrame) -> DataFrame:
    """The points of a 0/1 series."""
    return marked.filter("value = 1").select(*TSID, "idx")


def causal_inputs(marked: DataFrame) -> DataFrame:
    """The 0/1 series that can be inputs of a causality test: with two points or more, and not a point everywhere."""
    w = Window.partitionBy(*TSID)
    counted = marked.withColumn("hits", F.sum("value").over(w)).withColumn("low", F.min("value").over(w))
    return counted.filter("hits > 1 and low = 0").drop("hits", "low")
