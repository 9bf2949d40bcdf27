"""Time series in long form: (property, param1, param2, t, value), one row a series and interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid, interval

AGGREGATIONS = ("mean", "sum", "min", "max")
#: Properties whose empty intervals count as 0.
ZERO_FILLED = ("ep1", "op1", "rp2")
TSID = ("property", "param1", "param2")


def align(series: DataFrame, g: Grid, mode: str) -> DataFrame:
    """``series`` (property, param1, param2, day, value: one row a bucket) on the whole grid; series with an empty interval are dropped. Empty intervals of the zero-filled properties are 0, and under ``sum`` those between a series' own first and last bucket.

    Each row stands for its interval and the empty ones up to the next row, so series are read once.
    """
    n = len(g.rights)
    rows = series.withColumn("at", interval(F.col("day").cast("timestamp"), g))
    whole = Window.partitionBy(*TSID)
    along = whole.orderBy("at")
    rows = rows.withColumn("next", F.lead("at").over(along)).withColumn("first", F.min("at").over(whole)).withColumn("last", F.max("at").over(whole))
    always = F.col("property").isin(list(ZERO_FILLED))
    filled = always | F.lit(mode == "sum")
    rows = rows.withColumn("present", F.sum(F.when(F.col("at").between(0, n - 1) & (filled | F.col("value").isNotNull()), 1).otherwise(0)).over(whole))
    rows = rows.filter(always | (F.lit(mode == "sum") & (F.col("first") <= 0) & (F.col("last") >= n - 1)) | (F.col("present") == n))
    start = F.greatest(F.when(always & (F.col("at") == F.col("first")), F.lit(0)).otherwise(F.col("at")), F.lit(0))
    stop = F.when(F.col("next").isNotNull() & filled, F.col("next") - 1).when(F.col("next").isNull() & always, n - 1).otherwise(F.col("at"))
    spread = rows.withColumn("start", start).withColumn("stop", F.least(stop, F.lit(n - 1))).filter("start <= stop")
    each = spread.withColumn("idx", F.explode(F.sequence("start", "stop")))
    value = F.when(F.col("idx") == F.col("at"), F.coalesce("value", F.when(filled, 0.0))).otherwise(F.lit(0.0))
    return each.select(*TSID, "idx", g.right(F.col("idx")).alias("t"), value.alias("value"))


def analysable(series: DataFrame) -> DataFrame:
    """Values rounded to three places (half to even); constant series are dropped."""
    rounded = series.withColumn("value", F.bround("value", 3))
    w = Window.partitionBy(*TSID)
    return rounded.withColumn("low", F.min("value").over(w)).withColumn("high", F.max("value").over(w)).filter("low <> high").drop("low", "high")
