"""Registered queries of the event analytics: properties, assignments, predecessors and analyses over the order and event tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assignment import MECHANISMS, assign
from ..operators.changepoints import change_points
from ..operators.forecast import accuracy, forecasts, forecasts_with_causes
from ..operators.granger import granger
from ..operators.points import as_series, causal_inputs, changes_beyond, differences, extremes, quantile_points
from ..operators.preceding import preceding
from ..operators.properties import Properties
from ..operators.series import analysable
from ..operators.stationarity import differenced, orders
from ..operators.writeback import CHANGE_POINTS, DUMMY, FORECASTING, TECHNIQUES, THRESHOLD_POINTS, attribute_name, related, reload_causes, reload_forecasts, reload_marks, reload_series, with_causes, with_forecasts, with_points, with_series
from ..sources.log import SERIES_TYPE, VALUES, EventLog, atomic, events_log, held, orders_log, read_ocel_json, write_ocel_document, write_ocel_lines
from ..sources.scratch import shared_path, stored

Query = Callable[[SparkSession, str], DataFrame]

#: Of each property on the order log: rate, aggregation, mechanism, whether events are atomic.
ORDER_PROPERTIES = {
    "ep1": ("ME", "sum", "overlaps", True), "ep2": ("ME", "mean", "overlaps", True), "ep3": ("QE", "mean", "overlaps", True), "ep4": ("ME", "max", "overlaps", True),
    "op1": ("ME", "sum", "overlaps", True), "op2": ("ME", "mean", "overlaps", True), "op3": ("ME", "max", "overlaps", True), "op4": ("QE", "mean", "overlaps", True),
    "op5": ("ME", "mean", "overlaps", True), "op6": ("ME", "sum", "overlaps", True),
    "pp1": ("ME", "mean", "overlaps", True), "pp2": ("ME", "max", "overlaps", True), "pp3": ("ME", "mean", "starting", False), "pp4": ("ME", "mean", "ending", False),
    "pp5": ("ME", "mean", "overlaps", True), "pp6": ("ME", "mean", "overlaps", True), "pp7": ("ME", "mean", "overlaps", True),
    "rp1": ("ME", "mean", "overlaps", True), "rp2": ("ME", "sum", "overlaps", True), "rp3": ("YE", "mean", "overlaps", True),
}
RESOURCE = "supplier"
#: The object properties are registered by these names, as ``op<N>_`` names the corpus operators.
QUERY_NAMES = {
    "op1": "object_frequency", "op2": "object_attribute_value", "op3": "events_per_object", "op4": "events_of_type_per_object", "op5": "lifecycle_duration", "op6": "object_interactions",
}
EVENT_RATES = {"D": "daily", "W": "weekly", "ME": "monthly"}


def shown(series: DataFrame) -> DataFrame:
    """Days as text, values to six places."""
    return series.select("property", "param1", "param2", F.col("idx").cast("long").alias("idx"), F.date_format("t", "yyyy-MM-dd").alias("t"), F.round("value", 6).alias("value"))


def _property(name: str) -> Query:
    rate, mode, mechanism, still = ORDER_PROPERTIES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = orders_log(spark, sf_dir)
        return shown(getattr(Properties(spark, atomic(log) if still else log, rate, mode, mechanism, still, RESOURCE), name)())

    return query


#: Of each further query of one property of the order log: the property, rate, aggregation, mechanism, whether events are atomic. Daily spans touch up to 2400 intervals.
FURTHER = {
    "events_per_object_orders_daily": ("op3", "D", "mean", "overlaps", True),
    "lifecycle_duration_orders_daily": ("op5", "D", "sum", "overlaps", True),
    "object_frequency_orders_weekly": ("op1", "W", "sum", "overlaps", True),
    "object_attribute_value_orders_daily": ("op2", "D", "max", "overlaps", True),
    "events_of_type_per_object_orders_daily": ("op4", "D", "min", "overlaps", True),
    "rp2_orders_daily": ("rp2", "D", "sum", "overlaps", False),
    "ep1_orders_daily": ("ep1", "D", "sum", "overlaps", False),
    "ep2_orders_weekly": ("ep2", "W", "min", "overlaps", False),
    "pp4_orders_weekly": ("pp4", "W", "mean", "overlaps", False),
    "pp7_orders_starting": ("pp7", "ME", "sum", "starting", False),
}


def _further(name: str) -> Query:
    property, rate, mode, mechanism, still = FURTHER[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = orders_log(spark, sf_dir)
        return shown(Properties(spark, atomic(log) if still else log, rate, mode, mechanism, still, RESOURCE).collect([property]))

    return query


def all_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twenty properties of the order log with durations, by month, in one plan."""
    return shown(Properties(spark, orders_log(spark, sf_dir), "ME", "mean", "overlaps", False, RESOURCE).collect(list(ORDER_PROPERTIES)))


#: Of each query of a part of the order log: the properties, their rate, aggregation and what is selected.
SELECTIONS = {
    "dates": (("ep1", "pp1"), "ME", "mean", {"start": date(1996, 2, 10), "end": date(1997, 3, 20)}),
    "event_types": (("ep1", "ep4", "pp6"), "QE", "mean", {"event_types": ("ship item",)}),
    "object_types": (("op3", "op4", "op6", "ep4"), "QE", "mean", {"object_types": ("order", "supplier")}),
}


def _selected(name: str) -> Query:
    properties, rate, mode, chosen = SELECTIONS[name]
    return lambda spark, sf_dir: shown(Properties(spark, atomic(orders_log(spark, sf_dir)), rate, mode, **chosen).collect(list(properties)))


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series that the analyses below work on: monthly sums of events and quantities, rounded, none of them constant."""
    p = _monthly(spark, sf_dir)
    return analysable(p.collect(["ep1", "ep2"]))


def _events(rate: str, name: str) -> Query:
    return lambda spark, sf_dir: shown(getattr(Properties(spark, events_log(spark, sf_dir), rate, "mean"), name)())


def _assigned(mechanism: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = orders_log(spark, sf_dir)
        g = Properties(spark, log, "QE").grid
        rows = assign(log.lifecycles(), g, mechanism)
        return rows.groupBy("otype", F.date_format("t", "yyyy-MM-dd").alias("t")).agg(F.count("*").alias("n_objects"), F.sum("n_events").alias("n_events"))

    return query


def _preceding(still: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = orders_log(spark, sf_dir)
        pairs = preceding(atomic(log) if still else log, still)
        return pairs.select("eid", "prev_eid", F.array_join(F.sort_array("types"), ",").alias("types"))

    return query


def _points(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(order_series(spark, sf_dir)).select("property", "param1", "param2", F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value"))


def _monthly(spark: SparkSession, sf_dir: str) -> Properties:
    return Properties(spark, atomic(orders_log(spark, sf_dir)), "ME", "sum")


def drill_down_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events behind each event series of the order log, as the write-back links them."""
    p = _monthly(spark, sf_dir)
    return related(p, p.ep1())[0]


def drill_down_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects behind each object series of the order log, as the write-back links them."""
    p = _monthly(spark, sf_dir)
    return related(p, p.collect(["op1", "op6"]))[1]


def change_point_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_points(order_series(spark, sf_dir))


def difference_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(order_series(spark, sf_dir), "ME")


def causal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granger causality between the series after their seasonal and first differences, up to four lags."""
    series = held(order_series(spark, sf_dir))
    found = granger(differenced(series, orders(series, "ME")), 4, 0.05)
    return found.select(*[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("caused", "causing") for x in ("property", "param1", "param2")], F.array_join(F.col("lags").cast("array<string>"), ",").alias("lags"))


def causal_pairs_of_all_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granger causality between the series of all properties with durations, by all lags up to six, in blocks of 16 series."""
    series = held(analysable(Properties(spark, orders_log(spark, sf_dir), "ME", "mean", "overlaps", False, RESOURCE).collect(list(ORDER_PROPERTIES))))
    found = granger(differenced(series, orders(series, "ME")), 6, 0.01, block=16)
    return found.select(*[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("caused", "causing") for x in ("property", "param1", "param2")], F.array_join(F.col("lags").cast("array<string>"), ",").alias("lags"))


def forecast_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors on the last four months, of forecasts from the months before; with the causes as exogenous series where there are some."""
    series = held(order_series(spark, sf_dir))
    last = series.agg(F.max("idx")).first()[0]
    train = series.filter(F.col("idx") <= last - 4)
    periods = held(orders(train, "ME"))
    causes = held(granger(differenced(train, periods), 2, 0.05))
    alone = accuracy(series, forecasts(train, periods), train).withColumn("model", F.lit("alone"))
    return alone.unionByName(accuracy(series, forecasts_with_causes(train, periods, causes), train).withColumn("model", F.lit("with causes")))


NLARGEST = attribute_name(THRESHOLD_POINTS, "nlargest", 3)
NAIVE = attribute_name(FORECASTING, "seasonal naive", 12)


def _written(spark: SparkSession, sf_dir: str) -> tuple[EventLog, Properties]:
    """The order log with its series of events and objects, their three largest points as threshold points, their largest one as change point, the values of a year ago as forecasts of four months, and as causes of a series those that peaked before it, with the distance as lag."""
    p = _monthly(spark, sf_dir)
    # Objects and their lifecycles are made once: for the series, the objects behind them, the dummy events and the log's objects.
    p.lifecycles = stored(p.lifecycles)
    p.log = replace(p.log, objects=p.lifecycles.select("oid", "otype"))
    series = held(p.collect(["ep1", "op1"]))
    log = with_points(with_series(spark, p, series), extremes(analysable(series), 3, largest=True), p.grid, NLARGEST)
    peaks = held(extremes(analysable(series), 1, largest=True))
    log = with_points(log, peaks, p.grid, CHANGE_POINTS)
    n = len(p.grid.rights)
    naive = series.filter(F.col("idx").between(n - 12, n - 9)).withColumn("idx", F.col("idx") + 12).select("property", "param1", "param2", "idx", "value")
    id_ = F.struct("property", "param1", "param2")
    one, two = peaks.select(id_.alias("caused"), F.col("idx").alias("a")), peaks.select(id_.alias("causing"), F.col("idx").alias("b"))
    causes = one.join(two, F.col("a") > F.col("b")).select("caused", "causing", F.array(F.col("a") - F.col("b")).alias("lags"))
    return with_causes(with_forecasts(log, naive, p.grid, NAIVE), causes), p


def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the series objects of an enriched log."""
    rows = _written(spark, sf_dir)[0].object_attrs.filter(F.col("oid").startswith("ts&"))
    return rows.select("oid", "name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("value"))


def written_back_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each series object of an enriched log is linked to, dummy events apart."""
    rows = _written(spark, sf_dir)[0].relations.filter(F.col("otype") == SERIES_TYPE)
    return rows.groupBy("oid", "qualifier", F.col("eid").endswith("dummy_event").alias("dummy")).agg(F.count("*").alias("n_events"))


def written_back_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects each series object of an enriched log is linked to, and the causal links between series."""
    rows = _written(spark, sf_dir)[0].o2o.filter(F.col("oid").startswith("ts&"))
    other = F.when(F.col("oid_2").startswith("ts&"), F.col("oid_2")).otherwise("objects")
    return rows.groupBy("oid", "qualifier", other.alias("other")).agg(F.count("*").alias("n_links"))


def written_back_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir)[0].events.filter(F.col("activity") == DUMMY).select("eid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series, forecasts, 0/1 series of points and causes of an enriched log that was written to a file and read from it again."""
    log, p = _written(spark, sf_dir)
    path = shared_path(spark)
    write_ocel_lines(log, path, "gzip")
    again = read_ocel_json(spark, path, lines=True)
    # Read four times below: the values of series and of points and forecasts of them.
    of_series = reduce(Column.__or__, [F.col("name").startswith(t) for t in TECHNIQUES], F.col("name") == VALUES)
    again = replace(again, object_attrs=stored(again.object_attrs.filter(of_series)))
    parts = {"series": reload_series(again), "forecast": reload_forecasts(again, p.grid), "change point": reload_marks(again, CHANGE_POINTS, p.grid), "threshold point": reload_marks(again, THRESHOLD_POINTS, p.grid)}
    out = reload_causes(again).select(F.lit("cause").alias("part"), *[F.col(f"caused.{c}").alias(c) for c in ("property", "param1", "param2")], F.lit(None).cast("long").alias("idx"), F.concat_ws("&", "causing.property", "causing.param1", "causing.param2").alias("t"), F.col("lags")[0].cast("double").alias("value"))
    for part, rows in parts.items():
        out = out.unionByName(rows.select(F.lit(part).alias("part"), "property", "param1", "param2", F.col("idx").cast("long").alias("idx"), F.date_format("t", "yyyy-MM-dd").alias("t"), F.col("value").cast("double").alias("value")))
    return out


def log_of_a_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order log written as one OCEL document by many tasks and read from it by many tasks: events by activity and month, with their hours, objects and attribute values."""
    path = f"{shared_path(spark)}.json"
    write_ocel_document(orders_log(spark, sf_dir), path)
    log = read_ocel_json(spark, path)
    n, v = F.size("relationships"), F.aggregate("attributes", F.lit(0.0), lambda a, x: a + x["value"])
    rows = log.gathered().select("activity", "ts", "end_ts", F.when(n > 0, n).alias("n"), F.when(F.size("attributes") > 0, v).alias("v"))
    took = (F.unix_micros("end_ts") - F.unix_micros("ts")) / 3_600_000_000
    sums = {"n_events": F.count("*"), "n_objects": F.sum("n"), "hours": F.sum(took.cast("long")), "total": F.round(F.sum("v"), 2)}
    return rows.groupBy("activity", F.date_format("ts", "yyyy-MM").alias("month")).agg(*[v.alias(k) for k, v in sums.items()])


def points_as_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest points of each series as 0/1 series, those that can be inputs of a causality test."""
    p = _monthly(spark, sf_dir)
    points = extremes(analysable(p.collect(["ep1", "ep2"])), 3, largest=True)
    return shown(causal_inputs(as_series(points, p.grid)))


QUERIES: dict[str, Query] = {
    **{f"{QUERY_NAMES.get(name, name)}_orders": _property(name) for name in ORDER_PROPERTIES},
    **{f"ep1_events_{word}": _events(rate, "ep1") for rate, word in EVENT_RATES.items() if rate != "ME"},
    **{f"ep2_events_{word}": _events(rate, "ep2") for rate, word in EVENT_RATES.items() if rate != "ME"},
    **{f"assign_{m}": _assigned(m) for m in MECHANISMS},
    **{name: _further(name) for name in FURTHER},
    "all_properties_orders": all_properties,
    "preceding_atomic": _preceding(True),
    "preceding_timed": _preceding(False),
    "analysable_series": _points(lambda s: s),
    "points_above_quantile": _points(lambda s: quantile_points(s, ">=", 0.9)),
    "points_between_quantiles": _points(lambda s: quantile_points(s, "between", 0.25, 0.5)),
    "points_relative_change": _points(lambda s: changes_beyond(s, ">=", 0.05)),
    "points_largest": _points(lambda s: extremes(s, 3, largest=True)),
    "points_smallest": _points(lambda s: extremes(s, 3, largest=False)),
    "seasonal_difference": _points(lambda s: differences(s, 12)),
    "second_difference": _points(lambda s: differences(s, 1, 2)),
    "drill_down_events": drill_down_events,
    "drill_down_objects": drill_down_objects,
    **{f"selected_{name}_orders": _selected(name) for name in SELECTIONS},
    "change_points": change_point_places,
    "difference_orders": difference_orders,
    "causal_pairs": causal_pairs,
    "causal_pairs_of_all_properties": causal_pairs_of_all_properties,
    "forecast_accuracy": forecast_accuracy,
    "written_back": written_back,
    "written_back_relations": written_back_relations,
    "written_back_links": written_back_links,
    "written_back_dummies": written_back_dummies,
    "reloaded": reloaded,
    "points_as_series": points_as_series,
    "log_of_a_document": log_of_a_document,
}
