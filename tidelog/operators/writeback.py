"""Series and results written back into a log as objects, attribute histories and relations, and read from it again."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid, interval
from ..sources.log import EPOCH, SERIES_TYPE, VALUES, EventLog, held
from .points import as_series
from .properties import NAMES, Properties

DUMMY = "dummy"
CAUSED = "Granger caused by (with lags: "
CHANGE_POINTS, THRESHOLD_POINTS, GRANGER, FORECASTING = TECHNIQUES = ("Change Point Detection", "Threshold Based Point Detection", "Granger Causality", "Forecasting")


def series_id() -> Column:
    """``ts&property&param1|param2``; the names of types must not have the two separators."""
    return F.concat_ws("&", F.lit("ts"), F.col("property"), F.concat_ws("|", "param1", "param2"))


def attribute_name(technique: str, *params: object) -> str:
    return f"{technique}({', '.join(str(p) for p in params if p is not None)})"


def _attr(oid: Column, name: str, ts: Column, value: Column) -> list[Column]:
    return [oid.alias("oid"), F.lit(name).alias("name"), ts.cast("timestamp").alias("ts"), (ts.cast("timestamp") > F.lit(EPOCH).cast("timestamp")).alias("changed"), value.cast("double").alias("value")]


def _initial(ids: DataFrame, name: str) -> DataFrame:
    return ids.select(*_attr(F.col("oid"), name, F.lit(EPOCH), F.lit(0)))


def _of_objects() -> Column:
    return F.col("property").startswith("op") | F.col("property").isin("rp2", "rp3")


def related(p: Properties, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series oid, eid) of series of events and (series oid, oid) of series of objects: what is behind each of them."""
    ids = held(series.select("property", "param1", "param2", series_id().alias("series")).distinct())
    of_objects = _of_objects()
    events = p.counted_events.withColumnRenamed("activity", "param1")
    by_event = events.join(ids.filter(~of_objects), "param1").select("series", "eid")
    types = F.when(F.col("property") == "op6", F.array_distinct(F.array("param1", "param2"))).otherwise(F.array("param1"))
    wanted = ids.filter(of_objects).select("series", F.explode(types).alias("otype"), F.col("property").isin("op6", "rp2").alias("wide"), (F.size(types) > 1).alias("several"))
    if p.mechanism == "overlaps":
        found = p.counted_objects.join(held(wanted), "otype")
    else:
        overlapping = replace(p, mechanism="overlaps").counted_objects
        objects = p.counted_objects.withColumn("wide", F.lit(False)).unionByName(overlapping.withColumn("wide", F.lit(True)))
        found = objects.join(held(wanted), ["otype", "wide"])
    # An object has one row for each of its types, so only a series of several types could have it twice.
    twice = found.filter("several").select("series", "oid").distinct()
    return by_event, found.filter("not several").select("series", "oid").unionByName(twice)


def with_series(spark: SparkSession, p: Properties, series: DataFrame) -> EventLog:
    """The log with an object for each series: its values as the history of an attribute, relations from the events behind it or to the objects behind it. Series of objects hang on two dummy events at the ends of the grid, as objects without events would be lost on reading."""
    log, g = p.log, p.grid
    ids = held(series.select("property", "param1", "param2", series_id().alias("oid")).distinct())
    by_event, by_object = related(p, series)
    name = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))])
    qualifier = ids.select("oid", F.concat_ws("&", F.lit("ts"), F.lit(p.rate), F.lit(p.mode), name[F.col("property")], F.concat_ws("|", "param1", "param2")).alias("qualifier"))
    relation = lambda rows: rows.join(qualifier, "oid").select("eid", "oid", F.lit(SERIES_TYPE).alias("otype"), "qualifier")
    ends = [("start_dummy_event", datetime(g.left.year, g.left.month, g.left.day) + timedelta(seconds=1)), ("end_dummy_event", datetime(g.rights[-1].year, g.rights[-1].month, g.rights[-1].day) - timedelta(seconds=1))]
    dummies = spark.range(2).select(F.when(F.col("id") == 0, ends[0][0]).otherwise(ends[1][0]).alias("eid"), F.lit(DUMMY).alias("activity"), F.when(F.col("id") == 0, F.lit(ends[0][1])).otherwise(F.lit(ends[1][1])).alias("ts"))
    objects_only = by_object.select(F.col("series").alias("oid")).distinct()
    on_dummies = objects_only.select("oid", F.explode(F.array(*[F.lit(e) for e, _ in ends])).alias("eid"))
    relations = log.relations.unionByName(relation(by_event.withColumnRenamed("series", "oid"))).unionByName(relation(on_dummies))
    links = by_object.withColumnRenamed("oid", "oid_2").join(qualifier, F.col("series") == F.col("oid")).select("oid", "oid_2", "qualifier")
    values = series.select(*_attr(series_id(), VALUES, F.col("t"), F.col("value")))
    events, own = log.events.unionByName(dummies.withColumn("end_ts", F.col("ts"))), log.in_rows()

    def rows() -> DataFrame:
        """The rows of the log's events with the series that they are behind, and those of the dummy events."""
        link = F.struct("oid", "qualifier")
        behind = ids.filter(~_of_objects()).join(qualifier, "oid").groupBy(F.col("param1").alias("activity")).agg(F.collect_list(link).alias("series"))
        none, links = F.array().cast("array<struct<oid:string,qualifier:string>>"), F.col("relationships")
        more = F.when(p.event_counts, F.coalesce("series", none)).otherwise(none)
        with_own = own.join(F.broadcast(behind), "activity", "left").withColumn("relationships", F.concat(F.coalesce(links, none), more)).drop("series")
        of_dummies = dummies.join(on_dummies.join(qualifier, "oid").groupBy("eid").agg(F.collect_list(link).alias("relationships")), "eid", "left")
        return with_own.unionByName(of_dummies.withColumn("end_ts", F.col("ts")), allowMissingColumns=True)

    return replace(
        log,
        events=events,
        relations=relations,
        together=None,
        listed=None if own is None else (events, relations, log.event_attrs, rows),
        objects=log.objects.unionByName(ids.select("oid", F.lit(SERIES_TYPE).alias("otype"))),
        object_attrs=log.object_attrs.unionByName(values).unionByName(_initial(ids, VALUES)),
        o2o=log.o2o.unionByName(links),
    )


def with_points(log: EventLog, points: DataFrame, g: Grid, name: str) -> EventLog:
    """Points (property, param1, param2, idx) as an attribute that is 0 at first, 1 from a second before the end of a point's interval, and 0 again from a second before the end of the next one that isn't a point."""
    ids = points.select(series_id().alias("oid"), "idx").distinct()
    after = ids.select("oid", (F.col("idx") + 1).alias("idx")).join(ids, ["oid", "idx"], "left_anti")
    at = g.right(F.col("idx")).cast("timestamp") - F.expr("interval 1 second")
    rows = ids.withColumn("v", F.lit(1)).unionByName(after.withColumn("v", F.lit(0)))
    return replace(log, object_attrs=log.object_attrs.unionByName(rows.select(*_attr(F.col("oid"), name, at, F.col("v")))).unionByName(_initial(ids.select("oid").distinct(), name)))


def with_forecasts(log: EventLog, forecasts: DataFrame, g: Grid, name: str) -> EventLog:
    """Forecasts (property, param1, param2, idx, value) as an attribute at the ends of their intervals, 0 at first."""
    at = g.right(F.col("idx"))
    ids = forecasts.select(series_id().alias("oid")).distinct()
    return replace(log, object_attrs=log.object_attrs.unionByName(forecasts.select(*_attr(series_id(), name, at, F.col("value")))).unionByName(_initial(ids, name)))


def with_causes(log: EventLog, causes: DataFrame) -> EventLog:
    """Results of ``granger`` as relations from the caused series to the causing ones."""
    id_of = lambda c: F.concat_ws("&", F.lit("ts"), F.col(f"{c}.property"), F.concat_ws("|", F.col(f"{c}.param1"), F.col(f"{c}.param2")))
    rows = causes.select(id_of("caused").alias("oid"), id_of("causing").alias("oid_2"), F.concat(F.lit(CAUSED), F.array_join(F.col("lags").cast("array<string>"), ", "), F.lit(")")).alias("qualifier"))
    return replace(log, o2o=log.o2o.unionByName(rows))


def _parsed(rows: DataFrame, oid: str = "oid") -> DataFrame:
    """With property, param1 and param2 of a series id."""
    parts, params = F.split(oid, "&", 3), F.split(F.split(F.col(oid), "&", 3)[2], r"\|")
    return rows.withColumn("property", parts[1]).withColumn("param1", params[0]).withColumn("param2", F.get(params, F.lit(1)))


def reload_series(log: EventLog) -> DataFrame:
    """(property, param1, param2, idx, t, value) of the series that a log carries."""
    rows = _parsed(log.object_attrs.filter((F.col("name") == VALUES) & F.col("changed")))
    idx = F.row_number().over(Window.partitionBy("oid").orderBy("ts")) - 1
    return rows.withColumn("idx", idx).select("property", "param1", "param2", "idx", F.to_date("ts").alias("t"), "value")


def reload_points(log: EventLog, technique: str) -> DataFrame:
    """(property, param1, param2, name, ts) of the points that a log carries by a technique."""
    return _parsed(log.object_attrs.filter(F.col("name").startswith(technique) & (F.col("value") == 1))).select("property", "param1", "param2", "name", "ts")


def reload_marks(log: EventLog, technique: str, g: Grid) -> DataFrame:
    """The points of a technique as 0/1 series (property, param1, param2, idx, t, value) on the grid. Threshold points are series of their own, with their parameters in the property; change points go with the series that they are of."""
    points = reload_points(log, technique).withColumn("idx", interval(F.col("ts") + F.expr("interval 1 second"), g))
    marked = as_series(points.filter(F.col("idx").between(0, len(g.rights) - 1)), g, "name")
    if technique == THRESHOLD_POINTS:
        params = F.substring("name", len(technique) + 1, 1 << 20)
        marked = marked.withColumn("property", F.concat(F.lit("Threshold Based Points "), params, F.lit(" for "), F.col("property")))
    return marked.drop("name")


def reload_forecasts(log: EventLog, g: Grid) -> DataFrame:
    """(property, param1, param2, idx, t, value) of the forecasts that a log carries."""
    rows = _parsed(log.object_attrs.filter(F.col("name").startswith(FORECASTING) & F.col("changed")))
    return rows.select("property", "param1", "param2", interval(F.col("ts"), g).alias("idx"), F.to_date("ts").alias("t"), "value")


def refuse_repetition(log: EventLog, technique: str, *params: object) -> None:
    """An analysis that a log carries already isn't run on it again; threshold points may be, with other parameters."""
    if technique not in TECHNIQUES:
        raise ValueError(f"technique must be one of {TECHNIQUES}")
    if technique == GRANGER:
        again = log.o2o.filter(F.col("qualifier").startswith(CAUSED))
    elif technique == THRESHOLD_POINTS:
        again = log.object_attrs.filter(F.col("name") == attribute_name(technique, *params))
    else:
        again = log.object_attrs.filter(F.col("name").startswith(technique))
    if not again.isEmpty():
        raise ValueError(f"the log has results of {technique} already")


def reload_causes(log: EventLog) -> DataFrame:
    """(caused, causing, lags) of the causal relations that a log carries."""
    rows = log.o2o.filter(F.col("qualifier").startswith(CAUSED))
    struct = lambda c: F.struct(*[F.col(f"{c}.{x}") for x in ("property", "param1", "param2")])
    one = _parsed(rows, "oid").select("oid_2", "qualifier", F.struct("property", "param1", "param2").alias("caused"))
    both = _parsed(one, "oid_2").select(struct("caused").alias("caused"), F.struct("property", "param1", "param2").alias("causing"), "qualifier")
    lags = F.split(F.regexp_extract("qualifier", r"lags: (.*)\)", 1), ", ").cast("array<int>")
    return both.select("caused", "causing", lags.alias("lags"))
