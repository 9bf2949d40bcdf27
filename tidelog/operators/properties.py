"""The measurable properties of a log as resampled series: events (ep), objects (op), performance (pp), resources (rp)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid, grid, interval, label
from ..sources.log import EventLog
from ..sources.scratch import stored
from .assignment import assign, counts, touched
from .preceding import events_with_ends
from .series import AGGREGATIONS, TSID, align
from .sweep import differences, dyadic

NAMES = {
    "ep1": "Event Frequency", "ep2": "Event Attribute Value", "ep3": "Number of Objects per Event", "ep4": "Number of Objects of a Type per Event",
    "op1": "Object Frequency", "op2": "Object Attribute Value", "op3": "Number of Events per Object", "op4": "Number of Events of a Type per Object",
    "op5": "Lifecycle Duration", "op6": "Object Interactions per Event",
    "pp1": "Waiting Time", "pp2": "Synchronization Time", "pp3": "Service Time", "pp4": "Sojourn Time", "pp5": "Flow Time", "pp6": "Pooling Time", "pp7": "Lagging Time",
    "rp1": "Involved Resources per Event", "rp2": "Active Resources", "rp3": "Resource Attribute Value",
}


#: Properties whose values are durations: whole microseconds until they are aggregated.
DURATIONS = ("op5", "pp1", "pp2", "pp3", "pp4", "pp5", "pp6", "pp7")
#: Properties whose parameters are pairs of types that go together; what isn't there counts as 0.
SPARSE = ("ep4", "op4", "pp6", "pp7")
OF_EVENTS = ("ep1", "ep3", "ep4", "op6", "pp1", "pp2", "pp3", "pp4", "pp5", "pp6", "pp7")
#: Those that look at the events before an event.
AFTER_OTHERS = ("pp1", "pp2", "pp4", "pp5", "pp6", "pp7")
OF_OBJECTS = ("op1", "op3", "op4", "op5")
#: Properties made of the series of others.
DERIVED = {"rp1": "ep4", "rp3": "op2"}
_ENTRY = "array<struct<property:string,param1:string,param2:string,v:bigint>>"


def _entry(property: str, param1: str, param2: str, v: str) -> str:
    return f"named_struct('property', '{property}', 'param1', {param1}, 'param2', cast({param2} as string), 'v', cast({v} as bigint))"


_PAIRS = "flatten(transform(types, (a, i) -> transform(slice(types, i + 1, size(types)), b -> struct(a.otype as one, b.otype as two, if(a.otype = b.otype, a.n * (a.n - 1) div 2, a.n * b.n) as n))))"
#: What an event (activity, start and stop in microseconds, types: counts of its objects, latest and earliest end of its predecessors, links: by type their latest and earliest end and the earliest end of the others) or an object (otype, by_activity) gives to each property. A null second parameter of a sparse property stands for all of them.
_ENTRIES = {
    "ep1": f"array({_entry('ep1', 'activity', 'null', '1')})",
    "ep3": f"if(types is null, array(), array({_entry('ep3', 'activity', 'null', 'aggregate(types, 0L, (a, x) -> a + x.n)')}))",
    "ep4": f"if(types is null, array(), concat(array({_entry('ep4', 'activity', 'null', '0')}), transform(types, x -> {_entry('ep4', 'activity', 'x.otype', 'x.n')})))",
    "op6": f"if(types is null, array(), transform(filter({_PAIRS}, x -> x.n > 0), x -> {_entry('op6', 'x.one', 'x.two', 'x.n')}))",
    "pp1": f"array({_entry('pp1', 'activity', 'null', 'coalesce(start - latest, 0)')})",
    "pp2": f"array({_entry('pp2', 'activity', 'null', 'coalesce(latest - earliest, 0)')})",
    "pp3": f"array({_entry('pp3', 'activity', 'null', 'stop - start')})",
    "pp4": f"array({_entry('pp4', 'activity', 'null', 'stop - coalesce(latest, start)')})",
    "pp5": f"array({_entry('pp5', 'activity', 'null', 'stop - coalesce(earliest, start)')})",
    "pp6": f"concat(array({_entry('pp6', 'activity', 'null', '0')}), coalesce(transform(links, y -> {_entry('pp6', 'activity', 'y.otype', 'y.hi - y.lo')}), array()))",
    "pp7": f"concat(array({_entry('pp7', 'activity', 'null', '0')}), coalesce(transform(links, y -> {_entry('pp7', 'activity', 'y.otype', 'greatest(coalesce(y.hi - y.other, 0), 0)')}), array()))",
    "op1": f"array({_entry('op1', 'otype', 'null', '1')})",
    "op3": f"array({_entry('op3', 'otype', 'null', 'n_events')})",
    "op4": f"concat(array({_entry('op4', 'otype', 'null', '0')}), transform(by_activity, x -> {_entry('op4', 'otype', 'x.activity', 'x.n')}))",
    "op5": f"array({_entry('op5', 'otype', 'null', 'unix_micros(stop) - unix_micros(start)')})",
}


def _chosen(rows: DataFrame, column: str, values: tuple[str, ...] | None) -> DataFrame:
    return rows if values is None else rows.filter(F.col(column).isin(list(values)))


@dataclass
class Properties:
    """Properties of ``log`` on a grid of ``rate``, aggregated by ``mode``; ``mechanism`` says when objects, and events with a duration, count. Each method gives the series on the whole grid.

    The grid spans the days from ``start`` to ``end``; without them, all events. ``event_types`` and ``object_types``
    select series by their parameters; op6 and rp2 look at events of all types. A selection restricts the rows that are
    read, not what a value is made of: preceding events and lifecycles are those of the whole log.
    """

    spark: SparkSession
    log: EventLog
    rate: str
    mode: str = "mean"
    mechanism: str = "overlaps"
    is_atomic: bool = True
    resource_type: str | None = None
    start: date | None = None
    end: date | None = None
    event_types: tuple[str, ...] | None = None
    object_types: tuple[str, ...] | None = None

    @cached_property
    def grid(self) -> Grid:
        first, last = (self.start, self.end) if self.start and self.end else self.log.bounds()
        return grid(self.start or first, self.end or last, self.rate)

    @property
    def counted_events(self) -> DataFrame:
        """(eid, activity) of the selected events that count anywhere on the grid."""
        rows = _chosen(self.log.events.select("eid", "activity", F.col("ts").alias("start"), F.col("end_ts").alias("stop")), "activity", self.event_types)
        return self._placed(rows, self.spans_events, None if self.is_atomic else self.mechanism).select("eid", "activity")

    @property
    def event_counts(self) -> Column:
        """Whether an event (activity, ts, end_ts) is one of those."""
        chosen = F.lit(True) if self.event_types is None else F.col("activity").isin(list(self.event_types))
        return F.coalesce(chosen & counts(F.col("ts"), F.col("end_ts"), self.grid, "overlaps" if self.spans_events else None if self.is_atomic else self.mechanism), F.lit(False))

    @property
    def counted_objects(self) -> DataFrame:
        """(oid, otype) of the selected objects that count anywhere on the grid."""
        return self._placed(self.lifecycles, self.mechanism == "overlaps", self.mechanism).select("oid", "otype")

    @cached_property
    def lifecycles(self) -> DataFrame:
        return _chosen(self.log.lifecycles(), "otype", self.object_types)

    @cached_property
    def object_times(self) -> DataFrame:
        return assign(self.lifecycles, self.grid, self.mechanism)

    @property
    def combinations(self) -> DataFrame:
        return _chosen(_chosen(self.log.combinations, "activity", self.event_types), "otype", self.object_types)

    @property
    def spans_events(self) -> bool:
        """Whether an event counts in each interval that it overlaps."""
        return not self.is_atomic and self.mechanism == "overlaps"

    def _placed(self, rows: DataFrame, spans: bool, mechanism: str | None) -> DataFrame:
        """``rows`` (start, stop, more) with their place: low and high, the intervals that they overlap, or day, the name of the bucket that they count in."""
        if spans:
            return touched(rows, self.grid)
        return assign(rows, self.grid, mechanism).withColumn("day", label(F.col("t"), self.rate)).drop("t")

    def _events(self, properties: list[str]) -> DataFrame:
        """(property, param1, param2, v, place) of properties of events, from one row an event."""
        after = [p for p in properties if p in AFTER_OTHERS]
        if after and len(after) < len(properties):
            return self._events([p for p in properties if p not in after]).unionByName(self._events(after))
        if after:
            rows = events_with_ends(self.log, self.is_atomic, bool({"pp6", "pp7"} & set(properties)), "pp7" in properties)
            rows = rows.withColumn("start", F.timestamp_micros("start")).withColumn("stop", F.timestamp_micros("stop"))
        else:
            rows = self.log.with_types() if {"ep3", "ep4", "op6"} & set(properties) else self.log.events
            rows = rows.withColumnsRenamed({"ts": "start", "end_ts": "stop"})
        if "op6" not in properties:
            rows = _chosen(rows, "activity", self.event_types)
        rows = self._placed(rows, self.spans_events, None if self.is_atomic else self.mechanism)
        rows = rows.withColumn("start", F.unix_micros("start")).withColumn("stop", F.unix_micros("stop"))
        chosen = F.lit(True) if self.event_types is None else F.col("activity").isin(list(self.event_types))
        none = F.array().cast(_ENTRY)
        entries = [F.expr(_ENTRIES[p]).cast(_ENTRY) if p == "op6" else F.when(chosen, F.expr(_ENTRIES[p]).cast(_ENTRY)).otherwise(none) for p in properties]
        place = ["low", "high"] if self.spans_events else ["day"]
        out = rows.select(*place, F.inline(F.concat(*entries)))
        if self.object_types is not None and "op6" in properties:
            types = list(self.object_types)
            out = out.filter((F.col("property") != "op6") | (F.col("param1").isin(types) & F.col("param2").isin(types)))
        return out

    def _objects(self, properties: list[str], keep: bool = False) -> DataFrame:
        """(property, param1, param2, v, place) of properties of objects, from one row an object; ``keep`` makes these rows once, and the lifecycles are made of them."""
        if "op4" in properties:
            links, span = self.log.links("activity", "ts", "end_ts"), [F.min("ts").alias("start"), F.max("end_ts").alias("stop")]
            names = self.log.activities()
            if len(names) <= 50:
                # A count for each activity, so that one shuffle is enough.
                counts = [F.count_if(F.col("activity") == a).alias(f"n{i}") for i, a in enumerate(names)]
                rows = links.groupBy("oid", "otype").agg(*span, F.count("*").alias("n_events"), *counts)
                by_activity = F.array(*[F.struct(F.lit(a).alias("activity"), F.col(f"n{i}").alias("n")) for i, a in enumerate(names)])
                rows = rows.withColumn("by_activity", F.filter(by_activity, lambda x: x["n"] > 0))
            else:
                by_activity = links.groupBy("oid", "otype", "activity").agg(*span, F.count("*").alias("n"))
                rows = by_activity.groupBy("oid", "otype").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n_events"), F.collect_list(F.struct("activity", "n")).alias("by_activity"))
            rows = _chosen(rows, "otype", self.object_types)
        else:
            rows = self.lifecycles
        if keep:
            rows = stored(rows)
            self.lifecycles = rows.select("oid", "otype", "start", "stop", "n_events")
        spans = self.mechanism == "overlaps"
        rows = self._placed(rows, spans, self.mechanism)
        entries = F.concat(*[F.expr(_ENTRIES[p]).cast(_ENTRY) for p in properties])
        return rows.select(*(["low", "high"] if spans else ["day"]), F.inline(entries))

    def _attributes_of_events(self) -> DataFrame:
        whole = self.log.in_rows() if self.log.whole is not None else None
        rows = self.log.events.select("eid", "activity", "ts", "end_ts") if whole is None else whole.select("activity", "ts", "end_ts", "attributes")
        rows = _chosen(rows.withColumnsRenamed({"ts": "start", "end_ts": "stop"}), "activity", self.event_types)
        rows = self._placed(rows, self.spans_events, None if self.is_atomic else self.mechanism)
        if whole is None:
            rows = rows.join(self.log.event_attrs.select("eid", "name", F.col("value").alias("v")), "eid")
        else:
            rows = rows.select("*", F.inline("attributes")).withColumnRenamed("value", "v")
        return rows.select(F.lit("ep2").alias("property"), F.col("activity").alias("param1"), F.col("name").alias("param2"), "v", *(["low", "high"] if self.spans_events else ["day"]))

    def _attributes_of_objects(self) -> DataFrame:
        """The latest value at the time; at equal times a change beats an initial value, and the larger value wins.

        Under ``overlaps`` the times are edges of the grid, so of an object's values only the last of each interval
        counts, and it holds until the interval of the next one: one ordered pass over the intervals of an attribute.
        Otherwise an object has one time, and its values are held against that.
        """
        out = [F.lit("op2").alias("property"), F.col("otype").alias("param1"), F.col("name").alias("param2"), F.col("latest.value").alias("v")]
        if self.mechanism == "overlaps":
            places = self.log.object_attrs.withColumn("since", F.greatest(interval(F.col("ts"), self.grid), F.lit(-1))).filter(F.col("since") < len(self.grid.rights))
            # Dealt by object once, for the order of its values and the join with its lifecycle.
            following = F.lead("since").over(Window.partitionBy("oid", "name").orderBy("since", "ts", "changed", "value"))
            spans = places.repartition("oid").withColumn("until", F.coalesce(following, F.lit(len(self.grid.rights))) - 1)
            spans = spans.filter("oid is not null and since <= until").withColumn("latest", F.struct("value"))
            rows = touched(self.lifecycles, self.grid).join(spans, "oid")
            rows = rows.withColumn("low", F.greatest("low", "since")).withColumn("high", F.least("high", "until")).filter("low <= high")
            return rows.select(*out, "low", "high")
        rows = assign(self.lifecycles, self.grid, self.mechanism).select("oid", "otype", "t").join(self.log.object_attrs, "oid").filter("ts <= t")
        latest = rows.groupBy("oid", "otype", "t", "name").agg(F.max(F.struct("ts", "changed", "value")).alias("latest"))
        return latest.select(*out, label(F.col("t"), self.rate).alias("day"))

    def _active(self) -> DataFrame:
        """(property, param1, param2, v, place) with one row for each resource and stretch of its intervals. Of a resource's events those of one first interval become one span, and spans that overlap become one."""
        used = self.log.links("ts", "end_ts").filter(F.col("otype") == self.resource_type).withColumnsRenamed({"ts": "start", "end_ts": "stop"})
        rows = self._placed(used, self.spans_events, None if self.is_atomic else self.mechanism)
        out = [F.lit("rp2").alias("property"), F.lit(self.resource_type).alias("param1"), F.lit(None).cast("string").alias("param2"), F.lit(1).cast("bigint").alias("v")]
        if not self.spans_events:
            return rows.select("oid", "day").distinct().select(*out, "day")
        spans = rows.groupBy("oid", "low").agg(F.max("high").alias("high"))
        along = Window.partitionBy("oid").orderBy("low")
        new = F.coalesce(F.col("low") > F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        stretches = spans.withColumn("new", new.cast("int")).withColumn("stretch", F.sum("new").over(along))
        return stretches.groupBy("oid", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high")).select(*out, "low", "high")

    def _stats(self, rows: DataFrame, exact: bool) -> DataFrame:
        """``rows`` (property, param1, param2, v, place) to (property, param1, param2, day, n, total, least, most), n being the number of values."""
        g = self.grid
        if "day" in rows.columns:
            day = rows.withColumn("v", F.col("v").cast("double")).groupBy(*TSID, "day")
            return day.agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
        rows = rows.select(F.struct("property", "param1").alias("param1"), "param2", "low", "high", F.col("v").cast("decimal(20,0)" if exact and self.mode in ("mean", "sum") else "double").alias("v"))
        found = differences(rows, len(g.rights)) if exact and self.mode in ("mean", "sum") else dyadic(rows, len(g.rights))
        more = [F.lit(None).cast("double").alias(c) if c not in found.columns else F.col(c).cast("double").alias(c) for c in ("total", "least", "most")]
        return found.select("param1.property", "param1.param1", "param2", g.right(F.col("idx")).alias("day"), "n", *more)

    def _grouped(self, exact: list[DataFrame], rough: list[DataFrame]) -> DataFrame:
        """``_stats`` of frames of whole numbers and of fractions. Rows with a day have one aggregation, whatever they are; spans have one of whole numbers and one of fractions."""
        days = [x.withColumn("v", F.col("v").cast("double")) for x in (*exact, *rough) if "day" in x.columns]
        groups = [(days, False), ([x for x in exact if "day" not in x.columns], True), ([x for x in rough if "day" not in x.columns], False)]
        return reduce(DataFrame.unionByName, [self._stats(reduce(DataFrame.unionByName, rows), whole) for rows, whole in groups if rows])

    def _completed(self, stats: DataFrame) -> DataFrame:
        """``stats`` with what the second parameters of sparse properties lack: a value of 0 of each event or object that has none of a type."""
        names = ("param2", "n", "total", "least", "most")
        packed = stats.groupBy("property", "param1", "day").agg(F.collect_list(F.struct(*names)).alias("all"))
        pairs = self.combinations
        wanted = pairs.select(F.explode(F.array(*[F.lit(p) for p in SPARSE if p != "op4"])).alias("property"), F.col("activity").alias("param1"), F.col("otype").alias("param2"))
        wanted = wanted.unionByName(pairs.select(F.lit("op4").alias("property"), F.col("otype").alias("param1"), F.col("activity").alias("param2")))
        rows = packed.join(wanted.groupBy("property", "param1").agg(F.collect_set("param2").alias("wanted")), ["property", "param1"], "left")
        rows = rows.withColumn("whole", F.expr("get(filter(all, x -> x.param2 is null), 0).n"))

        def full(x: str) -> str:
            own, none = f"get({x}, 0)", f"size({x}) = 0"
            least = f"if({none}, 0D, if({own}.n < whole, least({own}.least, 0D), {own}.least))"
            return f"named_struct('param2', y, 'n', whole, 'total', if({none}, 0D, {own}.total), 'least', {least}, 'most', if({none}, 0D, greatest({own}.most, 0D)))"

        made = F.expr(f"transform(coalesce(wanted, array()), y -> {full('filter(all, x -> x.param2 = y)')})")
        return rows.select("property", "param1", "day", F.inline(F.when(F.col("property").isin(list(SPARSE)), made).otherwise(F.col("all"))))

    def collect(self, properties: list[str]) -> DataFrame:
        """The series of several properties in one frame: events and objects are read once each, whatever the number of their properties, and one aggregation makes all series."""
        if unknown := [p for p in properties if p not in NAMES]:
            raise ValueError(f"no properties: {unknown}")
        if self.mode not in AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
        for p in properties:
            if p in ("pp3", "pp4") and self.is_atomic:
                raise ValueError(f"{p} needs events with a duration")
        made = list(dict.fromkeys(DERIVED.get(p, p) for p in properties))
        of_events, of_objects = ([p for p in of if p in made] for of in (OF_EVENTS, OF_OBJECTS))
        after, first = [p for p in of_events if p in AFTER_OTHERS], []
        if after and len(after) < len(made):
            # A job of its own, by far the largest: its shuffles can be removed before the rest makes others.
            of_events = [p for p in of_events if p not in after]
            first = [stored(self._grouped([self._events(after)], []))]
        exact = [self._events(of_events)] if of_events else []
        exact += [self._objects(of_objects, "op2" in made)] if of_objects else []
        exact += [self._active()] if "rp2" in made else []
        rough = [f() for p, f in (("ep2", self._attributes_of_events), ("op2", self._attributes_of_objects)) if p in made]
        stats = reduce(DataFrame.unionByName, [*first, *([self._grouped(exact, rough)] if exact or rough else [])])
        if set(SPARSE) & set(made):
            stats = self._completed(stats)
        summed = F.col("property").isin("ep1", "op1", "rp2")
        value = {"mean": F.col("total") / F.col("n"), "sum": F.col("total"), "min": F.col("least"), "max": F.col("most")}[self.mode]
        value = F.when(summed, F.col("total")).otherwise(value) / F.when(F.col("property").isin(list(DURATIONS)), 3.6e9).otherwise(1.0)
        names = F.array(F.col("property"), *[F.when((F.col("property") == of) & (F.col(column) == self.resource_type), F.lit(p)) for p, of, column in (("rp1", "ep4", "param2"), ("rp3", "op2", "param1")) if p in properties])
        series = stats.select(F.explode(names).alias("property"), "param1", "param2", "day", value.alias("value")).filter(F.col("property").isin(properties))
        return align(series, self.grid, self.mode)


def _single(name: str):
    def series(self: Properties) -> DataFrame:
        return self.collect([name])

    series.__doc__ = f"{NAMES[name]}."
    return series


for _name in NAMES:
    setattr(Properties, _name, _single(_name))
