"""The events that precede an event through its objects.

Events are dealt by object and looked at in order of time, a window for each object. An object with more than a task's
share of all links doesn't go to one task: starts and ends of the events of such objects are sorted in ranges of
(object, time), each range is scanned once for the last end before a start, and what a range still lacks at its
beginning comes from the ranges before it: one row for each range, which is all that the driver sees.

Pairs of events that are linked by several objects become one. A link tells of the event's other objects in a few bits, so
that only pairs which may have another object in common are dealt once more.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.log import EventLog, unpacked
from ..sources.scratch import stored

#: States of a row of the scan: its predecessor is known, lies in an earlier range if anywhere, or it tells of a range.
FOUND, OPEN, BORDER = 0, 1, 2
_SCANNED = "part int, state int, oid string, eid string, otype string, prev_eid string, prev_end bigint"
_ORDER = ("h", "oid", "at", "late", "ts", "eid", "kind")
#: The part of all links by which heavy objects are found, and the most links that a task takes on average.
SHARE, LINKS_OF_TASK = 0.01, 1_500_000
#: Up to so many object types have columns of their own.
FEW_TYPES = 16
#: Hours, minutes, seconds and milliseconds, in microseconds.
UNITS = (3_600_000_000, 60_000_000, 1_000_000, 1_000)
#: Of an event with up to so many objects each link tells of the others.
FEW_OBJECTS = 8
#: Up to so many activities are told by the last bits of an event's number; there are fewer than 2^24 tasks.
FEW_ACTIVITIES = 64


def preceding(log: EventLog, is_atomic: bool = True) -> DataFrame:
    """(eid, prev_eid, prev_end, types): for each object of an event the latest event before it that shares the object; types are the object types through which the two are linked.

    Atomic events are ordered by (ts, eid). Otherwise a predecessor ends when the event starts at the latest, and of
    several the one with the largest (end, start, eid) counts.
    """
    pair, types = ("eid", "prev_eid"), _few_types(log)
    found, short = _found(log, is_atomic, types, signed=True)
    found = found.filter("prev_key is not null").select(F.col("key").alias("eid"), "otype", F.col("prev_key").alias("prev_eid"), "prev_end", *(["shared"] if short else []))
    alone, found = found, found.filter("shared") if short else found
    found, end = found.repartition("eid"), F.max("prev_end").alias("prev_end")  # so that what follows by event needs no other shuffle
    if types is None:
        pairs = found.groupBy(*pair).agg(end, F.sort_array(F.collect_set("otype")).alias("types"))
    else:
        pairs = found.groupBy(*pair).agg(end, F.bit_or("otype").alias("kinds"))
        each = F.array(*[F.when(F.col("kinds").bitwiseAND(F.lit(1 << i)) != 0, F.lit(t)) for i, t in enumerate(types)]).cast("array<string>")
        pairs = pairs.select(*pair, "prev_end", F.array_compact(each).alias("types"))
    if short:
        # Two events that surely have no other object in common are linked by this one only, and are a pair as they are.
        kind = F.array("otype") if types is None else F.array(F.element_at(F.array(*[F.lit(t) for t in types]).cast("array<string>"), F.bit_count(F.col("otype") - 1) + 1))
        pairs = alone.filter("not shared").select(*pair, "prev_end", F.array_compact(kind).alias("types")).unionByName(pairs)
        pairs = pairs.withColumn("eid", unpacked(F.col("eid"))).withColumn("prev_eid", unpacked(F.col("prev_eid")))
    return pairs.withColumn("prev_end", F.timestamp_micros(F.col("prev_end") * _unit(log, is_atomic)))


@lru_cache(16)
def _unit(log: EventLog, is_atomic: bool) -> int:
    """The longest of some units, in microseconds, that all times of events are whole numbers of: such numbers are shorter."""
    whole = lambda unit: F.every((F.unix_micros("ts") % unit == 0) & (F.unix_micros("ts" if is_atomic else "end_ts") % unit == 0))
    row = log.events.agg(*[whole(unit) for unit in UNITS]).first()
    return next((unit for unit, every in zip(UNITS, row, strict=True) if every), 1)


def _few_types(log: EventLog) -> list[str] | None:
    """The object types that events are linked to, if they are few."""
    types = [r[0] for r in log.relations.select("otype").filter("otype is not null").distinct().limit(FEW_TYPES + 1).collect()]
    return sorted(types) if len(types) <= FEW_TYPES else None


def _bit(types: list[str]) -> Column:
    """The type of a link as a number, of which sets are sums."""
    return F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(types) for x in (t, 1 << i)]) if types else F.create_map().cast("map<string,int>"), F.col("otype"))


def events_with_ends(log: EventLog, is_atomic: bool, by_types: bool, others: bool = True) -> DataFrame:
    """(activity, start, stop, latest, earliest) of all events, times in microseconds: the latest and the earliest of the ends of the events that precede one, null without any.

    With ``by_types`` also links (otype, hi, lo, other): for each type that predecessors are linked through the latest and
    the earliest of their ends, and the earliest end of those that aren't linked through it, which is null without
    ``others``. The list is as long as there are types, however many predecessors there are.
    """
    types = _few_types(log) if by_types else None
    others = others or types is None
    names = [] if log.whole is None else [r[0] for r in log.events.select("activity").distinct().limit(FEW_ACTIVITIES + 1).collect()]
    names = sorted(names) if len(names) <= FEW_ACTIVITIES and None not in names else []
    found, short = _found(log, is_atomic, types, "activity", names=names)
    names = names if short else []
    unit = _unit(log, is_atomic)
    own = ("key", *([] if names else ["activity"]), "ts", *([] if is_atomic else ["end"]))
    found = found.select(*own, *(["otype"] if by_types else []), *(["prev_key"] if by_types and others else []), "prev_end")
    ends = lambda hi, lo: [F.max(hi).alias("latest"), F.min(lo).alias("earliest")]
    if by_types:
        if types is not None:
            # Sets of types are numbers, and each type has columns of its own.
            each = found.withColumnRenamed("otype", "kinds").repartition("key")  # the one shuffle by event
            if others:
                each = each.groupBy(*own, "prev_key", "prev_end").agg(F.bit_or("kinds").alias("kinds"))
            has = lambda i: F.col("kinds").bitwiseAND(F.lit(1 << i)) != 0
            other = lambda i: F.min(F.when(~has(i), F.col("prev_end"))) if others else F.lit(None).cast("bigint")
            of_types = [x for i in range(len(types)) for x in (F.max(F.when(has(i), F.col("prev_end"))).alias(f"hi{i}"), F.min(F.when(has(i), F.col("prev_end"))).alias(f"lo{i}"), other(i).alias(f"other{i}"))]
            rows = each.groupBy(*own).agg(*ends("prev_end", "prev_end"), *of_types)
            links = F.array(*[F.struct(F.lit(t).alias("otype"), F.col(f"hi{i}").alias("hi"), F.col(f"lo{i}").alias("lo"), F.col(f"other{i}").alias("other")) for i, t in enumerate(types)])
            rows = rows.withColumn("links", F.filter(links, lambda x: x["hi"].isNotNull()) if types else F.lit(None).cast("array<struct<otype:string,hi:bigint,lo:bigint,other:bigint>>"))
        else:
            each = found.repartition("key").groupBy(*own, "prev_key", "prev_end").agg(F.sort_array(F.collect_set("otype")).alias("types"))
            sets = each.filter("prev_end is not null").groupBy(*own, "types").agg(F.max("prev_end").alias("hi"), F.min("prev_end").alias("lo"))
            sets = sets.unionByName(each.filter("prev_end is null"), allowMissingColumns=True)
            rows = sets.groupBy(*own).agg(*ends("hi", "lo"), F.collect_list(F.when(F.col("hi").isNotNull(), F.struct("types", "hi", "lo"))).alias("sets"))
            linked = "filter(sets, x -> array_contains(x.types, y))"
            other = "array_min(transform(filter(sets, x -> not array_contains(x.types, y)), x -> x.lo))"
            rows = rows.withColumn("links", F.expr(f"transform(array_distinct(flatten(sets.types)), y -> struct(y as otype, array_max({linked}.hi) as hi, array_min({linked}.lo) as lo, {other} as other))"))
        rows = rows.select(*own, "latest", "earliest", "links")
    else:
        # Links of an event hardly ever lie together before they are dealt by event.
        rows = found.repartition("key").groupBy(*own).agg(*ends("prev_end", "prev_end"))
    if names:
        rows = rows.withColumn("activity", F.element_at(F.array(*[F.lit(a) for a in names]), (F.col("key") % FEW_ACTIVITIES + 1).cast("int")))
    for c in ("ts", *([] if is_atomic else ["end"]), "latest", "earliest"):
        rows = rows.withColumn(c, F.col(c) * unit)
    if by_types:
        rows = rows.withColumn("links", F.transform("links", lambda x: F.struct(x["otype"].alias("otype"), *[(x[c] * unit).alias(c) for c in ("hi", "lo", "other")])))
    alone = log.whole.filter(F.size("objects") == 0) if log.whole is not None else log.events.join(log.relations.select("eid"), "eid", "left_anti")
    alone = alone.select("activity", F.unix_micros("ts").alias("ts"), F.unix_micros("ts" if is_atomic else "end_ts").alias("end"))
    rows = rows.withColumn("end", F.col("ts")) if is_atomic else rows
    rows = rows.drop("key").unionByName(alone, allowMissingColumns=True)
    return rows.withColumnsRenamed({"ts": "start", "end": "stop"})


def _with_others(rows: DataFrame) -> DataFrame:
    """``rows`` (objects, more) with a row for each object: oid, otype and others, a number that tells of the event's other objects: if that of two events has no bit in common, they have no such object in common. Of an event with many objects it has all bits."""
    bit = lambda i: F.expr(f"shiftleft(1L, cast(pmod(xxhash64(get(objects, {i}).oid), 64) as int))")
    bits, none = [f"bit{i}" for i in range(FEW_OBJECTS)], F.lit(0).cast("bigint")
    numbered = rows.select("*", (F.size("objects") > FEW_OBJECTS).alias("many"), *[F.when(F.size("objects") > i, bit(i)).otherwise(none).alias(b) for i, b in enumerate(bits)])
    each = numbered.select(*[c for c in rows.columns if c != "objects"], "many", *bits, F.posexplode("objects").alias("pos", "x"))
    others = F.when(F.col("many"), F.lit(-1).cast("bigint"))
    for i in range(FEW_OBJECTS):
        others = others.when(F.col("pos") == i, reduce(Column.bitwiseOR, [F.col(b) for j, b in enumerate(bits) if j != i], none))
    return each.select(*[c for c in rows.columns if c != "objects"], "x.oid", "x.otype", others.alias("others"))


def _links(log: EventLog, is_atomic: bool, short: bool, *columns: str, names: list[str], signed: bool = False) -> DataFrame:
    """(key, eid, columns of the event, ts, end, oid, otype, with ``signed`` others) of events and their objects, times in the log's ``_unit``. The key names an event: its id, or a number, which is shorter, where a source has events with their objects. There ``short`` puts a code that sorts like it in place of the event id, and with the names of activities the number tells the activity, which isn't a column then."""
    times = [F.expr(f"unix_micros({c}) div {_unit(log, is_atomic)}").alias(x) for c, x in (("ts", "ts"), ("ts" if is_atomic else "end_ts", "end"))]
    if log.whole is None:
        return log.links(*columns, "ts", "end_ts").select(F.col("eid").alias("key"), "eid", *columns, *times, "oid", "otype")
    eid = F.col("code" if short else "eid")
    key = F.monotonically_increasing_id() if short and columns else eid
    if names:
        key = key * FEW_ACTIVITIES + F.array_position(F.array(*[F.lit(a) for a in names]), F.col("activity")) - 1
        columns = tuple(c for c in columns if c != "activity")
    rows = log.whole.select(key.alias("key"), eid.alias("eid"), *columns, *times, "objects")
    return _with_others(rows) if signed else rows.select("key", "eid", *columns, "ts", "end", F.inline("objects"))


def _marks(links: DataFrame, is_atomic: bool) -> DataFrame:
    """Rows in the order of the scan: kind 2 both asks and is an end (atomic events), 1 is an end, 0 asks. One without duration doesn't see its own end or a later one at the same time."""
    row = lambda at, late, kind: F.struct(F.col(at).alias("at"), late.alias("late"), F.lit(kind).alias("kind"))
    if is_atomic:
        rows = links.withColumn("x", row("ts", F.lit(0), 2))
    else:
        rows = links.withColumn("x", F.explode(F.array(row("end", F.lit(0), 1), row("ts", F.when(F.col("ts") == F.col("end"), 0).otherwise(1), 0))))
    return rows.select(F.xxhash64("oid").alias("h"), *links.columns, "x.at", "x.late", "x.kind")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _heavy(log: EventLog) -> tuple[list[str], int]:
    """The objects with more than a task's share of all links, fewer than there are tasks, and the number of tasks that links are dealt to. Both only say where the work is done; results don't depend on them."""
    tasks = _tasks(log.events.sparkSession)
    counts = log.relations.select("oid").sample(SHARE, 7).rollup("oid").count().orderBy(F.desc("count")).limit(tasks + 1).collect()
    total = counts[0]["count"] if counts else 0
    heavy = [r["oid"] for r in counts[1:] if r["oid"] is not None and r["count"] * tasks > total]
    return heavy, max(tasks, int(total / SHARE / LINKS_OF_TASK))


def _found(log: EventLog, is_atomic: bool, types: list[str] | None, *columns: str, names: list[str] = (), signed: bool = False) -> tuple[DataFrame, bool]:
    """(key, columns of the event, ts, end, otype, prev_key, prev_end) of each event and object of it, the predecessor null if there is none; and whether keys are numbers or, without columns, codes of event ids. With ``types``, otype is their ``_bit``; with ``names``, numbers tell the activity, which isn't a column then. ``signed`` rows with such keys have shared, whether the event and the predecessor may have another object in common."""
    heavy, tasks = _heavy(log)
    # Numbers of events hold within one reading of the source, so they don't serve where two parts of it meet.
    short = log.whole is not None and not heavy
    names = names if short else []
    signed = signed and short
    links = _links(log, is_atomic, short, *columns, names=names, signed=signed)
    numbered = (lambda rows: rows) if types is None else lambda rows: rows.withColumn("otype", _bit(types))
    carried = tuple(c for c in columns if not (names and c == "activity"))
    rows = _along(numbered(links.filter(~F.col("oid").isin(heavy)) if heavy else links), is_atomic, tasks, bool(columns), *carried)
    if heavy:
        hot = links.filter(F.col("oid").isin(heavy))
        own = hot.select("key", *columns, "ts", "end").distinct()
        rows = rows.unionByName(numbered(own.join(_in_ranges(hot, is_atomic), "key", "left")))
    return rows, short


def _along(links: DataFrame, is_atomic: bool, tasks: int, keyed: bool, *columns: str) -> DataFrame:
    """What precedes each event through each object, by a window for each object. Links that aren't ``keyed`` have the event id as key."""
    needed = links if keyed else links.drop("key")
    dealt = needed.drop("end") if is_atomic else needed
    dealt = dealt.repartition("oid") if tasks == _tasks(dealt.sparkSession) else dealt.repartition(tasks, "oid")
    dealt = dealt.withColumn("end", F.col("ts")) if is_atomic else dealt
    dealt = dealt if keyed else dealt.withColumn("key", F.col("eid"))
    marks = _marks(dealt, is_atomic)
    before = Window.partitionBy("h", "oid").orderBy(*_ORDER[2:])
    signed = "others" in links.columns
    of_prev, shared = ("key", "end", "others") if signed else ("key", "end"), F.col("others").bitwiseAND(F.col("prev.others")) != 0
    if is_atomic:
        prev = F.lag(F.struct(*of_prev)).over(before)
    else:
        prev = F.last(F.when(F.col("kind") == 1, F.struct(*of_prev)), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    rows = marks.withColumn("prev", prev).filter("kind <> 1")
    return rows.select("key", *columns, "ts", "end", "otype", F.col("prev.key").alias("prev_key"), F.col("prev.end").alias("prev_end"), *([shared.alias("shared")] if signed else []))


def _scan(batches):
    """Over a sorted range: what each asking row has before it, and one row about the range's first and last object."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first = carry = None
    names = [f.split()[0] for f in _SCANNED.split(", ")]
    types = dict(zip(names, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))

    def made(**columns):
        n = len(columns["state"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)) if c == "part" else columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), types[c]) for c in names], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        oid, eid, end, kind = (batch.column(c) for c in ("oid", "eid", "end", "kind"))
        if first is None:
            first = oid[0].as_py()
            carry = (first, None, None)
        # The last row before the batch stands in front of it, as an end if there was one.
        oid, eid, end = (pa.concat_arrays([pa.array([x], y.type), y]) for x, y in zip(carry, (oid, eid, end), strict=True))
        kind = np.r_[1 if carry[1] is not None else 0, kind.to_numpy()]
        n = len(kind)
        place = np.arange(n)
        new = np.r_[True, pc.not_equal(oid.slice(1), oid.slice(0, n - 1)).to_numpy(zero_copy_only=False)]
        run = np.maximum.accumulate(np.where(new, place, 0))
        last = np.maximum.accumulate(np.where(kind > 0, place, -1))
        before = np.r_[-1, last[:-1]]
        known = before >= run
        asks = (kind != 1) & (place > 0)
        got = np.flatnonzero(asks & known)
        otype = batch.column("otype")
        if len(got):
            at = pa.array(before[got])
            yield made(state=pa.array(np.zeros(len(got), np.int32)), eid=eid.take(pa.array(got)), otype=otype.take(pa.array(got - 1)), prev_eid=eid.take(at), prev_end=end.take(at))
        if oid[0].as_py() == first:
            lacks = np.flatnonzero(asks & ~known & (run == 0))
            if len(lacks):
                yield made(state=pa.array(np.full(len(lacks), OPEN, np.int32)), eid=eid.take(pa.array(lacks)), otype=otype.take(pa.array(lacks - 1)))
        carry = (oid[n - 1].as_py(), *((eid[int(last[-1])].as_py(), end[int(last[-1])].as_py()) if last[-1] >= run[-1] else (None, None)))
    if first is not None:
        yield made(state=[BORDER], eid=[first], oid=[carry[0]], prev_eid=[carry[1]], prev_end=[carry[2]])


def _in_ranges(links: DataFrame, is_atomic: bool) -> DataFrame:
    """(key, otype, prev_key, prev_end) of each event and object of it that has an earlier event, by ranges that an object may go on through."""
    marks = _marks(links, is_atomic).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    scanned = stored(marks.select("oid", "eid", "end", "kind", "otype").mapInArrow(_scan, _SCANNED))
    ahead, carried = [], {}
    for r in scanned.filter(F.col("state") == BORDER).orderBy("part").collect():
        if r["eid"] in carried:
            ahead.append((r["part"], *carried[r["eid"]]))
        # What a range ends with; one that only goes on with an object and has no end of its own passes on what came in.
        mark = (r["prev_eid"], r["prev_end"]) if r["prev_eid"] is not None else carried.get(r["oid"]) if r["oid"] == r["eid"] else None
        carried = {r["oid"]: mark} if mark else {}
    columns = [F.col("eid").alias("key"), "otype", F.col("prev_eid").alias("prev_key"), "prev_end"]
    came_in = links.sparkSession.createDataFrame(ahead, "part int, prev_eid string, prev_end bigint")
    opened = scanned.filter(F.col("state") == OPEN).drop("prev_eid", "prev_end").join(F.broadcast(came_in), "part")
    return scanned.filter(F.col("state") == FOUND).select(*columns).unionByName(opened.select(*columns))
