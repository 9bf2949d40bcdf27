import json
import re
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.functions.grid import DAILY, MONTHLY, QUARTERLY, WEEKLY, YEARLY, Grid, grid, interval, label, period_end
from tidelog.operators.assignment import assign
from tidelog.operators import preceding as preceding_module
from tidelog.operators.preceding import preceding
from tidelog.operators.properties import Properties
from tidelog.operators.series import align, analysable
from tidelog.operators.writeback import attribute_name, refuse_repetition, reload_causes, reload_forecasts, reload_marks, reload_points, reload_series, with_causes, with_forecasts, with_points, with_series
from tidelog.sources.log import EventLog, held, numeric, read_csv_set, read_ocel_json, write_ocel_lines
from tidelog.sources.results import causes_json, forecasts_json, points_json, read_results, read_series_csv, write_series_csv


def make_log(spark, events, relations, attrs=(), history=()):
    at = lambda x: datetime.fromisoformat(x)
    rel = spark.createDataFrame([(e, o, t, "") for e, o, t in relations], "eid string, oid string, otype string, qualifier string")
    return EventLog(
        spark.createDataFrame([(e, a, at(s), at(x)) for e, a, s, x in events], "eid string, activity string, ts timestamp, end_ts timestamp"),
        rel,
        rel.select("oid", "otype").distinct(),
        spark.createDataFrame(list(attrs), "eid string, name string, value double"),
        spark.createDataFrame([(o, n, at(t), c, v) for o, n, t, c, v in history], "oid string, name string, ts timestamp, changed boolean, value double"),
        spark.createDataFrame([], "oid string, oid_2 string, qualifier string"),
    )


def test_period_ends():
    assert [period_end(date(2024, 2, 10), r) for r in (DAILY, WEEKLY, MONTHLY, QUARTERLY, YEARLY)] == [date(2024, 2, 10), date(2024, 2, 11), date(2024, 2, 29), date(2024, 3, 31), date(2024, 12, 31)]


def test_grid_ends():
    weekly = grid(date(2024, 1, 10), date(2024, 2, 11), WEEKLY)
    assert weekly.left == date(2024, 1, 7) and weekly.rights[-1] == date(2024, 2, 18)  # a Sunday end goes to the next Sunday
    assert grid(date(2024, 1, 1), date(2024, 1, 10), DAILY).rights[-1] == date(2024, 1, 10)
    assert grid(date(2024, 3, 2), date(2025, 3, 31), QUARTERLY).left == date(2024, 3, 31)
    assert grid(date(2024, 3, 1), date(2025, 3, 31), QUARTERLY).left == date(2023, 12, 31)
    with pytest.raises(ValueError):
        grid(date(2024, 1, 1), date(2024, 1, 3), DAILY)
    with pytest.raises(ValueError):
        grid(date(2024, 1, 1), date(2024, 5, 3), "H")


def test_labels_and_intervals(spark):
    start = datetime(2023, 12, 29)
    stamps = [start + timedelta(hours=7 * i) for i in range(400)] + [datetime(2024, 1, 7), datetime(2024, 1, 31), datetime(2024, 3, 31, 0, 0, 0, 1)]
    rows = spark.createDataFrame([(s,) for s in stamps], "ts timestamp")
    for rate in (DAILY, WEEKLY, MONTHLY, QUARTERLY, YEARLY):
        edges = [period_end(date(2023, 11, 1), rate)]
        while edges[-1] < date(2024, 6, 1):
            edges.append(period_end(edges[-1] + timedelta(1), rate))
        g = Grid(rate, tuple(edges))
        for r in rows.select("ts", label(F.col("ts"), rate).alias("label"), interval(F.col("ts"), g).alias("i")).collect():
            ts = r["ts"]
            midnight = ts == datetime(ts.year, ts.month, ts.day)
            assert r["label"] == (ts.date() + timedelta(not midnight) if rate == DAILY else period_end(ts.date(), rate))
            want = next((k for k, d in enumerate(g.edges, -1) if ts <= datetime(d.year, d.month, d.day)), len(g.rights))
            assert r["i"] == want, (rate, ts)


@pytest.mark.parametrize("rate", [DAILY, WEEKLY, MONTHLY])
def test_assignment_against_all_intervals(spark, rate):
    g = grid(date(2024, 1, 5), date(2024, 5, 20), rate)
    edges = [datetime(d.year, d.month, d.day) for d in g.edges]
    spans = [(i, datetime(2023, 12, 20) + timedelta(hours=53 * i), datetime(2023, 12, 20) + timedelta(hours=53 * i + (i * 31) % 700)) for i in range(90)] + [(900 + i, e, e) for i, e in enumerate(edges)]
    rows = spark.createDataFrame(spans, "k int, start timestamp, stop timestamp")
    pairs = list(zip(edges, edges[1:], strict=False))
    want = {
        "starting": {(k, s) for k, s, _ in spans if edges[0] < s <= edges[-1]},
        "ending": {(k, e) for k, _, e in spans if edges[0] < e <= edges[-1]},
        "contains": {(k, e) for k, s, e in spans if any(s > a and e <= b for a, b in pairs)},
        "overlaps": {(k, b) for k, s, e in spans for a, b in pairs if s <= b and e > a},
    }
    for mechanism, expected in want.items():
        got = [(r["k"], r["t"]) for r in assign(rows, g, mechanism).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    with pytest.raises(ValueError):
        assign(rows, g, "around")


def random_log(spark, seed, timed):
    import random

    rng = random.Random(seed)
    events, relations = [], []
    for i in range(60):
        start = datetime(2024, 1, 1) + timedelta(days=rng.randrange(80))
        events.append((f"e{i:02}", rng.choice("ab"), start.isoformat(), (start + timedelta(days=rng.randrange(3) if timed else 0)).isoformat()))
        relations += [(f"e{i:02}", f"{t}{n}", t) for t, n in {(rng.choice("xyz"), rng.randrange(3)) for _ in range(rng.randrange(4))}]
    return make_log(spark, events, relations), events, relations


@pytest.mark.parametrize("timed", [False, True])
def test_preceding_against_scanning_back(spark, timed):
    log, events, relations = random_log(spark, 3 + timed, timed)
    objects = {}
    for e, o, t in relations:
        objects.setdefault(e, {})[o] = t
    order = sorted(events, key=lambda e: (e[3], e[2], e[0]) if timed else (e[2], e[0]))
    want = set()
    for i, event in enumerate(order):
        left = dict(objects.get(event[0], {}))
        for other in reversed(order[:i]):
            if timed and other[3] > event[2]:
                continue
            shared = [o for o in left if o in objects.get(other[0], {})]
            if shared:
                want.add((event[0], other[0], tuple(sorted({left.pop(o) for o in shared}))))
    got = {(r["eid"], r["prev_eid"], tuple(sorted(r["types"]))) for r in preceding(log, not timed).collect()}
    assert got == want


@pytest.mark.parametrize("timed", [False, True])
def test_predecessors_of_a_hot_object_lie_in_many_ranges(spark, timed, monkeypatch):
    """One object with nearly all events, among others: as by scanning back, and the scan deals it to all tasks; ranges without an end pass on what came in."""
    start = datetime(2024, 1, 1)
    events = [(f"e{i:04}", "a", start + timedelta(hours=i), start + timedelta(hours=i + (i * 7919 % 600 if timed else 0))) for i in range(600)]
    # A long time in which nothing of the hot object ends.
    events += [(f"q{i:04}", "a", start + timedelta(hours=2000 + i), start + timedelta(hours=9000 if timed else 2000 + i)) for i in range(400)]
    events = [(e, a, s.isoformat(), x.isoformat()) for e, a, s, x in events]
    relations = [(e[0], "hot", "van") for e in events] + [(e[0], f"o{i % 50}", "order") for i, e in enumerate(events)]
    seen = []
    keep = preceding_module.stored
    monkeypatch.setattr(preceding_module, "stored", lambda df: seen.append(keep(df)) or seen[-1])
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = preceding(make_log(spark, events, relations), not timed).select("eid", "prev_eid", F.explode("types").alias("otype")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = {}
    for e, o, t in relations:
        own.setdefault((o, t), []).append(e)
    by_id = {e[0]: (e[3], e[2], e[0]) for e in events}
    want = set()
    for (_, otype), ids in own.items():
        for e in ids:
            before = [by_id[x] for x in ids if by_id[x] < by_id[e] and (by_id[x][0] <= by_id[e][1])]
            if before:
                want.add((e, max(before)[2], otype))
    assert {tuple(r) for r in found} == want
    ranges = seen[0].filter("state < 2 and otype = 'van'").select("part").distinct().count()
    assert ranges >= 3 and seen[0].filter("state = 1").count() > 0


def test_properties_by_hand(spark):
    day = lambda d, h=0: f"2024-01-{d:02} {h:02}:00:00"
    events = [(f"p{d}", "pick", day(d, 6), day(d, 6)) for d in range(1, 7)] + [(f"s{d}", "ship", day(d, 12), day(d, 12)) for d in range(1, 7)]
    relations = [x for d in range(1, 7) for x in ((f"p{d}", f"o{d}", "order"), (f"p{d}", f"i{d}", "item"), (f"s{d}", f"o{d}", "order"), (f"s{d}", "v", "van"))]
    log = make_log(spark, events, relations, [(f"p{d}", "weight", float(d)) for d in range(1, 7)], [("v", "load", "1970-01-01", False, 1.0), ("v", "load", "2024-01-03 00:00:00", True, 5.0)])
    p = Properties(spark, log, DAILY, "mean", "overlaps", True, "van")
    values = lambda df: {}.__class__({(r["param1"], r["param2"], r["idx"]): r["value"] for r in df.collect()})
    # The last day ends the grid at its midnight, so what happens on it is outside.
    assert set(values(p.ep1()).items()) == {((a, None, i), 1.0) for a in ("pick", "ship") for i in range(len(p.grid.rights))}
    assert values(p.ep2())[("pick", "weight", 2)] == 3.0
    assert set(values(p.ep4())) == {(a, t, i) for a, t in (("pick", "order"), ("pick", "item"), ("ship", "order"), ("ship", "van")) for i in range(len(p.grid.rights))}
    assert values(p.op2())[("van", "load", 0)] == 1.0 and values(p.op2())[("van", "load", 1)] == 5.0
    assert values(p.pp1())[("ship", None, 1)] == 6.0  # from the pick of the same order
    assert values(p.pp2())[("ship", None, 1)] == 18.0  # the van came from the day before
    assert values(p.pp7())[("ship", "order", 1)] == 18.0 and values(p.pp7())[("ship", "van", 1)] == 0.0
    one, two, five = values(p.pp1()), values(p.pp2()), values(p.pp5())
    assert all(abs(five[k] - one[k] - two[k]) < 1e-9 for k in five)
    assert set(values(p.rp1()).values()) == {1.0} and set(values(p.rp2()).values()) == {1.0}
    with pytest.raises(ValueError):
        p.pp3()


def test_gaps_by_aggregation(spark):
    g = grid(date(2024, 1, 1), date(2024, 6, 30), MONTHLY)
    rows = [("ep2", "a", "v", d, 1.0) for d in (g.rights[0], g.rights[2], g.rights[5])] + [("ep1", "a", None, g.rights[1], 2.0)]
    series = spark.createDataFrame(rows, "property string, param1 string, param2 string, day date, value double")
    assert {r["property"] for r in align(series, g, "mean").collect()} == {"ep1"}
    summed = align(series, g, "sum")
    assert [r["value"] for r in summed.filter("property = 'ep2'").orderBy("idx").collect()] == [1, 0, 1, 0, 0, 1]
    assert analysable(summed.withColumn("value", F.lit(1.00049))).count() == 0


def test_json_round_trip(spark, tmp_path):
    doc = {
        "eventTypes": [{"name": "a", "attributes": [{"name": "w", "type": "float"}]}],
        "objectTypes": [{"name": "x", "attributes": []}],
        "events": [{"id": "e1", "type": "a", "time": "2024-01-01T10:00:00.000Z", "attributes": [{"name": "w", "value": 5}, {"name": "note", "value": "text"}], "relationships": [{"objectId": "x1", "qualifier": "q"}]}, {"id": "e2", "type": "a", "time": "2024-01-02T10:00:00.000Z", "attributes": [{"name": "w", "value": "1e-7"}], "relationships": []}],
        "objects": [{"id": "x1", "type": "x", "relationships": [{"objectId": "x2", "qualifier": "r"}], "attributes": [{"name": "size", "value": "1", "time": "2023-01-01T00:00:00.000Z"}, {"name": "size", "value": "2", "time": "2024-01-01T00:00:00.000Z"}]}, {"id": "x2", "type": "x", "relationships": [], "attributes": []}],
    }
    (tmp_path / "log.json").write_text(json.dumps(doc))
    log = read_ocel_json(spark, str(tmp_path / "log.json"))
    assert {tuple(r) for r in log.event_attrs.collect()} == {("e1", "w", 5.0), ("e2", "w", 1e-7)}  # an attribute with text isn't numeric
    assert [r["oid"] for r in log.objects.collect()] == ["x1"]  # x2 has no event
    assert sorted((r["ts"].year, r["changed"], r["value"]) for r in log.object_attrs.collect()) == [(1970, False, 1.0), (2024, True, 2.0)]
    assert same_log(read_ocel_json(spark, str(write(log, tmp_path / "out")), lines=True), log)


def write(log, path):
    write_ocel_lines(log, str(path))
    return path


TABLES = ("events", "relations", "objects", "event_attrs", "object_attrs", "o2o")


def same_log(one, two):
    """All rows of all tables, columns by name."""
    rows = lambda log, t: sorted(map(repr, getattr(log, t).select(*sorted(getattr(log, t).columns)).collect()))
    return all(rows(one, t) == rows(two, t) for t in TABLES)


def test_a_written_log_is_read_as_it_was(spark, tmp_path):
    events = [("e1", "a", "2024-01-01 10:00:00.000001", "2024-01-03 00:00:00.5"), ("e2", "b & c", "2024-01-02 00:00:00", "2024-01-02 00:00:00"), ("é3", "a", "2024-02-02 00:00:00", "2024-02-02 00:00:00")]
    history = [("x1", "size", "1970-01-01 00:00:00", False, 1e-7), ("x1", "size", "2024-01-01 00:00:00.25", True, 0.1), ("y1", "load", "1970-01-01 00:00:00", False, 3.0)]
    log = make_log(spark, events, [("e1", "x1", "x"), ("e1", "y1", "y"), ("e2", "x1", "x"), ("é3", "y1", "y")], [("e1", "w", 5.25), ("e2", "w", 1e300)], history)
    log = replace(log, o2o=spark.createDataFrame([("x1", "y1", 'says "hi"')], log.o2o.schema))
    path = write(log, tmp_path / "out")
    assert same_log(read_ocel_json(spark, str(path), lines=True), log)
    doc = [json.loads(r["value"]) for r in spark.read.text(str(path)).collect()]
    assert {"name": "a", "attributes": [{"name": "w", "type": "float"}, {"name": "end time", "type": "time"}]} in [t for d in doc for t in d.get("eventTypes", [])]
    assert {"name": "x", "attributes": [{"name": "size", "type": "float"}]} in [t for d in doc for t in d.get("objectTypes", [])]
    assert same_log(read_ocel_json(spark, str(write(read_ocel_json(spark, str(path), lines=True), tmp_path / "again")), lines=True), log)
    empty = make_log(spark, events[:1], [("e1", "x1", "x")])
    assert same_log(read_ocel_json(spark, str(write(empty, tmp_path / "small")), lines=True), empty)


@pytest.mark.parametrize("wrong", ["time", "repeated", "relation", "value"])
def test_a_wrong_log_is_not_written(spark, tmp_path, wrong):
    log = make_log(spark, [("e1", "a", "2024-01-01", "2024-01-01")], [("e1", "x1", "x")], [("e1", "w", 1.0)])
    log = {
        "time": lambda: replace(log, events=log.events.withColumn("ts", F.lit(None).cast("timestamp"))), "repeated": lambda: replace(log, events=log.events.unionByName(log.events)),
        "relation": lambda: replace(log, relations=log.relations.withColumn("oid", F.lit("nobody"))), "value": lambda: replace(log, event_attrs=log.event_attrs.withColumn("value", F.lit(None).cast("double"))),
    }[wrong]()
    with pytest.raises(ValueError):
        write_ocel_lines(log, str(tmp_path / "out"))


def test_csv_set(spark, tmp_path):
    tables = {
        "event": "ocel_id;ocel_type\ne1;place order", "object": "ocel_id;ocel_type\no1;orders\no2;orders", "event_object": "ocel_event_id;ocel_object_id;ocel_qualifier\ne1;o1;q\ne1;o1;q",
        "object_object": "ocel_source_id;ocel_target_id;ocel_qualifier\no1;o1;contains", "event_map_type": "ocel_type;ocel_type_map\nplace order;PlaceOrder", "object_map_type": "ocel_type;ocel_type_map\norders;Orders",
        "event_PlaceOrder": "ocel_id;ocel_time;weight;note;end time\ne1;2024-01-01 10:00:00;2.5;text;2024-01-01 12:30:00",
        "object_Orders": "ocel_id;ocel_time;ocel_changed_field;price;size\no1;2023-01-01 00:00:00;;4;7\no1;2024-01-05 00:00:00;price;5;7\no2;2023-01-01 00:00:00;;9;9",
    }
    for name, text in tables.items():
        (tmp_path / f"{name}.csv").write_text(text)
    log = read_csv_set(spark, str(tmp_path))
    assert log.relations.count() == 1 and log.o2o.count() == 1
    assert tuple(log.events.select("ts", "end_ts").first()) == (datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 12, 30))
    still = read_csv_set(spark, str(tmp_path), None)
    assert tuple(still.events.select("ts", "end_ts").first()) == (datetime(2024, 1, 1, 10),) * 2
    assert [r["oid"] for r in log.objects.collect()] == ["o1"]  # o2 has no event
    assert [tuple(r) for r in log.event_attrs.collect()] == [("e1", "weight", 2.5)]
    assert sorted((r["name"], r["ts"].year, r["changed"], r["value"]) for r in log.object_attrs.collect()) == [("price", 1970, False, 4.0), ("price", 2024, True, 5.0), ("size", 1970, False, 7.0)]


def test_numeric_attributes(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", None), ("b", "1"), ("b", "x")], "name string, value string")
    assert [tuple(r) for r in numeric(rows).collect()] == [("a", 1.0)]


def test_write_back_and_reload(spark):
    day = lambda d: f"2024-01-{d:02} 06:00:00"
    log = make_log(spark, [(f"p{d}", "pick", day(d), day(d)) for d in range(1, 8)], [(f"p{d}", o, t) for d in range(1, 8) for o, t in ((f"o{d}", "order"), ("v", "van"))])
    p = Properties(spark, log, DAILY, "sum")
    series = p.collect(["ep1", "op1", "op6"])
    written = with_series(spark, p, series)
    assert {r["oid"] for r in written.objects.filter("otype = 'time series'").collect()} >= {"ts&ep1&pick", "ts&op1&van", "ts&op6&order|van"}
    key = lambda df: {(r["property"], r["param1"], r["param2"], r["idx"], r["t"], r["value"]) for r in df.collect()}
    assert key(reload_series(written)) == key(series)
    last = len(p.grid.rights) - 1
    points = spark.createDataFrame([("ep1", "pick", None, i) for i in (1, 2, last)], "property string, param1 string, param2 string, idx int")
    name = attribute_name("Change Point Detection", "rbf", 3, None, 1.5)
    assert name == "Change Point Detection(rbf, 3, 1.5)"
    marked = with_points(written, points, p.grid, name)
    history = sorted((r["ts"], r["value"]) for r in marked.object_attrs.filter(F.col("name") == name).collect())
    before = lambda i: datetime.combine((*p.grid.rights, p.grid.rights[-1] + timedelta(1))[i], datetime.min.time()) - timedelta(seconds=1)
    assert history == [(datetime(1970, 1, 1), 0.0), (before(1), 1.0), (before(2), 1.0), (before(3), 0.0), (before(last), 1.0), (before(last + 1), 0.0)]
    assert reload_points(marked, "Change Point Detection").count() == 3
    ahead = spark.createDataFrame([("ep1", "pick", None, last + 1, 2.5)], "property string, param1 string, param2 string, idx int, value double")
    assert with_forecasts(written, ahead, p.grid, "Forecasting()").object_attrs.filter("name = 'Forecasting()' and value = 2.5").count() == 1
    side = "struct<property:string,param1:string,param2:string>"
    causes = spark.createDataFrame([(("ep1", "pick", None), ("op6", "order", "van"), [1, 3])], f"caused {side}, causing {side}, lags array<int>")
    assert [tuple(r) for r in reload_causes(with_causes(written, causes)).collect()] == [(("ep1", "pick", None), ("op6", "order", "van"), [1, 3])]
    p.grid.needs_forecast_length() if len(p.grid.rights) > 12 else None
    carried = with_forecasts(with_causes(marked, causes), ahead.withColumn("idx", F.lit(last + 700)), p.grid, "Forecasting()")
    (far,) = reload_forecasts(carried, p.grid).collect()
    assert (far["idx"], far["t"], far["value"]) == (last + 700, p.grid.rights[-1] + timedelta(700), 2.5)
    assert [r["idx"] for r in reload_marks(marked, "Change Point Detection", p.grid).filter("value = 1").orderBy("idx").collect()] == [1, 2, last]
    assert reload_marks(marked, "Change Point Detection", p.grid).count() == last + 1
    named = with_points(written, points, p.grid, "Threshold Based Point Detection(nlargest, 3)")
    assert {r["property"] for r in reload_marks(named, "Threshold Based Point Detection", p.grid).collect()} == {"Threshold Based Points (nlargest, 3) for ep1"}
    for technique, params, done in (("Change Point Detection", (), marked), ("Granger Causality", (), carried), ("Forecasting", (), carried), ("Threshold Based Point Detection", ("nlargest", 3), named), ("Guessing", (), log)):
        with pytest.raises(ValueError):
            refuse_repetition(done, technique, *params)
    refuse_repetition(named, "Threshold Based Point Detection", "nlargest", 4)
    refuse_repetition(written, "Forecasting")
    assert written.is_enriched() and not log.is_enriched()
    assert written.activities() == ["dummy", "pick"] and log.object_types() == ["order", "van"]
    assert {r["n"] for r in log.interactions().collect()} == {1} and set(log.extended().first()["objects"]) == {"order", "van"} and log.summary().filter("otype = 'van'").first()["hours"] == 144


def test_results_as_files(spark, tmp_path):
    series = spark.createDataFrame([(p, a, b, i, date(2024, 1, 1 + i), i / 3) for p, a, b in (("ep1", "pick", None), ("ep4", 'place "it"', "a/b, c")) for i in range(3)], "property string, param1 string, param2 string, idx int, t date, value double")
    rows = lambda df: sorted(map(repr, df.collect()))
    write_series_csv(series, str(tmp_path / "ts"))
    assert rows(read_series_csv(spark, str(tmp_path / "ts"))) == rows(series)
    points = series.filter("idx > 0").select("property", "param1", "param2", "idx")
    side = "struct<property:string,param1:string,param2:string>"
    causes = spark.createDataFrame([(("ep1", "pick", None), ("ep4", 'place "it"', "a/b, c"), [1, 3]), (("ep1", "pick", None), ("ep1", "[odd]", None), [2])], f"caused {side}, causing {side}, lags array<int>")
    for kind, made, back in (("points", points_json(points), points), ("forecasts", forecasts_json(series), series.drop("idx")), ("causes", causes_json(causes), causes)):
        made.write.text(str(tmp_path / kind))
        assert rows(read_results(spark, str(tmp_path / kind), kind)) == rows(back)
        (tmp_path / f"{kind}.json").write_text("[" + ",\n".join(r["value"] for r in made.collect()) + "]")  # as one array
        assert rows(read_results(spark, str(tmp_path / f"{kind}.json"), kind)) == rows(back)
    made = [json.loads(r["value"]) for r in points_json(points).collect()]
    assert {"tsid": ["ep1", "pick"], "ar": [2, 3]} in made and {"tsid": ["ep4", ['place "it"', "a/b, c"]], "ar": [2, 3]} in made
    assert {"tsid": ["ep1", "pick"], "ar": {"2024-01-01T00:00:00.000Z": 0.0, "2024-01-02T00:00:00.000Z": 1 / 3, "2024-01-03T00:00:00.000Z": 2 / 3}} in [json.loads(r["value"]) for r in forecasts_json(series).collect()]


def test_selection(spark):
    day = lambda d, h=0: f"2024-01-{d:02} {h:02}:00:00"
    events = [(f"{a}{d}", a, day(d, h), day(d, h)) for d in range(1, 20) for a, h in (("pick", 6), ("ship", 12))]
    relations = [x for d in range(1, 20) for x in ((f"pick{d}", f"o{d}", "order"), (f"pick{d}", f"i{d}", "item"), (f"ship{d}", f"o{d}", "order"))]
    log = make_log(spark, events, relations)
    part = Properties(spark, log, DAILY, "mean", start=date(2024, 1, 4), end=date(2024, 1, 12), event_types=("pick",), object_types=("order",))
    assert (part.grid.left, part.grid.rights[-1]) == (date(2024, 1, 4), date(2024, 1, 12))
    ids = lambda df: {(r["param1"], r["param2"]) for r in df.collect()}
    assert ids(part.ep1()) == {("pick", None)} and ids(part.ep4()) == {("pick", "order")} and ids(part.op1()) == {("order", None)} and ids(part.op4()) == {("order", "pick")}
    assert ids(part.op6()) == set() and ids(part.pp6()) == {("pick", "order")}
    assert {r["value"] for r in replace(part, event_types=None).pp1().filter("param1 = 'ship'").collect()} == {6.0}  # the pick before counts, selected or not
    with pytest.raises(ValueError):
        replace(part, end=date(2024, 1, 6)).ep1()
    with pytest.raises(ValueError):
        part.grid.needs_forecast_length()


def test_latest_values_by_every_mechanism(spark):
    """The value of an attribute at a time, against looking at its whole history."""
    import random

    rng = random.Random(5)
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    events = [(f"e{i}", "a", str(at(rng.randrange(0, 960, 6))), "") for i in range(60)]
    events = [(e, a, s, s) for e, a, s, _ in events]
    relations = [(e, f"o{rng.randrange(6)}", "order") for e, *_ in events]
    history = [(f"o{o}", "price", "1970-01-01 00:00:00", False, float(o)) for o in range(6)] + [(f"o{o}", "price", str(at(rng.randrange(0, 960, 12))), True, float(rng.randrange(99))) for o in range(6) for _ in range(15)]
    log = make_log(spark, events, relations, (), history)
    for mechanism in ("starting", "ending", "contains", "overlaps"):
        p = Properties(spark, log, WEEKLY, "sum", mechanism)
        wide = p.object_times.join(log.object_attrs, "oid").filter("ts <= t").groupBy("oid", "t").agg(F.max(F.struct("ts", "changed", "value")).alias("x")).collect()
        want: dict = {}
        for r in wide:
            label_ = period_end(r["t"].date(), WEEKLY)
            want[label_] = want.get(label_, 0) + r["x"]["value"]
        got = {r["t"]: r["value"] for r in p.op2().collect()}
        assert all(want.get(t, 0) == v for t, v in got.items()) and (got or mechanism != "overlaps")


def test_small_tables_are_held(spark):
    df = spark.range(10).filter("id > 3")
    assert held(df).count() == 6 and "LocalTableScan" in held(df)._jdf.queryExecution().executedPlan().toString()
    assert held(df, 3) is df


def test_types_are_broadcast(spark):
    """Events aren't dealt by their activity or by the type of an object."""
    log = make_log(spark, [(f"e{i}", "a", f"2024-01-{i + 1:02}", f"2024-01-{i + 1:02}") for i in range(9)], [(f"e{i}", f"{t}{i}", t) for i in range(9) for t in "xy"])
    p = Properties(spark, log, DAILY)
    for series in (p.ep4(), p.op4(), p.pp6(), p.pp7()):
        plan = series._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\((activity|otype)#", plan)
