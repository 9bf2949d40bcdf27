"""A source that has events with their objects: no shuffle by event, and the same results as by separate tables."""

import re
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidelog.operators import preceding as preceding_module
from tidelog.operators.properties import Properties
from tidelog.operators.sweep import dyadic
from tidelog.operators.writeback import related, with_series
from tidelog.plans.queries import _written
from tidelog.sources import log as log_module
from tidelog.sources.log import atomic, held, ocel_rows, orders_log, read_ocel_json, write_ocel_lines

SF = "/root/testdata/sf0.001"


def listed(df):
    return sorted((r["property"], r["param1"], r["param2"] or "", r["idx"], round(r["value"], 6)) for r in df.collect())


def test_no_shuffle_by_event(spark):
    log = atomic(orders_log(spark, SF))
    p = Properties(spark, log, "ME")
    for df in (p.ep4(), p.op4(), log.lifecycles(), p.op6()):
        assert not re.search(r"hashpartitioning\([^)]*eid#", df._jdf.queryExecution().executedPlan().toString())
    assert replace(log, events=log.events.filter("true")).whole is None


@pytest.mark.parametrize("few", [16, 0])
def test_together_as_apart(spark, few, monkeypatch):
    monkeypatch.setattr(preceding_module, "FEW_TYPES", few)
    log = orders_log(spark, SF)
    names = ["ep3", "op4", "pp1", "pp7"]
    together = listed(Properties(spark, log, "QE", "mean", "starting", False).collect(names))
    assert together and together == listed(Properties(spark, replace(log, together=None), "QE", "mean", "starting", False).collect(names))


def test_events_are_written_without_a_shuffle(spark):
    log = orders_log(spark, SF)
    rows = lambda x: sorted((r["id"], r["type"], r["time"], sorted(map(tuple, r["attributes"])), sorted(map(tuple, r["relationships"]))) for r in ocel_rows(x)[0].collect())
    assert "Exchange" not in ocel_rows(log)[0]._jdf.queryExecution().executedPlan().toString()
    assert rows(log) == rows(replace(log, together=None))
    assert replace(log, event_attrs=log.event_attrs.filter("value > 1e9")).gathered().filter("attributes is not null").count() == 0


def test_links_go_on_in_further_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_module, "LINKS_OF_LINE", 10)
    log = orders_log(spark, SF)
    customers = log.objects.filter("otype = 'customer'").select(F.lit("hub").alias("oid"), F.col("oid").alias("oid_2"), F.lit("all").alias("qualifier"))
    hub = log.relations.select(F.min("eid").alias("eid"), F.lit("hub").alias("oid"), F.lit("x").alias("otype"), F.lit("").alias("qualifier"))
    log = replace(log, relations=log.relations.unionByName(hub), objects=log.objects.unionByName(hub.select("oid", "otype")), o2o=log.o2o.unionByName(customers))
    path = str(tmp_path / "lines")
    write_ocel_lines(log, path, "gzip")
    names = [p.name for p in (tmp_path / "lines").iterdir() if p.name.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names)
    of_hub = spark.read.schema(log_module.OCEL_SCHEMA).json(path).select(F.inline("objects")).filter("id = 'hub'")
    assert of_hub.count() > 1 and of_hub.agg(F.max(F.size("relationships"))).first()[0] < customers.count()
    again = read_ocel_json(spark, path, lines=True)
    for table in ("relations", "objects", "object_attrs", "o2o"):
        one, two = (getattr(x, table).select(*sorted(getattr(x, table).columns)) for x in (log, again))
        wanted = one.join(log.relations.select("oid").distinct(), "oid", "left_semi") if table == "object_attrs" else one
        if table == "object_attrs":
            assert sorted(map(str, wanted.select("name", "oid", "value").collect())) == sorted(map(str, two.select("name", "oid", "value").collect()))
        else:
            assert sorted(map(str, wanted.collect())) == sorted(map(str, two.collect()))


def test_packed_ids_sort_like_ids(spark):
    ids = ["", "l", "o", "o-1", "o-10", "o-1-", "l--1", "l-+1", "o-9", "o-19", "l-1-2-3-4-19960101", "l-1-2-3-41-19960101", "l-1-2-3-4-19960102"]
    rows = spark.createDataFrame([(x,) for x in ids], "eid string").withColumn("code", log_module.packed(F.col("eid")))
    assert [r[0] for r in rows.orderBy("code").select(log_module.unpacked(F.col("code"))).collect()] == sorted(ids)
    assert rows.filter("octet_length(code) > ceil(length(eid) / 2)").isEmpty()
    whole = orders_log(spark, SF).whole
    assert whole.filter(F.col("code").isNull() | (log_module.unpacked(F.col("code")) != F.col("eid"))).isEmpty()


@pytest.mark.parametrize("is_atomic", [True, False])
def test_long_ids_are_not_dealt(spark, is_atomic):
    log = orders_log(spark, SF)
    log = atomic(log) if is_atomic else log
    pairs = preceding_module.preceding(log, is_atomic)
    assert "unhex(" in pairs._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(str, df.select("eid", "prev_eid", "prev_end", "types").collect()))
    assert rows(pairs) == rows(preceding_module.preceding(replace(log, together=None), is_atomic))
    # Of pp6 nothing of the predecessors but their ends is dealt by event.
    p = Properties(spark, log, "QE", "mean", "starting", is_atomic).pp6()
    assert "prev_key" not in p._jdf.queryExecution().optimizedPlan().toString()
    both = Properties(spark, log, "QE", "mean", "starting", is_atomic).collect(["pp6", "pp7"]).filter("property = 'pp6'")
    assert listed(p) == listed(both)


def test_latest_values_and_equal_spans(spark):
    log = atomic(orders_log(spark, SF))
    plan = Properties(spark, log, "D", "max").collect(["op2"])._jdf.queryExecution().optimizedPlan().toString()
    assert "max(struct(" not in plan and "max(named_struct(" not in plan  # one order of an object's values instead
    spans = spark.range(40).select(F.lit("a").alias("param1"), F.lit(None).cast("string").alias("param2"), (F.col("id") % 2).cast("int").alias("low"), F.lit(9).alias("high"), F.col("id").cast("double").alias("v"))
    found = dyadic(spans, 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan[plan.rindex("Generate inline(") :]  # equal spans are one before they are cut
    got = {r["idx"]: (r["n"], r["total"], r["least"], r["most"]) for r in found.collect()}
    assert got == {i: (20, 380.0, 0.0, 38.0) if i == 0 else (40, 780.0, 0.0, 39.0) for i in range(10)}


def test_objects_of_a_series_of_one_type_need_no_distinct(spark):
    p = Properties(spark, atomic(orders_log(spark, SF)), "ME", "sum")
    series = p.op1()
    plan = related(p, series)[1]._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Aggregate [series#") <= 1
    rows = related(p, p.collect(["op1", "op6"]))[1]
    assert rows.count() == rows.distinct().count() > p.counted_objects.count()
    narrow = replace(p, mechanism="ending")
    assert related(narrow, series)[1].count() == narrow.counted_objects.count()


@pytest.mark.parametrize("few", [64, 1])
def test_activities_told_by_numbers(spark, few, monkeypatch):
    monkeypatch.setattr(preceding_module, "FEW_ACTIVITIES", few)
    log = orders_log(spark, SF)
    rows = lambda x: sorted((r["activity"], r["start"], r["stop"], r["latest"] or 0, r["earliest"] or 0, str(r["links"])) for r in preceding_module.events_with_ends(x, False, True).collect())
    found = preceding_module.events_with_ends(log, False, False)._jdf.queryExecution().optimizedPlan().toString()
    assert ("element_at([place order,ship item]" in found) == (few == 64)
    apart = rows(replace(log, together=None))
    assert rows(log) == apart
    if few == 64:
        heavy = [r["oid"] for r in log.lifecycles().orderBy(F.desc("n_events")).limit(3).collect()]
        monkeypatch.setattr(preceding_module, "_heavy", lambda log: (heavy, 4))
        assert rows(log) == apart


@pytest.mark.parametrize("mechanism", ["starting", "ending", "contains", "overlaps"])
@pytest.mark.parametrize("is_atomic", [True, False])
def test_an_enriched_log_has_its_events_in_rows(spark, mechanism, is_atomic):
    log = orders_log(spark, SF)
    log = atomic(log) if is_atomic else log
    p = Properties(spark, log, "QE", "mean", mechanism, is_atomic, start=date(1996, 2, 10), end=date(1997, 5, 20), event_types=("ship item",))
    enriched = with_series(spark, p, held(p.collect(["ep1", "ep3", "op1"])))
    listed = lambda x: sorted((r["eid"], r["activity"], r["ts"], r["end_ts"], sorted(map(tuple, r["attributes"] or [])), sorted(map(tuple, r["relationships"] or []))) for r in x.gathered().collect())
    rows, apart = listed(enriched), listed(replace(enriched, listed=None))
    assert rows == apart and sum(r[0].endswith("dummy_event") for r in rows) == 2
    assert 0 < sum(any(o.startswith("ts&ep") for o, _ in r[5]) for r in rows) < len(rows)
    assert not re.search(r"hashpartitioning\([^)]*eid#", enriched.gathered().filter("activity <> 'dummy'")._jdf.queryExecution().executedPlan().toString())
    assert replace(enriched, event_attrs=log.event_attrs.filter("value > 1")).in_rows() is None


def test_objects_of_a_written_log_are_made_once(spark):
    log, p = _written(spark, SF)
    assert "l_orderkey" not in log.objects._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in related(p, p.collect(["op1"]).limit(5))[1]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, p.log.objects.collect())) == sorted(map(tuple, orders_log(spark, SF).objects.collect()))


@pytest.mark.parametrize("is_atomic", [True, False])
@pytest.mark.parametrize("few", [0, 2, 16])
def test_only_pairs_that_may_be_linked_twice_are_dealt_by_event(spark, few, is_atomic, monkeypatch):
    monkeypatch.setattr(preceding_module, "FEW_OBJECTS", few)
    log = orders_log(spark, SF)
    # Some events have the same part and supplier as others of their order.
    log_whole = log.whole.withColumn("objects", F.expr("transform(objects, x -> if(x.otype = 'order', x, struct(concat(x.otype, '-', pmod(xxhash64(x.oid), 3)) as oid, x.otype as otype)))"))
    relations = log_whole.select("eid", F.inline("objects")).withColumn("qualifier", F.lit(""))
    log = replace(log, relations=relations, together=(log.events, relations, log_whole, log.event_attrs))
    log = atomic(log) if is_atomic else log
    rows = lambda df: sorted(map(str, df.select("eid", "prev_eid", "prev_end", "types").collect()))
    found = preceding_module.preceding(log, is_atomic)
    assert rows(found) == rows(preceding_module.preceding(replace(log, together=None), is_atomic))
    sizes = {r[0] for r in found.select(F.size("types")).distinct().collect()}
    assert max(sizes) > 1 and 1 in sizes
    shared = preceding_module._found(log, is_atomic, None, signed=True)[0].filter("prev_key is not null")
    dealt = shared.filter("shared").count()
    assert dealt == shared.count() if few == 0 else 0 < dealt < shared.count()


def test_all_properties_deal_no_event_for_its_values_and_no_object_twice(spark):
    log = orders_log(spark, SF)
    p = Properties(spark, log, "QE", "mean", "overlaps", False)
    plan = p.collect(["ep2", "op2", "op3", "op4", "op5"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*eid#", plan) and "hashpartitioning(oid#" in plan
    assert "l_orderkey" not in p.lifecycles._jdf.queryExecution().optimizedPlan().toString()
    names = ["ep2", "op2", "op4", "pp1", "pp7"]
    together = listed(Properties(spark, log, "QE", "mean", "overlaps", False).collect(names))
    assert together == sorted(x for name in names for x in listed(Properties(spark, replace(log, together=None), "QE", "mean", "overlaps", False).collect([name])))


def test_times_are_numbers_of_the_longest_unit(spark):
    log = orders_log(spark, SF)
    for more, unit in (("0 seconds", 3_600_000_000), ("60 seconds", 60_000_000), ("1 second", 1_000_000), ("0.001 seconds", 1000), ("0.000001 seconds", 1)):
        whole = log.whole.withColumn("end_ts", F.expr(f"end_ts + interval {more}"))
        events = log.events.withColumn("end_ts", F.expr(f"end_ts + interval {more}"))
        moved = replace(log, events=events, together=(events, log.relations, whole, log.event_attrs))
        assert preceding_module._unit(moved, False) == unit and preceding_module._unit(moved, True) == 3_600_000_000
        if unit in (1, 60_000_000):
            rows = lambda x: sorted((r["activity"], r["start"], r["stop"], r["latest"] or 0, r["earliest"] or 0, str(r["links"])) for r in preceding_module.events_with_ends(x, False, True).collect())  # noqa: B023, E731
            micros = rows(moved)
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(preceding_module, "_unit", lambda log, is_atomic: 1)
                assert rows(moved) == micros
