"""Aggregates of spans against a row for each interval."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_log import make_log
from tidelog.functions.grid import DAILY, MONTHLY, WEEKLY
from tidelog.operators.properties import NAMES, Properties
from tidelog.operators.sweep import blocks, differences, dyadic


def spans(rng, n, count):
    for _ in range(count):
        low = rng.randrange(n)
        yield rng.choice("ab"), rng.choice([None, "x"]), low, min(n - 1, low + int(rng.expovariate(4 / n))), rng.choice([None, *range(-5, 50)])


@pytest.mark.parametrize("n", [1, 2, 8, 365])
def test_differences_and_blocks(spark, n):
    rows = list(spans(random.Random(n), n, 200)) + [("c", None, 0, n - 1, 3), ("c", None, n - 1, n - 1, 9)]
    want = defaultdict(list)
    for a, b, low, high, v in rows:
        if v is not None:
            for i in range(low, high + 1):
                want[a, b, i].append(v)
    df = spark.createDataFrame(rows, "param1 string, param2 string, low int, high int, v bigint")
    got = {(r["param1"], r["param2"], r["idx"]): (r["n"], r["total"]) for r in differences(df, n).collect()}
    assert got == {k: (len(v), sum(v)) for k, v in want.items()}
    got = {(r["param1"], r["param2"], r["idx"]): (r["n"], r["total"], r["least"], r["most"]) for r in dyadic(df, n).collect()}
    assert got == {k: (len(v), sum(v), min(v), max(v)) for k, v in want.items()}


def test_blocks_cover_a_span_once(spark):
    n = 37
    rows = spark.range(n).select(F.col("id").cast("int").alias("low")).join(spark.range(n).select(F.col("id").cast("int").alias("high")), F.expr("low <= high"))
    for r in rows.select("low", "high", blocks(F.col("low"), F.col("high"), n).alias("b")).collect():
        covered = sorted(i for b in r["b"] for i in range(b["block"] << b["level"], (b["block"] + 1) << b["level"]))
        assert covered == list(range(r["low"], r["high"] + 1)) and len(r["b"]) <= 2 * n.bit_length()


def small_log(spark, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 3)
    at = lambda h: (start + timedelta(hours=h)).isoformat(sep=" ")
    events, relations = [], []
    for i in range(240):
        s = rng.randrange(0, 24 * 150)
        events.append((f"e{i:03}", rng.choice(["pick", "ship", "pay"]), at(s), at(s + rng.choice([0, 0, 3, 50, 700]))))
        for t in rng.sample(["order", "item", "van"], rng.randrange(0, 4)):
            relations += [(f"e{i:03}", f"{t}{rng.randrange(9)}", t) for _ in range(rng.randrange(1, 3))]
    attrs = [(f"e{i:03}", "weight", rng.randrange(1, 1000) / 8) for i in range(240)]
    history = [(f"van{i}", "load", "1970-01-01", False, float(i)) for i in range(9)] + [(f"van{rng.randrange(9)}", "load", at(rng.randrange(0, 3000)), True, rng.randrange(99) / 4) for _ in range(40)]
    return make_log(spark, events, relations, attrs, history)


def listed(df):
    return {(r["property"], r["param1"], r["param2"], r["idx"]): round(r["value"], 6) for r in df.collect()}


@pytest.mark.parametrize("rate,mode,mechanism,still", [(WEEKLY, "mean", "overlaps", False), (MONTHLY, "max", "starting", False), (WEEKLY, "min", "overlaps", True)])
def test_properties_together_are_what_they_are_alone(spark, rate, mode, mechanism, still):
    p = Properties(spark, small_log(spark, 4), rate, mode, mechanism, still, "van")
    names = [n for n in NAMES if not (still and n in ("pp3", "pp4"))]
    together = listed(p.collect(names))
    for name in ("ep2", "op4", "pp7", "rp1", "rp2", "rp3"):
        assert listed(getattr(p, name)()) == {k: v for k, v in together.items() if k[0] == name}
    assert {k[0] for k in together} >= {"ep1", "op1", "rp2"}


@pytest.mark.parametrize("mode", ["mean", "sum", "min", "max"])
def test_spans_of_a_log_against_all_intervals(spark, mode):
    """ep1, op5, op4 and rp2 at a daily rate, each interval of each event and object listed."""
    log = small_log(spark, 5)
    p = Properties(spark, log, DAILY, mode, "overlaps", False, "van")
    edges = [datetime(d.year, d.month, d.day) for d in p.grid.edges]
    pairs = list(enumerate(zip(edges, edges[1:], strict=False)))
    touched = lambda s, e: [i for i, (a, b) in pairs if s <= b and e > a]
    events = {r["eid"]: r for r in log.events.collect()}
    own = defaultdict(set)
    for r in log.relations.collect():
        own[r["oid"], r["otype"]].add(r["eid"])
    values, active = defaultdict(list), defaultdict(set)
    for e in events.values():
        for i in touched(e["ts"], e["end_ts"]):
            values["ep1", e["activity"], None, i].append(1)
    shared = [eids for eids in own.values()]
    combos = {(events[e]["activity"], t) for (_, t), eids in own.items() for e in eids if sum(e in x for x in shared) > 1}
    for (oid, otype), eids in own.items():
        start, stop = min(events[e]["ts"] for e in eids), max(events[e]["end_ts"] for e in eids)
        for i in touched(start, stop):
            values["op5", otype, None, i].append((stop - start).total_seconds() / 3600)
            for a, t in combos:
                if t == otype:
                    values["op4", otype, a, i].append(sum(events[e]["activity"] == a for e in eids))
        if otype == "van":
            for e in eids:
                for i in touched(events[e]["ts"], events[e]["end_ts"]):
                    active[i].add(oid)
    how = {"mean": lambda v: sum(v) / len(v), "sum": sum, "min": min, "max": max}[mode]
    want = {k: round(float(sum(v) if k[0] == "ep1" else how(v)), 6) for k, v in values.items()}
    want |= {("rp2", "van", None, i): float(len(x)) for i, x in active.items()}
    got = listed(p.collect(["ep1", "op5", "op4", "rp2"]))
    n = len(pairs)
    for series in {k[:3] for k in want}:
        filled = {i: want.get((*series, i)) for i in range(n)}
        first, last = min(k[3] for k in want if k[:3] == series), max(k[3] for k in want if k[:3] == series)
        zero = lambda i, s=series, a=first, b=last: s[0] in ("ep1", "rp2") or (mode == "sum" and a <= i <= b)
        whole = {i: v if v is not None else 0.0 if zero(i) else None for i, v in filled.items()}
        expected = {} if None in whole.values() else {(*series, i): v for i, v in whole.items()}
        assert {k: v for k, v in got.items() if k[:3] == series} == expected
