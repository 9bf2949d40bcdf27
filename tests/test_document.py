"""One JSON document, read and written by many tasks."""

import json
import random
import re
from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from tests.test_log import make_log
from tests.test_spans import small_log
from tidelog.plans.queries import QUERIES
from tidelog.sources import document
from tidelog.sources.document import document_elements
from tidelog.sources.log import read_ocel_json, write_ocel_document, write_ocel_lines


@pytest.fixture(params=[300, 4000, 1 << 20])
def split(spark, request):
    """Files in ranges of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def odd(rng):
    return rng.choice(['a"b', "}{", "\\", '\\"', "]},{[", "é\n\t", "", '"}', "\\\\", "x" * rng.randrange(400), '{"a":[1,2]}', "  }", "end\\"])


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_are_those_of_the_whole_document(spark, split, tmp_path, indent):
    rng = random.Random(split)
    plain = lambda: rng.choice([odd(rng), 3, None, True, [odd(rng), {"k}": odd(rng)}], []])
    made = lambda depth=0: {odd(rng): made(depth + 1) if depth < 2 and rng.random() < 0.3 else plain() for _ in range(rng.randrange(4))}
    doc = {"version}": 1, "none": [], "events": [made() for _ in range(60)], "text": odd(rng), "objects": [made() for _ in range(40)], "one": [{}], "numbers": [1, "}", 2]}
    doc.pop("version}")
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    rows = document_elements(spark, str(path))
    got = {}
    for r in rows.collect():
        got.setdefault(r["array"], []).append(json.dumps(json.loads(r["value"], strict=False)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(map(json.dumps, v)) for k, v in doc.items() if isinstance(v, list) and any(isinstance(x, dict) for x in v)}
    if split == 300:
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3


def tables(log):
    return {name: sorted(map(str, getattr(log, name).select(*sorted(getattr(log, name).columns)).collect())) for name in ("events", "relations", "objects", "event_attrs", "object_attrs", "o2o")}


@pytest.mark.parametrize("split", [9000, 1 << 20], indirect=True)
def test_a_document_is_valid_and_gives_the_log_back(spark, split, tmp_path):
    log = small_log(spark, 8)
    path = str(tmp_path / "log.json")
    write_ocel_document(log, path)
    doc = json.loads((tmp_path / "log.json").read_text(encoding="utf-8"))
    assert list(doc) == ["eventTypes", "objectTypes", "events", "objects"] and len(doc["events"]) == log.events.count()
    assert [e["id"] for e in doc["events"]] == sorted(e["id"] for e in doc["events"])
    write_ocel_lines(log, str(tmp_path / "lines"))
    assert tables(read_ocel_json(spark, path)) == tables(read_ocel_json(spark, str(tmp_path / "lines"), lines=True))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["lines", "log.json"]


def test_an_empty_log_is_a_document(spark, tmp_path):
    at = datetime(2024, 1, 1)
    log = make_log(spark, [("e", "a", at.isoformat(), (at + timedelta(hours=1)).isoformat())], [("e", "o", "t")])
    none = type(log)(*[getattr(log, f).limit(0) for f in ("events", "relations", "objects", "event_attrs", "object_attrs", "o2o")])
    write_ocel_document(none, str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"eventTypes": [], "objectTypes": [], "events": [], "objects": []}
    assert read_ocel_json(spark, str(tmp_path / "none.json")).events.count() == 0
    write_ocel_document(log, str(tmp_path / "one.json"))
    assert read_ocel_json(spark, str(tmp_path / "one.json")).events.first()["end_ts"] == at + timedelta(hours=1)


def test_the_query_reads_its_document(spark):
    assert "log_of_a_document" in QUERIES


def test_lines_are_read_whole_where_elements_end_with_them(spark, tmp_path):
    one, two = tmp_path / "one.json", tmp_path / "two.json"
    write_ocel_document(small_log(spark, 8), str(one))
    text = one.read_text(encoding="utf-8")
    two.write_text(text.replace("}\n", "}"), encoding="utf-8")
    assert text.count("}\n") > 16 and [document._separator(spark, str(p)) for p in (one, two)] == ["}\n", "}"]
    rows = lambda p: sorted(map(str, document_elements(spark, str(p)).collect()))
    assert rows(one) == rows(two)


@pytest.mark.parametrize("text", ['"a\\\\":"}{"]', '{"a":"\\"}","b":[1,{"\\\\\\"":2}]}', "", "\\", '"', "}]}", 'é"{é\\"'])
def test_marks_are_those_of_a_plain_scan(text):
    data, inside, quotes, want, i = text.encode(), False, 0, [], 0
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            i += 2
            continue
        if c in b'"{}[]':
            quotes += c == b'"'
            want.append((i, {b'"': 2, b"{": 1, b"[": 1}.get(c, -1), quotes))
        i += 1
    places, kinds, n = document._marks(data)
    # Brackets that are escaped lie in strings and don't count.
    assert [x for x in zip(places.tolist(), kinds.tolist(), n.tolist(), strict=True) if x[1] == 2] == [x for x in want if x[1] == 2]
    outside = lambda rows: [x for x in rows if x[1] != 2 and x[2] % 2 == 0]
    assert outside(zip(places.tolist(), kinds.tolist(), n.tolist(), strict=True)) == outside(want)


def test_events_of_a_document_come_in_rows(spark, tmp_path):
    """Links to objects that aren't there and attributes with a value that isn't a number are left out, without a shuffle by event."""
    links = [{"objectId": o, "qualifier": "q"} for o in ("o1", "lost", "o2")]
    attributes = [{"name": "n", "value": "5"}, {"name": "t", "value": "x"}, {"name": "end time", "value": "2024-01-01 05:00:00"}]
    events = [{"id": f"e{i}", "type": "a", "time": "2024-01-01T00:00:00", "attributes": attributes[: i + 1], "relationships": links[: i + 1]} for i in range(3)]
    doc = {"eventTypes": [], "objectTypes": [], "events": events, "objects": [{"id": o, "type": "t", "attributes": [], "relationships": []} for o in ("o1", "o2", "unused")]}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    log = read_ocel_json(spark, str(tmp_path / "doc.json"))
    rows = lambda x: sorted((r["eid"], r["activity"], r["ts"], r["end_ts"], sorted(map(tuple, r["attributes"] or [])), sorted(map(tuple, r["relationships"] or []))) for r in x.gathered().collect())
    apart = replace(log, listed=None)
    assert rows(log) == rows(apart) and rows(log)[2][4:] == ([("n", 5.0)], [("o1", "q"), ("o2", "q")])
    assert not re.search(r"hashpartitioning\([^)]*(eid|id)#", log.gathered()._jdf.queryExecution().executedPlan().toString())
    assert replace(log, relations=log.relations.filter("true")).in_rows() is None
    twice = {**doc, "objects": [*doc["objects"], doc["objects"][0]]}
    (tmp_path / "twice.json").write_text(json.dumps(twice))
    again = read_ocel_json(spark, str(tmp_path / "twice.json"))
    assert again.in_rows() is None and rows(again) == rows(replace(again, listed=None))
