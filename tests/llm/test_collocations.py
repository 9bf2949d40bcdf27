"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import collocations as module
from tidelog.llm.collocations import BITS, _Slice, _sliced, bitmap, collocations, ranked, unsqueezed

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, longest=5):
    """rows: (lang, text)."""
    f, n, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + k])] += 1
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = set()
        for p, a in candidates.items():
            held |= {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= candidates.get(p[i:j], a + 1)}
        scored = []
        for p, a in candidates.items():
            if p not in held:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return out


def texts(rng, n):
    phrases = ["new york city hall", "rock and roll", "É tat major", "once upon a time there", "a a a a a a"]
    for _ in range(n):
        ws = [rng.choice(phrases) if rng.random() < 0.1 else f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.randrange(0, 60))]
        yield "".join(w + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x0b"]) for w in ws)


@pytest.mark.parametrize("least,slice_bytes,most_sent", [(3, 3000, 0), (2, 1 << 20, 2_000_000)])
def test_collocations(spark, least, slice_bytes, most_sent, monkeypatch):
    """Whether frequent words and pairs are sent to the tasks or joined."""
    monkeypatch.setattr(module, "MOST_SENT", most_sent)
    monkeypatch.setattr(module, "MOST_WORDS", most_sent)
    rng = random.Random(least)
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), t) for t in texts(rng, 400)]
    rows += [("en", None), ("en", ""), (None, " \t\n"), ("en", "New\x1cYork NEW york city"), ("fr", " ".join(texts(rng, 100))), rows[3], rows[3]]
    docs = spark.createDataFrame([(lang, t, 5, "x") for lang, t in rows], "lang string, text string, n bigint, phrase string").repartition(3)
    got = collocations(docs, least, 100, slice_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, least, 100))


def test_rare_and_empty(spark, docs, none):
    assert collocations(none).collect() == [] and collocations(docs, 10_000).collect() == []
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert sorted(map(tuple, collocations(docs, 5, 30).collect())) == sorted(brute(rows, 5, 30))


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from tidelog.llm.collocations import _best

    a, n, one, rest = 7_000_000_000_000, 90_000_000_000_000, [7_000_000_000_123, 8_000_000_000_321], [7_100_000_000_000, 7_000_000_000_007]
    rows = spark.createDataFrame([("x", ["a", "b", "c"], a, one, rest, n)], "lang string, words array<string>, f bigint, firsts array<bigint>, rests array<bigint>, n bigint")
    got = _best(rows, 5).select("l", "r", "score", F.col("rank")).first()
    score, k = min((1000 * a * n // (one[i] * rest[i]), i) for i in range(2))
    assert tuple(got) == (one[k], rest[k], score, 1)


def test_a_long_text_is_cut_into_slices_that_overlap():
    import pyarrow as pa

    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(5000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "text": [text, "tail end"]})
    rows = [r.to_pylist()[0] for r in _sliced(2000, 4)([batch])]
    assert len(rows) > 5 and sum(sum(w["n"] for w in r["words"]) for r in rows) == 5002
    words = []
    for r in rows:
        names = {w["id"]: w["word"].decode() for w in r["words"]} | {0: "|"}
        tokens = [names[t] for t in unsqueezed(r["tokens"], np.int32)]
        if words:
            assert tokens[:4] == ahead or ahead == []
        words += tokens[: r["own"]]
        ahead = tokens[r["own"] :]
    assert words == [*text.split(), "|", "tail", "end", "|"]
    assert _Slice().parts == []


def test_ranked_numbers_are_places(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "f bigint, k bigint").repartition(5)
    got = sorted(map(tuple, ranked(df, df.f.desc(), "k").select("id", "f", "k").collect()))
    assert [(f, k) for _, f, k in got] == sorted(rows, key=lambda r: (-r[0], r[1])) and [i for i, _, _ in got] == list(range(500))


def test_bitmap_has_every_pair(spark):
    rows = [(i * 7, 10**9 + i) for i in range(300)]
    bits = bitmap(spark.createDataFrame(rows, "left bigint, right bigint"))
    assert len(bits) == BITS and bits.sum() <= 300 and all(bits[(a * 48271 + b) % BITS] for a, b in rows)


def test_arrays_of_a_task_are_bounded(monkeypatch):
    """Beyond the numbers of a slice themselves, a task's arrays don't follow the slice."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    n = 2_000_000
    ids = np.random.default_rng(8).integers(-1, 100, n)
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([module.squeezed(ids)], pa.binary()), "own": pa.array([n - 4])})
    tracemalloc.start()
    got = [r.to_pylist()[0] for r in module._tiled(4, 3, 1)([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * ids.nbytes
    pairs = Counter()
    for r in got:
        left, right, f = (unsqueezed(r[c]).tolist() for c in ("left", "right", "n"))
        pairs.update(dict(zip(zip(left, right, strict=True), f, strict=True)))
    own = ids[: n - 3]
    assert pairs == Counter((a, b) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True) if a >= 0 and b >= 0)


def test_parts_of_a_slice_meet(spark, monkeypatch):
    """Few places in one go, few entries held, few words in a batch."""
    for name, value in (("PLACES", 16), ("MOST_ENTRIES", 40), ("LISTED", 7), ("DENSE", 3), ("TILE", 2)):
        monkeypatch.setattr(module, name, value)
    rows = [("en" if i % 3 else None, t) for i, t in enumerate(texts(random.Random(9), 150))]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert sorted(map(tuple, collocations(docs, 3, 100, 4000).collect())) == sorted(brute(rows, 3, 100))


def test_lists_of_words_are_one_value(spark, monkeypatch):
    monkeypatch.setattr(module, "LISTED", 2)
    docs = spark.createDataFrame([("en", "a b a c d. a"), (None, "a b")], "lang string, text string")
    made = module.slices(docs)
    assert dict(made.dtypes)["words"] == "binary"
    got = Counter()
    for lang, word, n in module.listed_words(made, "lang string, word binary, n bigint").collect():
        got[lang, bytes(word).decode()] += n
    assert got == {("en", "a"): 3, ("en", "b"): 1, ("en", "c"): 1, ("en", "d"): 1, ("und", "a"): 1, ("und", "b"): 1}
