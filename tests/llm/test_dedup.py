import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import minhash_dedup as minhash
from tidelog.llm.common import discard, materialize
from tidelog.llm.components import components
from tidelog.llm.minhash_dedup import keep_one, minhash_dedup
from tidelog.llm import suffix_dedup as suffix_module
from tidelog.llm.suffix_dedup import runs, suffix_dedup


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if len(words) >= size else frozenset([tuple(words)])


def brute_components(rows, size):
    """(n_shingles, smallest doc_id reachable) of each row."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(known, doc)
    return [(len(sets[i]), least[find(i)]) for i in range(len(rows))]


def near_copies():
    """Groups whose copies are linked only by way of others, a hot passage, and single texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for edits, copies in ((0, 3), (2, 25), (4, 25), (7, 25)):
        base = [word() for _ in range(150)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(150)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(20)]) for _ in range(40)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_minhash_dedup(spark, docs, rows, none):
    for size, table, made in ((4, docs, rows), (5, None, near_copies())):
        table = table if table is not None else spark.createDataFrame(made, "doc_id bigint, text string")
        got = minhash_dedup(table, size)
        want = Counter((i, n, c) for (i, _), (n, c) in zip(made, brute_components(made, size), strict=True))
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
        groups = Counter(r["component_id"] for r in got.filter("kept and n_shingles > 0").collect())
        assert set(groups.values()) <= {1} or size == 4
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.filter("doc_id is not null").collect())
        firsts = Counter(r["component_id"] for r in got.filter("first and n_shingles > 0").collect())
        assert max(firsts.values()) == 1 or (size == 4 and {k for k, n in firsts.items() if n > 1} == {3})  # two unlike texts share that id
    assert minhash_dedup(none).count() == 0
    kept = keep_one(docs, 4)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {0, 1, 2, 3, 7}
    assert 9 not in {r["doc_id"] for r in kept.collect()}


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    """However small the blocks, and without hub rounds, each pair of a bucket is held against each other once."""
    made = near_copies()
    table = spark.createDataFrame(made, "doc_id bigint, text string")
    monkeypatch.setattr(minhash, "BLOCK", 3)
    for rounds, few in ((0, 0), (8, 0)):
        monkeypatch.setattr(minhash, "HUB_ROUNDS", rounds)
        monkeypatch.setattr(minhash, "FEW_PAIRS", few)
        got = minhash_dedup(table, 5)
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == {(i, n, c) for (i, _), (n, c) in zip(made, brute_components(made, 5), strict=True)}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_suffix(texts):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if counts[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, rows, none):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    long = letters(900)
    made = [letters(300) + long[100:400] + letters(50), long, letters(10) + long[150:349] + letters(10), long[0:200], long[0:199], "ab" * 400, "ba" * 130, letters(220) * 2, "z" * 1000, letters(50) + long[600:900] + letters(200) + long[300:520], "abc" * 300 + letters(100) + "abc" * 300]
    made = list(enumerate(made))
    own = letters(400)
    # Unlike texts without an id or under one id, and copies under one.
    made += [(None, letters(250)), (None, letters(250)), (20, own), (20, own), (20, own + letters(20)), (21, letters(300)), (21, letters(300))]
    for table, texts in ((docs, rows), (spark.createDataFrame(made, "doc_id bigint, text string"), made)):
        got = suffix_dedup(table.withColumn("tid", F.lit("clash")).withColumn("hi", F.lit(1)))
        want = Counter((i, *x) for (i, _), x in zip(texts, brute_suffix([t for _, t in texts]), strict=True))
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == want
    assert suffix_dedup(none).count() == 0


def test_a_long_text_goes_in_pieces(spark):
    """Repeated passages on the borders of pieces, and a text that is repeated over three of them."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    one, two, piece = letters(700), letters(400), suffix_module.PIECE
    long = letters(piece - 350) + one + letters(piece - 351 - 200) + two + letters(300) + one + letters(20_000)
    texts = [long, two + letters(500), "q" * (2 * piece + 500), letters(100) + one[100:350]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = Counter()
    names = [[hashlib.blake2b(t[i : i + 200].encode(), digest_size=8).digest() for i in range(len(t) - 199)] for t in texts]
    for n in names:
        counts.update(n)
    want = set()
    for i, (t, n) in enumerate(zip(texts, names, strict=True)):
        gone = np.zeros(len(t) + 1, int)
        for at in [at for at, x in enumerate(n) if counts[x] > 1]:
            gone[at] += 1
            gone[at + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()
        want.add((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert {tuple(r) for r in suffix_dedup(docs).drop("kept").collect()} == want


def test_a_text_of_one_character_has_few_runs():
    assert len(runs(b"z" * 100_000)[0]) == 2 and len(runs(b"ab" * 50_000)[0]) < 8


def timed(function, *args):
    began = time.time()
    rows = function(*args).collect()
    return time.time() - began, rows


def test_repeated_rows_cost_what_copies_cost(spark):
    """1000 rows of one text: under one id they take at most twice the time of 1000 own ids."""
    rng = random.Random(2)
    text, other = (" ".join(f"w{rng.randrange(9999)}" for _ in range(400)) for _ in range(2))
    near = text + " end"
    table = lambda ids: spark.createDataFrame([(ids(i), (text, near, other)[i % 3]) for i in range(1000)], "doc_id bigint, text string").repartition(4)
    own, same = table(lambda i: i), table(lambda i: i % 3)
    for function in (suffix_dedup, minhash_dedup):
        slow, rows = timed(function, own)
        assert len(rows) == 1000
        fast, rows = timed(function, same)
        assert len(rows) == 1000 and fast < 2 * slow


def test_tables_are_removed(spark):
    df = materialize(spark.range(3))
    place = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert place.exists() and df.count() == 3
    discard(df)
    assert not place.exists()
    with pytest.raises(KeyError):
        discard(df)
