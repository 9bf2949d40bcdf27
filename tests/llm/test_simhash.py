"""SimHash near-dedup against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import cases
from tidelog.llm.common import join_split
from tidelog.llm.queries import op13_simhash_dedup
from tidelog.llm.shingles import pieces
from tidelog.llm.simhash_dedup import bk_forest, bk_search, fingerprint_links, fingerprint_of, shard_masks, simhash_dedup


def brute_fingerprint(text, words=4):
    ws = (text or "").encode().lower().split()
    runs = [b" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)] if len(ws) >= words else [b" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_labels(values, radius=4):
    """The smallest place that each value reaches."""
    labels = list(range(len(values)))
    while True:
        now = [min(labels[j] for j, w in enumerate(values) if (v ^ w).bit_count() <= radius) for v in values]
        if now == labels:
            return labels
        labels = now


def brute(rows):
    values = [brute_fingerprint(t) for _, t in rows]
    labels = brute_labels(values)
    ids = {k: min((rows[i][0] for i in range(len(rows)) if labels[i] == k and rows[i][0] is not None), default=None) for k in set(labels)}
    return [(d, f"{v:016x}", ids[k]) for (d, _), v, k in zip(rows, values, labels, strict=True)]


def key(row):
    return tuple((x is None, x) for x in row)


def test_simhash_dedup(spark, docs, none, rows):
    got = simhash_dedup(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)
    assert simhash_dedup(none).collect() == []


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_simhash_dedup(spark, sf_dir).collect()), key=key) == sorted(brute(rows), key=key)


def test_fingerprint_of_long_text_is_that_of_itspieces():
    rng = random.Random(1)
    text = " ".join(f"W{rng.randrange(500)}" for _ in range(3000)) + "\n\x1c é"
    assert b"".join(pieces(text.encode(), 100)) == text.encode() and len(list(pieces(text.encode(), 100))) > 50
    assert fingerprint_of(text, 4) % 2**64 == brute_fingerprint(text)
    long = "ab cd " * 400_000 + "x" * 2_000_000
    assert fingerprint_of(long, 4) % 2**64 == brute_fingerprint(long)


def test_masks_leave_no_pair_apart():
    rng = random.Random(2)
    for n, blocks in ((10, 5), (10**6, 6), (10**9, 7)):
        masks = shard_masks(n, 4)
        assert len(masks) == len({*masks}) and min(m.bit_count() for m in masks) >= 64 * (blocks - 4) // blocks - 1
        for _ in range(300):
            flips = sum(1 << i for i in rng.sample(range(64), 4))
            assert any(m & flips == 0 for m in masks)


def test_bk_search_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 300, dtype=np.uint64) & np.uint64(0x0F0F00FF)
    values, groups = np.unique(values), None
    groups = np.sort(rng.integers(0, 4, len(values)))
    asked, nodes = bk_search(values, bk_forest(values, groups), values, groups, 4)
    want = {(i, j) for i, v in enumerate(values) for j, w in enumerate(values) if groups[i] == groups[j] and int(v ^ w).bit_count() <= 4}
    assert set(zip(asked.tolist(), nodes.tolist(), strict=True)) == want and len(asked) == len(want)


def test_blocks_of_a_large_shard_lose_no_link(spark):
    rng = random.Random(4)
    center = rng.getrandbits(63)
    values = list({center ^ sum(1 << i for i in rng.sample(range(63), rng.randrange(1, 9))) for _ in range(150)} | {rng.getrandbits(63) for _ in range(100)})
    links = [tuple(r) for r in fingerprint_links(spark.createDataFrame([(v,) for v in values], "value bigint"), len(values), 4, block=16).collect()]
    assert all((a ^ b).bit_count() <= 63 for a, b in links)
    group = list(range(len(values)))
    place = {v: i for i, v in enumerate(values)}
    for _ in range(len(values)):
        for a, b in links:
            i, j = place[a], place[b]
            group[i] = group[j] = min(group[i], group[j])
    assert group == brute_labels(values)
    assert len(links) < 10 * len(values) * 6


def test_join_split_keeps_all_rows(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id", F.lit(0).alias("size"))
    table = rows.groupBy("k").agg(F.count("*").alias("size")).withColumn("more", F.col("k") * 2)
    got = join_split(rows, table, "k")
    assert got.count() == 5000 and got.filter("more <> 2 * k").count() == 0 and sorted(got.columns) == ["id", "k", "more", "size"]
    assert got.filter("k = 1").select("size").distinct().collect()[0][0] == 3000


def test_cases_have_an_odd_one():
    assert any(t is None for _, t in cases())
