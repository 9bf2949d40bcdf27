"""SimHash near-dedup with BK-trees.

Fingerprints at most ``radius`` bits apart agree on all but ``radius`` of ``radius`` + k blocks of bits, so for each
choice of k blocks those that agree on them are one shard, and every pair to find shares a shard. k follows the number
of distinct fingerprints, so that a shard of evenly spread ones stays small; the result doesn't depend on it. A shard
is a BK-tree: a node hangs under its parent by their Hamming distance d, and a query at distance x from the parent
follows only the edges from x - radius to x + radius. All trees and queries of a slice of shards are built and walked
level by level in numpy.

The trees of all shards hold all fingerprints, which must not pass through the driver. So a tree isn't a broadcast
variable: a shard is cut into blocks of about BLOCK fingerprints, and the tree of a block is sent to each block of
queries of its shard. A task returns the links of a spanning forest of what it found, not all pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, discard, join_split, map_texts, materialize
from .components import components
from .shingles import pieces

#: Mean fingerprints of a shard, at most; fingerprints of a block of a large shard.
PER_SHARD, BLOCK = 64, 4096


def fingerprint_of(text: str, words: int) -> int:
    """A bit is 1 if it is set in over half of the hashes of the runs of ``words`` words, A-Z in lower case; a shorter text is one run, one without words is 0. As a signed integer."""
    counts, n, tail = np.zeros(64, np.int64), 0, []

    def add(runs, size: int) -> None:
        nonlocal n
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.dtype("<u8"), size)
        counts.__iadd__(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64))
        n += size

    for piece in pieces(text.encode().lower()):
        row = tail + piece.split()
        if len(row) >= words:
            add(zip(*(row[i:] for i in range(words)), strict=False), len(row) - words + 1)
        tail = row[max(len(row) - words + 1, 0) :]
    if n == 0 and tail:
        add([tail], 1)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def bk_forest(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree for each group: (roots by group, edges, children). An edge is parent * 65 + distance, sorted, and leads to the child at its place."""
    slots, pending = groups.astype(np.int64), np.arange(len(values))
    roots, edges, children = None, [], []
    while len(pending):
        found, first, of = np.unique(slots, return_index=True, return_inverse=True)
        nodes = pending[first]
        if roots is None:
            roots = np.full(int(groups.max()) + 1, -1)
            roots[found] = nodes
        else:
            edges.append(found)
            children.append(nodes)
        left = np.ones(len(pending), bool)
        left[first] = False
        parents, pending = nodes[of[left]], pending[left]
        slots = parents * 65 + np.bitwise_count(values[parents] ^ values[pending])
    if not edges:
        return roots, np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges, children = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edges)
    return roots, edges[order], children[order]


def bk_search(values: np.ndarray, forest: tuple, queries: np.ndarray, query_groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, node) of all nodes within ``radius`` of the queries, in the trees of their groups."""
    roots, edges, children = forest
    asked, nodes = np.arange(len(queries)), roots[query_groups]
    asked, nodes = asked[nodes >= 0], nodes[nodes >= 0]
    hits = []
    while len(asked):
        d = np.bitwise_count(queries[asked] ^ values[nodes]).astype(np.int64)
        near = d <= radius
        hits.append((asked[near], nodes[near]))
        low = np.searchsorted(edges, nodes * 65 + np.maximum(d - radius, 0))
        n = np.searchsorted(edges, nodes * 65 + np.minimum(d + radius, 64), "right") - low
        nodes = children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        asked = np.repeat(asked, n)
    return (np.concatenate([a for a, _ in hits]), np.concatenate([b for _, b in hits])) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` things the smallest one that the links (a, b) reach."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        np.minimum.at(labels, before, labels.copy())
        labels = labels[labels]
        if np.array_equal(before, labels):
            return labels


def _links(radius: int):
    """A task over rows (shard, p, q, block, value) sorted by shard, p and q: links (a, b) of a spanning forest of each run."""

    def solve(keys: np.ndarray, block: np.ndarray, values: np.ndarray):
        import pyarrow as pa

        starts = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]
        groups = np.cumsum(starts) - 1
        sizes = np.bincount(groups)
        several = (sizes > 1)[groups]
        groups, block, values, p, q = np.unique(groups[several], return_inverse=True)[1], block[several], values[several], keys[1][several], keys[2][several]
        if len(values):
            tree, asks = np.flatnonzero(block == p), np.flatnonzero(block == q)
            forest = bk_forest(values[tree], groups[tree]) if len(tree) else (np.full(int(groups.max()) + 1, -1), np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(forest[0]) <= groups.max():
                forest = (np.r_[forest[0], np.full(int(groups.max()) + 1 - len(forest[0]), -1)], *forest[1:])
            a, b = [], []
            for i in range(0, len(asks), BLOCK):
                part = asks[i : i + BLOCK]
                one, other = bk_search(values[tree], forest, values[part], groups[part], radius)
                a.append(part[one])
                b.append(tree[other])
            labels = forest_labels(len(values), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(values))
            linked = labels != np.arange(len(values))
            yield pa.RecordBatch.from_arrays([pa.array(values[linked].view(np.int64)), pa.array(values[labels[linked]].view(np.int64))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "p", "q", "block", "value")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]) < 16 * BLOCK:
                continue
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1]))
            if len(change):
                cut = change[-1] + 1
                yield from solve(np.stack([x[:cut] for x in held[:3]]), held[3][:cut], held[4][:cut].view(np.uint64))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from solve(np.stack(held[:3]), held[3], held[4].view(np.uint64))

    return run


def shard_masks(n: int, radius: int) -> list[int]:
    """Masks, one for each choice of blocks on which fingerprints must agree; as few blocks as keep the mean shard of ``n`` evenly spread fingerprints under PER_SHARD."""
    k = 1
    while n > PER_SHARD * 2 ** (64 * k / (radius + k)) and radius + k < 16:
        k += 1
    edges = [64 * i // (radius + k) for i in range(radius + k + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, k)]


def fingerprint_links(values: DataFrame, n: int, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among the ``n`` distinct fingerprints of ``values`` (value) that join all of those within ``radius`` bits of each other."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    masks = shard_masks(n, radius)
    shards = F.array(*[F.xxhash64(F.lit(i), F.col("value").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])
    rows = values.select("value", F.explode(F.array_distinct(shards)).alias("shard"))
    large = materialize(rows.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1"))
    known = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    rows = rows.join(known, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shard", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "value")
    dealt = rows.repartition("shard", "p", "q").sortWithinPartitions("shard", "p", "q")
    links = materialize(dealt.mapInArrow(_links(radius), "a bigint, b bigint"))
    discard(large)
    return links


def simhash_dedup(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, fingerprint (16 hex digits), component_id.

    Two documents are linked when their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    doc_id that links reach. A null text, or one without words, has fingerprint zero and is linked like any other. A
    null doc_id ranks last: component_id is null only where no document of the component has an id. Rows that repeat a
    doc_id are rows of their own. Other columns are not read. An empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    one = lambda rows: {"doc_id": rows["doc_id"], "value": [fingerprint_of(t, words) for t in rows["text"]]}
    rows = materialize(map_texts(docs, one, f"doc_id {kind}, value bigint"))
    classes = materialize(rows.groupBy("value").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")))
    links = fingerprint_links(classes.select("value"), classes.count(), radius)
    joined = components(links).withColumnRenamed("node", "value")
    labelled = materialize(classes.join(joined, "value", "left").withColumn("component", F.coalesce("component", "value")))
    owners = materialize(labelled.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size")))
    named = materialize(join_split(labelled.drop("first"), owners, "component").select("value", "component_id", "size"))
    discard(links, classes, labelled, owners)
    return join_split(rows, named, "value").select("doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")
