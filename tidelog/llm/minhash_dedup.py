"""MinHash near-dedup with min-max hashing.

Under each permutation both the smallest and the largest value of a set are kept, so 448 signature values cost 224
hash evaluations. 64 bands of 7 values (32 of minima, 32 of maxima) find a pair at a similarity of 0.8 except with
odds of 3e-7. Links are confirmed on the full shingle sets.

Texts of equal sets are one class from the start. Pairs in a bucket are never all listed: first a class is held only
against the most central class of its buckets, one candidate a class, and what gets linked is one component from then
on. These rounds go on until the pairs that are left are few or the rounds stop paying. Then only pairs of different
components that still share a bucket are left to compare; large buckets are cut into blocks of classes that meet in
pairs, so no task holds a bucket, and only the pairs which a bound on the intersection (1024 bits a set) leaves
possible are listed and confirmed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fingerprint, map_texts, materialize, text_of, with_listed, without_listed
from .components import components
from .shingles import mix, shingle_sets

BANDS, ROWS = 64, 7
WORDS_OF_BITS = 16
#: Hub rounds at most; they stop when no more pairs are left than so many a row of a bucket, or when a round leaves more than this share of them.
HUB_ROUNDS, FEW_PAIRS, PAYS = 8, 4, 0.8
#: Classes of a block of a large bucket.
BLOCK = 512


def min_max_bands(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(number of sets, bands) band keys of sets that aren't empty; the first half of the bands is made of minima, the second of maxima of the same permutations."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(20)
    half = bands // 2
    factors = rng.integers(0, 2**31, half * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, half * rows, dtype=np.uint32)
    keys = np.zeros((len(sets), bands), np.uint64)
    for k in range(half * rows):
        permuted = values * factors[k] + shifts[k]
        for band, reduce in ((k // rows, np.minimum), (half + k // rows, np.maximum)):
            keys[:, band] = mix(keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + reduce.reduceat(permuted, starts) + np.uint64(band + 1))
    return keys


def _read(docs: DataFrame) -> DataFrame:
    hi, lo = fingerprint(F.col("text"))
    return docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", hi.alias("text_hash"), lo.alias("text_lo"))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, text_hash and text_lo (128 bits that name the text), n, hi and lo (128 bits that name the set), bands (empty for an empty set)."""

    def run(rows: dict) -> dict:
        sets = shingle_sets(rows["text"], words)
        full = [s for s in sets if len(s)]
        bands = iter(min_max_bands(full).view(np.int64)) if full else iter(())
        sums = [(int(mix(s).sum()), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum())) for s in sets]
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        return {
            "doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "text_lo": rows["text_lo"], "n": [len(s) for s in sets], "hi": [signed(a) for a, _ in sums], "lo": [signed(b) for _, b in sums],
            "bands": [next(bands) if len(s) else [] for s in sets],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_texts(_read(docs), run, f"doc_id {kind}, text_hash bigint, text_lo bigint, n bigint, hi bigint, lo bigint, bands array<bigint>", ("doc_id", "text", "text_hash", "text_lo"))
    return materialize(out.withColumn("rid", F.monotonically_increasing_id()))


def _shared_buckets(bands: DataFrame) -> DataFrame:
    """Of ``bands`` (cid, key), the rows whose key two classes have or more, with the number of them."""
    sizes = materialize(bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    return materialize(bands.join(sizes, "key"))


def _full_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(cid, shingles, bits) of ``members`` (cid, text_hash, text_lo), one row a class, from the whole texts; bits has a bit for each of 1024 classes of hashes that the set touches."""
    on = ["text_hash", "text_lo"]
    texts = with_listed(_read(docs).drop("doc_id"), members.select(*on, "cid"), on, *on, once=True).select("cid", "text")

    def bits(s: np.ndarray) -> np.ndarray:
        touched = np.zeros(64 * WORDS_OF_BITS, bool)
        touched[s % np.uint64(len(touched))] = True
        return np.packbits(touched).view(np.int64)

    def run(rows: dict) -> dict:
        sets = shingle_sets(rows["text"], words)
        return {"cid": rows["cid"], "shingles": [s.view(np.int64) for s in sets], "bits": [bits(s) for s in sets]}

    return materialize(map_texts(texts, run, "cid bigint, shingles array<bigint>, bits array<bigint>", ("cid", "text")))


def _possible(percent: int) -> str:
    """Whether rows a and b (n, bits) can be similar enough: a class that only one set touches costs it a shingle at least, so the intersection has a bound."""
    only = lambda x, y: " + ".join(f"bit_count({x}.bits[{i}] & ~{y}.bits[{i}])" for i in range(WORDS_OF_BITS))
    return f"{100 + percent} * least(a.n - ({only('a', 'b')}), b.n - ({only('b', 'a')})) >= {percent} * (a.n + b.n)"


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b, more), those whose sets' intersection is ``percent`` of their union or more."""
    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return materialize(pairs.join(one, "a").join(two, "b").filter(100 * both >= percent * union).select(*pairs.columns))


def _apart(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (key, cid, n, degree, component), those that aren't in the component of their bucket's hub, the class that shares the most buckets; with the hub."""
    hubs = rows.groupBy("key").agg(F.max(F.struct("degree", "cid", "component", "n")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(materialize(hubs.filter("low < high").select("key", "hub")), "key").filter(F.col("component") != F.col("hub.component"))


def _relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the components that ``links`` (ca, cb: components) make."""
    joined = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return materialize(rows.join(joined, "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined"))


def _mixed(rows: DataFrame) -> tuple[DataFrame, int]:
    """(key, size) of the buckets with classes of several components, and the number of pairs in them."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = materialize(sizes.filter("low < high").select("key", "size"))
    return mixed, mixed.agg(F.sum(F.expr("size * (size - 1) div 2"))).first()[0] or 0


def _possible_pairs(rest: DataFrame, near_size: str, percent: int) -> DataFrame:
    """(a, b, ca, cb) of classes in one bucket of ``rest`` (key, size, cid, n, component, bits), of different components and possibly similar enough.

    The classes of a bucket are dealt to blocks of about BLOCK. Each pair of blocks meets under its own key, so a row is
    repeated once for each block of its bucket and no key has more than two blocks.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rest.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    across = F.expr(f"a.key = b.key and a.p = b.p and a.q = b.q and (a.p < a.q or a.cid < b.cid) and a.component <> b.component and {near_size} and {_possible(percent)}")
    pairs = rows.filter("block = p").alias("a").join(rows.filter("block = q").alias("b"), across)
    return pairs.select(F.least("a.cid", "b.cid").alias("a"), F.greatest("a.cid", "b.cid").alias("b"), F.col("a.component").alias("ca"), F.col("b.component").alias("cb")).dropDuplicates(["a", "b"])


def near_links(docs: DataFrame, classes: DataFrame, bands: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that join all that is connected: every pair of classes that shares a bucket is confirmed, refused, or already in one component."""
    buckets = _shared_buckets(bands)
    degree = buckets.groupBy("cid").agg(F.sum(F.col("size") - 1).alias("degree"))
    members = materialize(degree.join(classes, "cid"))
    sets = _full_sets(docs, members, words)
    rows = materialize(buckets.join(members.select("cid", "n", "degree"), "cid").select("key", "cid", "n", "degree", F.col("cid").alias("component")))
    n_rows = rows.count()
    discard(buckets)
    near_size = lambda a, b: f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"
    found, left, (mixed, before) = [], rows, _mixed(rows)
    for _ in range(HUB_ROUNDS):
        if before <= FEW_PAIRS * n_rows:
            break
        left = materialize(_apart(left))
        best = left.filter(near_size("n", "hub.n")).groupBy("cid").agg(F.max(F.struct("hub", "component")).alias("best"))
        pairs = best.select(F.col("cid").alias("a"), F.col("best.hub.cid").alias("b"), F.col("best.component").alias("ca"), F.col("best.hub.component").alias("cb"))
        links = _confirmed(pairs, sets, percent)
        found.append(links)
        rows, left = _relabelled(rows, links), _relabelled(left.drop("hub"), links)
        mixed, now = _mixed(rows)
        if now > PAYS * before:
            break
        before = now
    rest = materialize(rows.join(mixed, "key").join(sets.select("cid", "bits"), "cid").select("key", "size", "cid", "n", "component", "bits"))
    found.append(_confirmed(_possible_pairs(rest, near_size("a.n", "b.n"), percent), sets, percent))
    discard(members, sets, rest)
    return reduce(DataFrame.unionByName, [x.select("a", "b") for x in found])


def minhash_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, n_shingles, component_id, kept, first, text_hash.

    A document's set has the distinct runs of ``words`` words (A-Z in lower case); with fewer words, one run of all.
    Two documents are linked when 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id that
    links reach. A null text or one without words has an empty set, is linked with nothing and is kept. A null doc_id
    ranks last. ``kept`` says whether doc_id is component_id, so rows that repeat a doc_id are kept or not together;
    ``first`` marks exactly one row of a component, and in a component without any doc_id kept is first. Other columns
    are not read. An empty table gives an empty table.
    """
    rows = sketches(docs, words)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    full = rows.filter("n > 0")
    classes = materialize(full.groupBy("hi", "lo").agg(F.min("rid").alias("cid"), F.min(order).alias("first")))
    chosen = materialize(full.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi"))
    bands = chosen.select(F.col("rid").alias("cid"), F.explode("bands").alias("key"))
    links = near_links(docs, chosen.select(F.col("rid").alias("cid"), "text_hash", "text_lo", "n"), bands, words, percent)
    joined = components(links).withColumnRenamed("node", "cid")
    labelled = materialize(classes.join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    firsts = labelled.groupBy("component").agg(F.min("first").alias("first"))
    owners = materialize(labelled.drop("first").join(firsts, "component").select("hi", "lo", "first"))
    linked = full.join(owners, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.col("rid") == F.col("first.rid")).alias("kept"), (F.col("rid") == F.col("first.rid")).alias("first"), "text_hash")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("first"), "text_hash")
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``minhash_dedup`` marks as first, with all their columns. Rows that repeat doc_id and text stay or go together."""
    judged = minhash_dedup(docs, words, percent)
    gone = materialize(judged.groupBy("doc_id", "text_hash").agg(F.max("first").alias("stays")).filter("not stays").select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("r_id"), F.xxhash64(text_of()).alias("r_hash"))
    return without_listed(rows, gone, (F.col("r_hash") == F.col("g_hash")) & F.col("r_id").eqNullSafe(F.col("g_id"))).select("doc.*")
