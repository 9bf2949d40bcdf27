"""Substring dedup by distributed prefix doubling.

Spark sorts the positions of the corpus by the rank of their prefix; pairs of ranks at growing offsets are sorted and
reranked, and a position leaves as soon as its prefix is unique or repeated past the threshold of 200 bytes. A row for
every byte would exceed the disk that a job may use, so positions are thinned out before, also by sorted names; a row
stands for neighbours as long as their fate is the same:

1. 64 bytes. Each 200-byte window is stood for by its anchor, the leftmost of its 64-byte strings with the smallest
   name; equal windows have equal anchors, and a run of windows with one anchor is one row (one per 68 bytes or so).
   Runs whose anchor is unique leave: none of their windows is repeated.
2. The whole run, up to 336 bytes. Runs that are repeated as a whole leave: all of their windows are repeated. Runs
   that one text has several times are one row from the start, so a text of one repeated character has few rows.
3. Blocks of 8 windows at fixed distances from the anchor. A block leaves when the 193 bytes that its windows share
   are unique, or when all its bytes together are repeated.
4. Prefix doubling of the single windows that are left: the positions at 0, 50, 100 and 150 bytes of a window are
   ranked by 50 bytes, then pairs of ranks give the rank by 100 and by 200 bytes. A window leaves with the first
   position whose rank is unique; those that stay to the end are repeated.

From 2 to 4 a repeated run or block still takes part once, as the text that others may match. Names of a round are 128
bits. Each round is an aggregation with a map-side part, so rows of one very common passage are combined before the
shuffle, and equi-joins which the adaptive skew join splits.

A text is known by 128 bits of its hash, not by its doc_id, so rows that repeat a text share one list of spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fingerprint, map_texts, materialize, text_of, with_listed, without_listed
from .shingles import mix

LENGTH, GRAM, BLOCK, START = 200, 64, 8, 50
WINDOW = LENGTH - GRAM + 1
#: Windows that are named at once; a longer text goes in pieces that overlap by the length of a window.
PIECE = 1 << 20
#: How often a row of the table of runs stands for its run: once, more often, or not at all (a span of runs that are repeated within the text).
ONCE, OFTEN, SPAN = 1, 2, 0

_rng = np.random.default_rng(8)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def names(data: np.ndarray) -> dict[int, np.ndarray]:
    """Names of the strings of 1, 2, 4 ... 128 bytes at each position."""
    out, n = {1: _BYTES[data]}, 1
    for k in range(7):
        name = out[n][:-n] * _ODD[k] + out[n][n:]
        out[2 * n] = mix(name) if k % 2 else name
        n *= 2
    return out


def windows(by: dict[int, np.ndarray]) -> np.ndarray:
    """Names of the 200-byte strings."""
    m = len(by[1]) - LENGTH + 1
    return mix(mix(by[128][:m] * _ODD[7] + by[64][128 : 128 + m]) * _ODD[8] + by[8][192 : 192 + m])


def anchors(by: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(names of the 64-byte strings, position of the anchor of each window). The order is by the upper half of a name and then by position, so one minimum gives both."""
    grams = mix(by[GRAM])
    value, size = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), 1
    for step in (1, 2, 4, 8, 16, 32, 64, WINDOW - 128):
        value = np.minimum(value[:-step], value[step:])
        size += step
    assert size == WINDOW
    return grams, (value & ~_HIGH).astype(np.int64)


def runs(text: bytes) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, gram, key, times) of each run: its windows start at first to last. A run ends at a border of pieces; equal runs of a piece are one row, and one row more for each span that they cover."""
    if len(text) <= PIECE:
        return _runs(text)
    out = []
    for low in range(0, len(text) - LENGTH + 1, PIECE):
        made = _runs(text[low : low + PIECE + LENGTH - 1])
        out.append([x + low for x in made[:3]] + list(made[3:]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _runs(text: bytes) -> tuple[np.ndarray, ...]:
    by = names(np.frombuffer(text, np.uint8))
    whole, (grams, at) = windows(by), anchors(by)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(at) - 1]))
    anchor = at[first]
    key = mix(mix(whole[first] * _ODD[9] + whole[last]) * _ODD[10] + ((anchor - last) * 256 + anchor - first).astype(np.uint64))
    gram, times = grams[anchor], np.full(len(anchor), ONCE)
    _, one, kind, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if len(one) < len(key):
        again = count[kind] > 1
        spans = np.array(merged(list(zip(first[again].tolist(), (last[again] + LENGTH).tolist(), strict=True))), np.int64)
        none = np.zeros(len(spans), np.int64)
        anchor, gram, key = np.concatenate((anchor[one], none)), np.concatenate((gram[one], none.view(np.uint64))), np.concatenate((key[one], none.view(np.uint64)))
        first, last = np.concatenate((first[one], spans[:, 0])), np.concatenate((last[one], spans[:, 1] - LENGTH))
        times = np.concatenate((np.where(count > 1, OFTEN, ONCE), np.full(len(spans), SPAN)))
    return anchor, first, last, gram.view(np.int64), key.view(np.int64), times


def _by_piece(function, text: bytes, rows: list[tuple[int, ...]], n_places: int) -> tuple[np.ndarray, ...]:
    """``function`` on the stretches of ``text`` that the windows of ``rows`` (the last two: first, last) cover, a piece at a time. The first ``n_places`` numbers of its result are places."""
    if len(text) <= PIECE:
        return function(text, rows)
    table, out = np.array(rows, np.int64), []
    order = np.argsort(table[:, -2], kind="stable")
    piece = table[order, -2] // PIECE
    for part in np.split(order, np.flatnonzero(piece[1:] != piece[:-1]) + 1):
        low, high = int(table[part, -2].min()), int(table[part, -1].max()) + LENGTH
        made = function(text[low : high + BLOCK], (table[part] - low).tolist())
        out.append([x + low for x in made[:n_places]] + list(made[n_places:]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def blocks(text: bytes, rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """Of runs (anchor, first, last): (first, last, core, whole) of each block; blocks are cut at multiples of 8 before the anchor."""
    return _by_piece(_blocks, text, rows, 2)


def _blocks(text: bytes, rows: list[list[int]]) -> tuple[np.ndarray, ...]:
    by = names(np.frombuffer(text, np.uint8))
    name = windows(by)
    anchor, first, last = np.array(rows, np.int64).T
    far, near = (anchor - first) // BLOCK, (anchor - last) // BLOCK
    count = far - near + 1
    one = np.repeat(np.arange(len(anchor)), count)
    block = near[one] + np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)
    anchor = anchor[one]
    start = anchor - block * BLOCK
    x, y = np.maximum(start - BLOCK + 1, first[one]), np.minimum(start, last[one])
    core = mix(mix(by[128][start] * _ODD[11] + by[64][start + 128]) * _ODD[12] + by[1][start + 192])
    whole = mix(mix(name[x] * _ODD[13] + name[y]) * _ODD[14] + ((anchor - y) * 256 + anchor - x).astype(np.uint64))
    return x, y, core.view(np.int64), whole.view(np.int64)


def parts(text: bytes, rows: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Of blocks (first, last): (at, part, a, b) for each window that starts in them and each of its parts of START bytes; a and b name the part's bytes."""
    return _by_piece(_parts, text, rows, 1)


def _parts(text: bytes, rows: list[list[int]]) -> tuple[np.ndarray, ...]:
    by = names(np.frombuffer(text, np.uint8))
    at = np.concatenate([np.arange(x, y + 1) for x, y in rows])
    n = LENGTH // START
    place = (at[:, None] + START * np.arange(n)).ravel()
    a, b = mix(by[32][place] * _ODD[15]), mix(by[32][place + START - 32] * _ODD[14])
    return np.repeat(at, n), np.tile(np.arange(n), len(at)), a.view(np.int64), b.view(np.int64)


def _read(docs: DataFrame) -> DataFrame:
    hi, lo = fingerprint(F.col("text"))
    return docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", hi.alias("hi"), lo.alias("lo"))


def _per_text(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """The distinct ``columns`` of each text in one list, as long as the text at most."""
    keys = by.split()
    return rows.select(*keys, *columns).distinct().groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("items"))


def _repeated(rows: DataFrame, *names: str) -> DataFrame:
    """The names that more rows than one have, with their rank: the place in the sort of all of them."""
    shared = rows.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return materialize(shared.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("rank", F.monotonically_increasing_id()))


def doubled(positions: DataFrame) -> DataFrame:
    """``positions`` (tid, at, part, a, b) to (tid, at) of the windows whose parts together are repeated.

    A round ranks the parts by their names (a, b), drops unique ones and joins neighbouring parts: the names of a part
    twice as long are the ranks of its halves. Windows that lose a part leave.
    """
    n = LENGTH // START
    while True:
        ranks = _repeated(positions, "a", "b")
        ranked = positions.join(ranks, ["a", "b"])
        if n == 1:
            return ranked.select("tid", "at")
        half = F.floor(F.col("part") / 2).cast("int")
        left = F.col("part") % 2 == 0
        pairs = ranked.groupBy("tid", "at", half.alias("part")).agg(F.max(F.when(left, F.col("rank"))).alias("a"), F.max(F.when(~left, F.col("rank"))).alias("b"))
        longer = materialize(pairs.filter("a is not null and b is not null"))
        discard(ranks, positions)
        positions, n = longer, n // 2


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(hi, lo, start, stop): spans of bytes of texts which 200-byte strings that also start elsewhere cover; they overlap."""

    def flat(rows: dict, keys: tuple[str, ...], names: tuple[str, ...], made: list) -> dict:
        sizes = [len(m[0]) if m else 0 for m in made]
        out = {c: np.repeat(np.array(rows[c], np.int64), sizes) for c in keys}
        for i, c in enumerate(names):
            out[c] = np.concatenate([m[i] for m in made if m] or [np.empty(0, np.int64)])
        return out

    def find_runs(rows: dict) -> dict:
        texts = [t.encode() for t in rows["text"]]
        return flat(rows, ("hi", "lo"), ("anchor", "first", "last", "gram", "key", "times"), [runs(t) if len(t) >= LENGTH else None for t in texts])

    def find_blocks(rows: dict) -> dict:
        made = [blocks(t.encode(), [(r["anchor"], r["first"], r["last"]) for r in items]) for t, items in zip(rows["text"], rows["items"], strict=True)]
        return flat(rows, ("tid",), ("first", "last", "core", "whole"), made)

    def find_parts(rows: dict) -> dict:
        made = [parts(t.encode(), [(r["first"], r["last"]) for r in items]) for t, items in zip(rows["text"], rows["items"], strict=True)]
        return flat(rows, ("tid",), ("at", "part", "a", "b"), made)

    span = [F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop")]
    table = materialize(map_texts(_read(docs), find_runs, "hi bigint, lo bigint, anchor int, first int, last int, gram bigint, key bigint, times tinyint", ("hi", "lo", "text")))
    found = [materialize(table.filter(f"times = {SPAN}").select("hi", "lo", *span))]
    all_runs = table.filter(f"times <> {SPAN}")
    shared = all_runs.groupBy("gram").agg(F.sum("times").alias("n")).filter("n > 1").select("gram")
    candidates = materialize(all_runs.join(shared, "gram"))
    discard(table)
    kinds = materialize(candidates.groupBy("gram", "key").agg(F.sum("times").alias("n"), F.min(F.struct("hi", "lo", "anchor", "first", "last")).alias("rep")))
    found.append(materialize(candidates.join(kinds.filter("n > 1").select("gram", "key"), ["gram", "key"]).select("hi", "lo", *span)))
    discard(candidates)

    unsure = kinds.join(kinds.filter("n = 1").select("gram").distinct(), "gram").select("rep.*")
    lists = materialize(_per_text(unsure, "hi lo", "anchor", "first", "last").withColumn("tid", F.monotonically_increasing_id()))
    discard(kinds)
    ids = lists.select("tid", "hi", "lo")
    table = materialize(map_texts(with_listed(_read(docs), lists, ["hi", "lo"], "hi", "lo"), find_blocks, "tid bigint, first int, last int, core bigint, whole bigint", ("tid", "text", "items")))
    kinds = materialize(table.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("tid", "first", "last")).alias("rep")))
    found.append(materialize(table.join(kinds.filter("n > 1").select("core", "whole"), ["core", "whole"]).join(ids, "tid").select("hi", "lo", *span)))
    discard(table)

    cores = kinds.groupBy("core").agg(F.sum("n").alias("total"), F.min("n").alias("least")).filter("total > 1 and least = 1")
    unsure = _per_text(kinds.join(cores.select("core"), "core").select("rep.*"), "tid", "first", "last")
    unsure = materialize(unsure.join(ids, "tid"))
    discard(kinds)
    # Rows that repeat a text count its windows more than once, and all of these are repeated.
    positions = materialize(map_texts(with_listed(_read(docs), unsure, ["hi", "lo"], "hi", "lo"), find_parts, "tid bigint, at int, part tinyint, a bigint, b bigint", ("tid", "text", "items")))
    last = doubled(positions).join(ids, "tid")
    found.append(materialize(last.select("hi", "lo", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("stop"))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    spans = materialize(_per_text(out, "hi lo", "start", "stop"))
    discard(*found, lists, unsure)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Texts are their UTF-8 bytes. Each byte covered by a 200-byte string that also starts anywhere else, in the same
    row or another, is removed; ``kept`` has the remaining bytes. Strings are judged on the input. A null text counts
    as empty; texts below 200 bytes lose nothing. Repeated rows are copies of each other, and a null or repeated doc_id
    is passed on; texts decide alone. Other columns are not read. An empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs)

    def cut(rows: dict) -> dict:
        out = {"doc_id": rows["doc_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, items in zip(rows["text"], rows["items"], strict=True):
            data, at, pieces = text.encode(), 0, []
            gone = merged([(r["start"], r["stop"]) for r in items])
            for start, stop in gone:
                pieces.append(data[at:start])
                at = stop
            kept = b"".join([*pieces, data[at:]])
            for c, x in (("n_bytes", len(data)), ("n_removed", len(data) - len(kept)), ("n_spans", len(gone)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                out[c].append(x)
        return out

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    changed = map_texts(with_listed(_read(docs), spans, ["hi", "lo"], "hi", "lo"), cut, schema, ("doc_id", "text", "items"))
    # Lengths and digests are made below the join, so that a caller who drops ``kept`` shuffles no text here.
    whole = _read(docs).select("doc_id", "hi", "lo", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"), "text")
    zero = F.lit(0).cast("long")
    rest = without_listed(whole, spans.select("hi", "lo"), ["hi", "lo"]).select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.encode("text", "UTF-8").alias("kept"))
    return changed.unionByName(rest)
