"""Phrase collocation mining by direct-address tiling.

Texts become slices of numbers. Words are ranked by frequency, so frequent ones have low numbers; the table of pairs of
neighbours (number, next number) is cut into tiles. Tiles of the lowest numbers are counted with ``bincount`` in dense
arrays that a task fills over all of its slices; the others hold few of their cells and are counted as sorted
coordinate lists, dealt by tile. Frequent pairs are ranked anew and become the numbers of the next round: a pair of
overlapping phrases of k words is a phrase of k + 1. A phrase that is frequent enough has only such parts.

Frequent words and frequent pairs are sent to the tasks as long as they are at most MOST_WORDS and MOST_SENT. Beyond
that a slice's own list of words or pairs is joined to the table of frequent ones, and the numbers come back to the
slice; pairs that a bitmap of fixed size rules out aren't listed then.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_split, materialize
from .shingles import pieces

#: The longest phrase, in words.
LONGEST = 5
#: Bytes of text of a slice; numbers on a side of a tile; numbers below this one are counted in dense tiles.
SLICE, TILE, DENSE = 8 << 20, 512, 1024
#: Frequent pairs that are sent to every task, at most (32 MB); frequent words, at most, and their bytes.
MOST_SENT, MOST_WORDS, MOST_BYTES = 2_000_000, 1_000_000, 32 << 20
#: Bits of the bitmap of frequent pairs (4 MB).
BITS = 1 << 25
#: A sparse coordinate list is added up when it has so many entries, and sent on when half as many are left.
MOST_ENTRIES = 500_000
#: Places of a slice that a task looks at in one go, so that its arrays don't follow the slice; words of a slice's list in one batch.
PLACES, LISTED = 1 << 18, 1 << 14

_BORDER = b"\n"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _BORDER * 9 + b" ")


def squeezed(numbers: np.ndarray) -> bytes:
    """An array as compressed bytes behind its size, so that rows of long arrays stay small on their way through Spark."""
    import pyarrow as pa

    data = numbers.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unsqueezed(data: bytes, kind: type = np.int64) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little")), kind)


def sealed(listed) -> bytes:
    """A struct array of Arrow as compressed bytes: one value for Spark, which would else unpack the list of a slice's words as one row."""
    import pyarrow as pa

    batch, sink = pa.RecordBatch.from_struct_array(listed), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1), use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unsealed(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data, options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()


class _Slice:
    """Texts as numbers of words in the order of their first occurrence, 0 at the borders of pieces."""

    def __init__(self) -> None:
        self.next_id, self.parts, self.n_bytes = count(1), [], 0
        self.numbers: dict[str, defaultdict] = {}

    def add(self, lang: str, words: list[bytes], n_bytes: int) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = defaultdict(self.next_id.__next__, {_BORDER: 0})
        self.parts.append(np.fromiter(map(self.numbers[lang].__getitem__, words), np.int32, len(words)))
        self.n_bytes += n_bytes

    def row(self, lookahead: int):
        """One Arrow row; the last ``lookahead`` words belong to the next slice too, where they are counted."""
        import pyarrow as pa

        tokens = np.concatenate(self.parts)
        own = len(tokens) - lookahead
        ids = np.fromiter((i for d in self.numbers.values() for i in d.values() if i), np.int32)
        n = np.bincount(tokens[:own], minlength=int(ids.max(initial=0)) + 1)[ids]
        langs = [lang for lang, d in self.numbers.items() for _ in range(len(d) - 1)]
        words = [w for d in self.numbers.values() for w in d if w != _BORDER]
        listed = pa.StructArray.from_arrays([pa.array(ids), pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(n.astype(np.int64))], names=["id", "lang", "word", "n"])
        return pa.RecordBatch.from_arrays([pa.array([squeezed(tokens)], pa.binary()), pa.array([own], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), listed)], names=["tokens", "own", "words"])


def _sliced(slice_bytes: int, look: int):
    def run(batches):
        now = _Slice()
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang, recent = lang.as_py(), []
                for piece in pieces(text.as_py().encode().translate(_FOLD), min(1 << 20, slice_bytes)):
                    words = [w for w in piece.replace(_BORDER, b" \n ").split(b" ") if w]
                    if now.n_bytes >= slice_bytes and len(recent) == look and sum(map(len, now.parts)) > look:
                        yield now.row(look)
                        now = _Slice()
                        now.add(lang, recent, 0)
                    now.add(lang, words, len(piece))
                    recent = (recent + words)[-look:]
                now.add(lang, [_BORDER], 1)
                if now.n_bytes >= slice_bytes:
                    yield now.row(0)
                    now = _Slice()
        if now.parts:
            yield now.row(0)

    return run


def _sealed_slices(slice_bytes: int, look: int):
    def run(batches):
        import pyarrow as pa

        for row in _sliced(slice_bytes, look)(batches):
            yield row.set_column(2, "words", pa.array([sealed(row.column("words")[0].values)], pa.binary()))

    return run


def slices(docs: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """(sid, tokens, own, words): slices of the texts, and their own lists of words, ``sealed``. Those that a long text goes on in share LONGEST - 1 words with the next one; phrases count where they begin, before ``own``."""
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(read.mapInArrow(_sealed_slices(slice_bytes, LONGEST - 1), "tokens binary, own bigint, words binary").withColumn("sid", F.monotonically_increasing_id()))


def listed_words(texts: DataFrame, schema: str) -> DataFrame:
    """The words of each slice's own list, a row for each: of sid, id, lang, word (bytes) and n the columns in ``schema``."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for sid, data in _rows(batches, "sid", "words"):
            whole = unsealed(data)
            for start in range(0, whole.num_rows, LISTED):
                part = whole.slice(start, LISTED)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, sid)) if c == "sid" else part.column(c) for c in names], names=names)

    return texts.select("sid", "words").mapInArrow(run, schema)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``id``, their place from 0 in this order: sorted in ranges, whose sizes (one number a range) are added up."""
    import pyarrow as pa

    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    sizes = sorted(placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*")).collect())
    starts = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    # From Arrow, as rows of Python would start a second set of workers in each executor.
    first = rows.sparkSession.createDataFrame(pa.table({"part": pa.array([p for p, _ in sizes], pa.int64()), "start": pa.array(starts[: len(sizes)], pa.int64())}))
    joined = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(first), "part")
    out = materialize(joined.withColumn("id", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "start", "place"))
    discard(placed)
    return out


def _grouped(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts pairs, and where in it a new pair begins."""
    narrow = not len(left) or max(left.max(), right.max()) < 1 << 31
    order = np.argsort((left << 32) | right) if narrow else np.lexsort((right, left))
    a, b = left[order], right[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])


def _summed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs as a sorted coordinate list, equal ones added."""
    order, starts = _grouped(left, right)
    return left[order][starts], right[order][starts], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def _added(entries: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _summed(*map(np.concatenate, zip(*entries, strict=True)))


def _neighbours(ids: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, left, right) of the pairs of numbers that begin from ``start`` on and before ``stop``."""
    ids = ids[start : stop + 1]
    places = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return places + start, ids[places], ids[places + 1]


def _rows(batches, *columns):
    for batch in batches:
        for i in range(batch.num_rows):
            yield [batch.column(c)[i].as_py() for c in columns]


def _arrays(*columns) -> list[np.ndarray]:
    return [unsqueezed(c) for c in columns]


def _tiled(dense: int, parts: int, salts: int):
    """A task over slices: its counts, a row for each dense tile (from 0) and for each part of the sparse tiles (behind them)."""
    across = -(-dense // TILE)

    def sparse(left, right, n):
        part = ((left // TILE * 0x9E3779B1 + right // TILE * 0x85EBCA77) >> 8) % parts
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]][: len(order)])
        for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
            chosen = order[i:j]
            yield across * across + int(part[chosen[0]]), 0, left[chosen], right[chosen], n[chosen]

    def found(batches):
        from pyspark import TaskContext

        table, entries, held = np.zeros(dense * dense, np.int64), [], 0
        for tokens, own in _rows(batches, "ids", "own"):
            ids = unsqueezed(tokens)
            for start in range(0, own, PLACES):
                _, left, right = _neighbours(ids, start, min(start + PLACES, own))
                low = (left < dense) & (right < dense)
                table += np.bincount(left[low] * dense + right[low], minlength=dense * dense)
                left, right, n = _summed(left[~low], right[~low], np.ones(len(left) - low.sum(), np.int64))
                if len(left):
                    entries.append((left, right, n))
                    held += len(left)
                if held >= MOST_ENTRIES:
                    entries = [_added(entries)]
                    held = len(entries[0][0])
                    if held >= MOST_ENTRIES // 2:
                        yield from sparse(*entries.pop())
                        held = 0
        if entries:
            yield from sparse(*_added(entries))
        table, salt = table.reshape(dense, dense), TaskContext.get().partitionId() % salts
        for t in range(across * across):
            top, side = t // across * TILE, t % across * TILE
            cells = table[top : top + TILE, side : side + TILE]
            left, right = np.nonzero(cells)
            if len(left):
                yield t, salt, left + top, right + side, cells[left, right]

    return lambda batches: _packed(found(batches))


def _packed(rows):
    import pyarrow as pa

    for tile, salt, *columns in rows:
        yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([salt], pa.int32()), *[pa.array([squeezed(c)], pa.binary()) for c in columns]], names=["tile", "salt", "left", "right", "n"])


def _merged(n_dense: int, across: int, least: int, last: bool):
    """A task over rows sorted by (tile, salt): each run added up, a dense tile in an array of its cells. Sums that aren't partial are kept from ``least`` on; ``last`` gives a row for each pair."""

    def total(tile: int, held: list):
        left, right, n = map(np.concatenate, zip(*held, strict=True))
        if tile >= n_dense:
            return _summed(left, right, n)
        corner = tile // across * TILE, tile % across * TILE
        table = np.zeros(TILE * TILE, np.int64)
        np.add.at(table, (left - corner[0]) * TILE + right - corner[1], n)
        cells = np.flatnonzero(table)
        return cells // TILE + corner[0], cells % TILE + corner[1], table[cells]

    def closed(tile: int, salt: int, held: list):
        left, right, n = total(tile, held)
        kept = n >= (least if last or tile >= n_dense else 1)
        return tile, salt, left[kept], right[kept], n[kept]

    def runs(batches):
        now, held, size = None, [], 0
        for tile, salt, *columns in _rows(batches, "tile", "salt", "left", "right", "n"):
            if now is not None and now != (tile, salt):
                yield closed(*now, held)
                held, size = [], 0
            now = (tile, salt)
            held.append(_arrays(*columns))
            size += len(held[-1][0])
            if size > 2 * MOST_ENTRIES:
                held = [total(tile, held)]
                size = len(held[0][0])
        if now is not None:
            yield closed(*now, held)

    return lambda batches: _flat(x[2:] for x in runs(batches)) if last else _packed(runs(batches))


def _flat(rows):
    import pyarrow as pa

    for columns in rows:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["left", "right", "f"])


def frequent_pairs(stream: DataFrame, n_ids: int, least: int) -> DataFrame:
    """(id, left, right, f) of the pairs of neighbours in ``stream`` (ids, own) that occur ``least`` times or more; the most frequent has id 0."""
    dense = min(DENSE, n_ids)
    across = -(-dense // TILE)
    parts = 4 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = 1 + isqrt(stream.rdd.getNumPartitions())
    schema = "tile int, salt int, left binary, right binary, n binary"
    tiles = stream.select("ids", "own").mapInArrow(_tiled(dense, parts, salts), schema)
    summed = tiles.repartition("tile", "salt").sortWithinPartitions("tile", "salt").mapInArrow(_merged(across * across, across, least, False), schema)
    summed = materialize(summed)
    # A stage has one Python operator, so a task has one worker.
    flat = "left bigint, right bigint, f bigint"
    low = summed.filter(F.col("tile") < across * across).withColumn("salt", F.lit(0)).repartition("tile").sortWithinPartitions("tile").mapInArrow(_merged(across * across, across, least, True), flat)
    high = summed.filter(F.col("tile") >= across * across).select("left", "right", "n").mapInArrow(lambda batches: _flat(_arrays(*x) for x in _rows(batches, "left", "right", "n")), flat)
    pairs = low.unionByName(high)
    out = ranked(pairs, F.desc("f"), "left", "right")
    discard(summed)
    return out


def _numbered(stream: DataFrame, numbers: DataFrame, column: str, own_pairs) -> DataFrame:
    """``stream`` (sid, own, a column of numbers) with what ``numbers`` (sid, place, id) says of each place of the slice's own list; others are -1."""
    import pyarrow as pa

    lists = numbers.groupBy("sid").agg(F.collect_list(F.struct("place", "id")).alias("known")).select("sid", F.col("known.place").alias("places"), F.col("known.id").alias("news"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sid, own, data, places, news = (batch.column(c)[i] for c in ("sid", "own", column, "places", "news"))
                place, new = (x.values.to_numpy().astype(np.int64) if x.is_valid else np.zeros(0, np.int64) for x in (places, news))
                ids = own_pairs(data.as_py(), own.as_py(), place, new)
                yield pa.RecordBatch.from_arrays([pa.array([sid.as_py()], pa.int64()), pa.array([own.as_py()], pa.int64()), pa.array([squeezed(ids)], pa.binary())], names=["sid", "own", "ids"])

    return materialize(stream.select("sid", "own", column).join(lists, "sid", "left").mapInArrow(run, "sid bigint, own bigint, ids binary"))


def _of_words(data: bytes, own: int, place: np.ndarray, new: np.ndarray) -> np.ndarray:
    tokens = unsqueezed(data, np.int32)
    table = np.full(int(max(tokens.max(initial=0), place.max(initial=0))) + 1, -1, np.int64)
    table[place] = new
    return table[tokens]


def _with_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``texts`` (sid, tokens, own, words) to (sid, own, ids) by the frequent ``words`` (lang, word, id), which go to every task in the order of their ids."""
    known = words.orderBy("id").select(F.concat(F.encode("lang", "UTF-8"), F.lit(b" "), F.encode("word", "UTF-8")).alias("key")).toArrow().column("key").combine_chunks()
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for i in range(batch.num_rows):
                sid, own, data, words = (batch.column(c)[i].as_py() for c in ("sid", "own", "tokens", "words"))
                listed = unsealed(words)
                keys = pc.binary_join_element_wise(listed.column("lang").cast(pa.binary()), listed.column("word"), pa.scalar(b" ", pa.binary()))
                new = pc.fill_null(pc.index_in(keys, value_set=sent.value), -1).to_numpy().astype(np.int64)
                ids = _of_words(data, own, listed.column("id").to_numpy().astype(np.int64), new)
                yield pa.RecordBatch.from_arrays([pa.array([sid], pa.int64()), pa.array([own], pa.int64()), pa.array([squeezed(ids)], pa.binary())], names=["sid", "own", "ids"])

    return materialize(texts.select("sid", "own", "tokens", "words").mapInArrow(run, "sid bigint, own bigint, ids binary"))


def _hash_bit(left, right):
    return (left * 48271 + right) % BITS


def bitmap(pairs: DataFrame) -> np.ndarray:
    """A bit for each class of pairs that has a frequent one; BITS bits, whatever the number of pairs."""
    bit = F.expr(f"pmod(left * 48271 + right, {BITS})")
    words = pairs.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if len(out) else out


def next_round(stream: DataFrame, pairs: DataFrame) -> DataFrame:
    """``stream`` (sid, own, ids) with the numbers of ``pairs`` (id, left, right): at each place that of the pair that begins there."""
    largest = pairs.agg(F.count("*"), F.max(F.greatest("left", "right"))).first()
    return _looked_up(stream, pairs) if largest[0] <= MOST_SENT and largest[1] < 1 << 31 else _joined(stream, pairs)


def _looked_up(stream: DataFrame, pairs: DataFrame) -> DataFrame:
    known = pairs.select(F.expr("shiftleft(left, 32) | right").alias("key"), "id").toArrow()
    order = np.argsort(known.column("key").to_numpy())
    sent = stream.sparkSession.sparkContext.broadcast((known.column("key").to_numpy()[order], known.column("id").to_numpy()[order]))

    def run(batches):
        import pyarrow as pa

        keys, new = sent.value
        for sid, own, data in _rows(batches, "sid", "own", "ids"):
            ids = unsqueezed(data)
            out = np.full(len(ids), -1, np.int64)
            for start in range(0, len(ids), PLACES):
                places, left, right = _neighbours(ids, start, start + PLACES)
                key = (left << 32) | right
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                out[places[hit]] = new[at[hit]]
            yield pa.RecordBatch.from_arrays([pa.array([sid], pa.int64()), pa.array([own], pa.int64()), pa.array([squeezed(out)], pa.binary())], names=["sid", "own", "ids"])

    return materialize(stream.select("sid", "own", "ids").mapInArrow(run, "sid bigint, own bigint, ids binary"))


def _joined(stream: DataFrame, pairs: DataFrame) -> DataFrame:
    bits = np.packbits(bitmap(pairs), bitorder="little")

    def listed(data: bytes):
        """(places, order, starts, left, right) of the pairs that may be frequent."""
        ids = unsqueezed(data)
        places, left, right = _neighbours(ids, 0, len(ids))
        at = _hash_bit(left, right)
        maybe = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        places, left, right = places[maybe], left[maybe], right[maybe]
        return len(ids), places, *_grouped(left, right), left, right

    def ask(batches):
        import pyarrow as pa

        for sid, data in _rows(batches, "sid", "ids"):
            _, _, order, starts, left, right = listed(data)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), sid)), pa.array(np.arange(len(starts))), pa.array(left[order][starts]), pa.array(right[order][starts])], names=["sid", "place", "left", "right"])

    def of_pairs(data: bytes, own: int, place: np.ndarray, new: np.ndarray) -> np.ndarray:
        n, places, order, starts, _, _ = listed(data)
        table = np.full(len(starts), -1, np.int64)
        table[place] = new
        out = np.full(n, -1, np.int64)
        if len(order):
            first = np.zeros(len(order), np.int64)
            first[starts[1:]] = 1
            out[places[order]] = table[np.cumsum(first)]
        return out

    asked = stream.select("sid", "ids").mapInArrow(ask, "sid bigint, place bigint, left bigint, right bigint")
    return _numbered(stream, asked.join(pairs.select("left", "right", "id"), ["left", "right"]).select("sid", "place", "id"), "ids", of_pairs)


def _longer(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Phrases of one word more: ``pairs`` (id, left, right, f) of ``parts`` (id, lang, words, f, firsts, rests): counts of the first k words and of the rest, for each k."""
    side = lambda s: parts.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("lang", "words", "f", "firsts", "rests")])
    both = pairs.join(side("left"), "left").join(side("right").drop("right_lang", "right_firsts"), "right")
    words = F.concat("left_words", F.slice("right_words", -1, 1))
    return materialize(both.select("id", "left", "right", "f", F.col("left_lang").alias("lang"), words.alias("words"), F.concat("left_firsts", F.array("left_f")).alias("firsts"), F.concat(F.array("right_f"), "right_rests").alias("rests")))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, slice_bytes: int = SLICE) -> DataFrame:
    """The phrases of 2 to LONGEST words of ``docs`` (text, lang, more) whose parts meet most above chance: lang, rank, phrase, a, l, r, n, score.

    A-Z count in lower case. Pieces end at ``[.,;:!?\\x0A-\\x0D]`` and at the end of a text, words are what spaces and
    tabs part. ``a`` is how often the phrase occurs, at least ``least`` times, in the texts of a language (null: und),
    ``n`` the number of words of these. Of the cuts of a phrase into its first words (l occurrences) and the rest (r)
    the one with the lowest score floor(1000 * a * n / (l * r)) counts, of equal ones that after the fewest words. A
    phrase that a longer one holds and that isn't more frequent than it is left out. Each language has its ``top``
    phrases by score, then a, both descending, then phrase in byte order. A null text is empty; rows that repeat a
    document count as they stand; other columns are not read. Without frequent phrases the result is empty.
    """
    texts = slices(docs, slice_bytes)
    word = F.col("word").cast("string").alias("word")
    totals = materialize(listed_words(texts, "lang string, word binary, n bigint").select("lang", word, "n").groupBy("lang", "word").agg(F.sum("n").alias("f")))
    words = ranked(totals.filter(F.col("f") >= least), F.desc("f"), "lang", "word")
    size = words.agg(F.count("*"), F.sum(F.octet_length("lang") + F.octet_length("word") + 1)).first()
    if size[0] and size[0] <= MOST_WORDS and size[1] <= MOST_BYTES:
        stream = _with_words(texts, words)
    else:
        own = listed_words(texts, "sid bigint, id int, lang string, word binary").select("sid", F.col("id").alias("place"), "lang", word)
        stream = _numbered(texts, own.join(words.select("lang", "word", "id"), ["lang", "word"]).select("sid", "place", "id"), "tokens", _of_words)
    none = F.array().cast("array<bigint>")
    known, n_ids = words.select("id", "lang", F.array("word").alias("words"), "f", none.alias("firsts"), none.alias("rests")), words.count()
    discard(texts)
    phrases = []
    for size in range(2, LONGEST + 1):
        pairs = frequent_pairs(stream, n_ids, least) if n_ids else None
        n_ids = pairs.count() if n_ids else 0
        if not n_ids:
            break
        known = _longer(pairs, known)
        phrases.append(known)
        if size < LONGEST:
            before, stream = stream, next_round(stream, pairs)
            discard(before, pairs)
    discard(stream)
    if not phrases:
        return words.sparkSession.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    kept = None
    for shorter, longer in zip(phrases, [*phrases[1:], None], strict=True):
        rows = shorter.select("id", "lang", "words", "f", "firsts", "rests")
        if longer is not None:
            held = longer.filter(F.element_at("firsts", -1) == F.col("f")).select(F.col("left").alias("id")).unionByName(longer.filter(F.col("rests")[0] == F.col("f")).select(F.col("right").alias("id")))
            rows = rows.join(held, "id", "left_anti")
        rows = rows.drop("id")
        kept = rows if kept is None else kept.unionByName(rows)
    kept = materialize(kept)
    langs = kept.groupBy("lang").agg(F.count("*").alias("size"))
    langs = materialize(langs.join(totals.groupBy("lang").agg(F.sum("f").alias("n")), "lang"))
    return _best(join_split(kept, langs, "lang"), top)


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first of each language, first within parts of it, so that no task has more than these of each part."""
    product = lambda x, y: f"cast({x} as decimal(19,0)) * cast({y} as decimal(18,0))"
    cut = f"struct(({product('1000 * f', 'n')}) div ({product('c.firsts', 'c.rests')}) as score, k, c.firsts as l, c.rests as r)"
    scored = rows.withColumn("cut", F.array_min(F.expr(f"transform(arrays_zip(firsts, rests), (c, k) -> {cut})")))
    scored = scored.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= top)
    whole = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return whole.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
