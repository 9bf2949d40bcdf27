"""One large JSON document read by many tasks: the elements of its top-level arrays.

The file is split anywhere behind a ``}``, or behind one that ends a line. Whether a place lies in a string and how deep it is nested follows from what
is before it, so a first pass finds for each range, once as if it began in a string and once as if not, how it ends and
how much deeper; one row a range goes to the driver, which adds them up. With its beginning known, each range cuts its
elements at the brackets that are no part of strings. Elements that lie across ranges are put together from their parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored

#: Rows of the second pass: an element, its beginning, its end, a part without either, and the last array that a range begins.
ELEMENT, HEAD, TAIL, MIDDLE, LAST_ARRAY = range(5)
_QUOTE, _BACKSLASH = b'"\\'
#: Of each byte: 2 for a quote, 1 and -1 for brackets that open and close, else 0.
_KINDS = np.zeros(256, np.int8)
_KINDS[[_QUOTE, *b"{[", *b"}]"]] = 2, 1, 1, -1, -1
_MARKED = (_KINDS != 0).astype(np.uint8).tobytes()
#: A file is looked at in samples of so many bytes, one every so many; where each has that many elements ending with their line, it is read in such lines, as these are fewer.
_SAMPLE, _EVERY, _LINES = 1 << 16, 1 << 26, 16


def _separator(spark: SparkSession, path: str) -> str:
    """What the file is split behind. By the samples no line can be much longer than ``_EVERY``; any file may be split behind each ``}``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    length = system.getFileStatus(place).getLen()
    data = system.open(place)
    try:
        for at in range(0, length, _EVERY):
            data.seek(at)
            if jvm.org.apache.commons.io.IOUtils.toByteArray(data, min(_SAMPLE, length - at)).count(b"}\n") < min(_LINES, (length - at) // (_SAMPLE // _LINES)):
                return "}"
    finally:
        data.close()
    return "}\n"


def _pieces(batches, separator: bytes):
    """(range, bytes) of each batch and range, in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        starts, texts = batch.column("start").to_numpy(), batch.column("value").cast(pa.binary())
        borders = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(starts)] if len(starts) else []
        for i, j in zip(borders, borders[1:], strict=False):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), texts.slice(i, j - i)), separator)
            yield int(starts[i]), joined[0].as_py() + separator


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, kinds, quotes): the quotes that aren't escaped and the brackets, and how many of those quotes there are up to each."""
    data = np.frombuffer(text, np.uint8)
    places = np.flatnonzero(np.frombuffer(text.translate(_MARKED), np.bool_))
    kinds = _KINDS[data[places]]
    if _BACKSLASH in text:
        at = places[kinds == 2]
        at = at[(at > 0) & (data[at - 1] == _BACKSLASH)]
        other = np.maximum.accumulate(np.where(data == _BACKSLASH, -1, np.arange(len(data))))  # the last byte that is no backslash
        escaped = at[(at - 1 - other[at - 1]) % 2 == 1]
        left = ~np.isin(places, escaped, assume_unique=True)
        places, kinds = places[left], kinds[left]
    return places, kinds, np.cumsum(kinds == 2)


def _ends(separator: bytes):
    """For each range (start, inside, out, deeper): begun outside a string (inside 0) or in one (1), whether it ends in one, and the change of depth."""

    def run(batches):
        import pyarrow as pa

        found: dict[int, list[list[int]]] = {}
        for start, text in _pieces(batches, separator):
            states = found.setdefault(start, [[0, 0], [1, 0]])
            _, kinds, quotes = _marks(text)
            outside = [int(kinds[(kinds != 2) & (quotes % 2 == i)].sum()) for i in (0, 1)]
            for state in states:
                state[1] += outside[state[0]]
                state[0] = (state[0] + (int(quotes[-1]) if len(quotes) else 0)) % 2
        rows = [(start, i, *state) for start, states in found.items() for i, state in enumerate(states)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["start", "inside", "out", "deeper"])

    return run


class _Range:
    """The state of a scan: whether in a string, the depth, the array that it is in, and the parts of the element that is open."""

    def __init__(self, inside: int, depth: int):
        self.inside, self.depth, self.array = inside, depth, None
        self.parts: list[bytes] = []
        self.begun = depth < 3

    def read(self, text: bytes):
        """(kind, array, value) of what ends in the text."""
        places, kinds, quotes = _marks(text)
        string_ends = places[kinds == 2]
        outside = (kinds != 2) & ((quotes + self.inside) % 2 == 0)
        at, step, before = places[outside], kinds[outside], quotes[outside]
        depth = self.depth + np.cumsum(step, dtype=np.int64)
        wanted = ((depth == 2) | ((depth == 3) & (step > 0))).nonzero()[0]
        begin = 0
        for place, deeper, now, n in zip(at[wanted].tolist(), step[wanted].tolist(), depth[wanted].tolist(), before[wanted].tolist(), strict=True):
            if now == 3:
                begin = place
            elif deeper > 0:
                # Its name is the string before it.
                self.array = text[string_ends[n - 2] + 1 : string_ends[n - 1]].decode() if n > 1 else ""
                yield LAST_ARRAY, self.array, None
            else:
                self.parts.append(text[begin : place + 1])
                yield ELEMENT if self.begun else TAIL, self.array, self.parts[0] if len(self.parts) == 1 else b"".join(self.parts)
                self.parts, self.begun = [], True
        self.inside = (self.inside + len(string_ends)) % 2
        self.depth = int(depth[-1]) if len(depth) else self.depth
        if self.depth >= 3:
            self.parts.append(text[begin:])


def _cut(known: dict[int, tuple[int, int]], separator: bytes):
    def run(batches):
        import pyarrow as pa

        now, state = None, None

        def rows():
            nonlocal now, state
            last = None
            for start, text in _pieces(batches, separator):
                if start != now:
                    yield from closed(last)
                    if start not in known:
                        raise ValueError("the ranges of the file have changed since they were looked at; read it again")
                    now, state, last = start, _Range(*known[start]), None
                for kind, array, value in state.read(text):
                    if kind == LAST_ARRAY:
                        last = array
                    else:
                        yield now, kind, array, value
            yield from closed(last)

        def closed(last):
            if now is not None:
                if state.parts:
                    yield now, HEAD if state.begun else MIDDLE, state.array, b"".join(state.parts)
                if last is not None:
                    yield now, LAST_ARRAY, last, None

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += len(row[3] or b"")
            if size > 1 << 22 or len(held) >= 10_000:
                yield made(pa, held)
                held, size = [], 0
        if held:
            yield made(pa, held)

    def made(pa, held):
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=["start", "kind", "array", "value"])

    return run


def document_elements(spark: SparkSession, path: str) -> DataFrame:
    """(array, value): the text of each object (or array) in the arrays at the top of the JSON object in the file, with the array's name. Numbers, strings and the like in them are left out; names of arrays must not have a ``}``."""
    separator = _separator(spark, path)
    text = spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_block_start").alias("start"), "value")
    ends = {(r["start"], r["inside"]): (r["out"], r["deeper"]) for r in text.mapInArrow(_ends(separator.encode()), "start bigint, inside bigint, out bigint, deeper bigint").collect()}
    known, inside, depth = {}, 0, 0
    for start in sorted({s for s, _ in ends}):
        known[start] = (inside, depth)
        inside, deeper = ends[start, inside]
        depth += deeper
    cut = stored(text.mapInArrow(_cut(known, separator.encode()), "start bigint, kind int, array string, value string"))
    # Of each range a few rows say which array goes on in the ranges behind it, and of which element its parts are.
    borders = {}
    for r in cut.filter(F.col("kind") != ELEMENT).select("start", "kind", "array").collect():
        borders.setdefault(r["start"], {})[r["kind"]] = r["array"]
    going_on, arrays, owners, open_at = None, [], [], None
    for start in sorted(known):
        arrays.append((start, going_on))
        here = borders.get(start, {})
        for kind in (TAIL, MIDDLE):
            if kind in here:
                owners.append((start, kind, open_at))
        if HEAD in here:
            open_at = start
            owners.append((start, HEAD, start))
        going_on = here.get(LAST_ARRAY, going_on)
    named = cut.join(F.broadcast(spark.createDataFrame(arrays, "start bigint, going_on string")), "start").withColumn("array", F.coalesce("array", "going_on"))
    parts = named.join(F.broadcast(spark.createDataFrame(owners, "start bigint, kind int, owner bigint")), ["start", "kind"])
    joined = parts.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "value", "array"))).alias("p"))
    joined = joined.select(F.col("p")[0]["array"].alias("array"), F.array_join("p.value", "").alias("value"))
    return named.filter(F.col("kind") == ELEMENT).select("array", "value").unionByName(joined)
