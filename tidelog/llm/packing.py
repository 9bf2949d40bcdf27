"""Best-fit packing under conflicts.

Pieces of documents are put into bins of a fixed number of words. Pieces of one duplicate cluster never share a bin,
and a bin takes ``per_source`` pieces of a source at most. Pieces come largest first; the bins are ordered by what
is left in them, and the search goes from the first bin that is large enough on to the next ones until a bin's bitmaps
(sources that are full, clusters that are there) allow the piece: that is the tightest compatible bin.

Documents are dealt to shards of about ``shard_rows`` by a hash of doc_id and text, so a hot source or a large group of
copies is spread over all shards and each is packed on its own, in one task's memory.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import normalised, text_of


def pack(sizes: list[int], sources: list[object], clusters: list[object], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece, in the given order of the pieces; sizes lie between 1 and ``capacity``. A null source or cluster conflicts with nothing."""
    bit: dict[tuple[str, object], int] = {}

    def mask(kind: str, value: object) -> int:
        return 0 if value is None else 1 << bit.setdefault((kind, value), len(bit))

    order: list[tuple[int, int]] = []  # (left, bin)
    blocked: list[int] = []
    taken: list[dict[int, int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = mask("source", source), mask("cluster", cluster)
        place = bisect_left(order, (size, -1))
        while place < len(order) and blocked[order[place][1]] & (s | c):
            place += 1
        if place < len(order):
            left, b = order.pop(place)
        else:
            left, b = capacity, len(blocked)
            blocked.append(0)
            taken.append({})
        if s:
            taken[b][s] = taken[b].get(s, 0) + 1
        blocked[b] |= c | (s if s and taken[b][s] >= per_source else 0)
        if left > size:
            insort(order, (left - size, b))
        out.append(b)
    return out


def best_fit(docs: DataFrame, capacity: int = 2048, per_source: int = 2, shard_rows: int = 2048) -> DataFrame:
    """``docs`` (doc_id, text, source, more) to one row per piece: doc_id, piece, start, n_words, bin_id.

    Words are runs of other characters than ASCII white space. A text of more than ``capacity`` words is cut into full
    pieces, which fill a bin each, and a rest. ``start`` is the number of the piece's first word in the text. A text
    without words (null too) has one piece of no words and a null bin_id. Texts that are equal but for white space are
    one cluster; a null source is no source, and a table without the column has none. Repeated rows are copies of each other, so they share no bin. bin_id is
    unique over all shards. The rows depend only on the table, not on its partitions. Other columns are not read.
    """
    text = text_of()
    # A digest: two clusters that shared a name would only be kept apart in vain.
    # Ids travel as text, since pandas would make floats of integers among nulls.
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), source.cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.xxhash64(normalised(text)).alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    pieces = F.when(F.col("words") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / capacity).cast("int")))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int")).withColumn("pieces", pieces)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf.explode("pieces").rename(columns={"pieces": "piece"}).reset_index(drop=True)
        rest["piece"] = rest["piece"].astype("int64")
        rest["start"] = rest["piece"] * capacity
        rest["n_words"] = (rest["words"] - rest["start"]).clip(upper=capacity)
        rest = rest.sort_values(["n_words", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], ignore_index=True)
        some = rest["n_words"] > 0
        twice = rest["cluster"].duplicated(keep=False)
        packed = rest[some]
        clusters = [c if t else None for c, t in zip(packed["cluster"], twice[some], strict=True)]
        sources = [None if pd.isna(s) else s for s in packed["source"]]
        bins = pack(packed["n_words"].tolist(), sources, clusters, capacity, per_source)
        rest["bin_id"] = pd.Series(pd.NA, rest.index, "Int64")
        rest.loc[some, "bin_id"] = pd.array([(int(key[0]) << 32) + b for b in bins], "Int64")
        return rest[["doc_id", "piece", "start", "n_words", "bin_id"]]

    packed = rows.groupBy("shard").applyInPandas(run, "doc_id string, piece int, start bigint, n_words bigint, bin_id bigint")
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
