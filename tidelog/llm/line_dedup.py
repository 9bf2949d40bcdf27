"""Line dedup: range-partitioned line hashes in, per-document bitmaps out.

Lines travel as 128-bit hashes with document and position, never as text. They are dealt out by range of
(hash, document) and sorted by (hash, document, position), so that a very common line spans several partitions. Each
partition streams along its sorted rows: the first row of a line in a document is numbered 1, and only these first
occurrences are counted, with one partial count a hash and partition in the shuffle. The verdicts come back as sparse
bitmaps, 64 lines a word, words without a dropped line left out; only documents with a dropped line meet their bitmap.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fingerprint, materialize, text_of, with_listed, without_listed

#: What is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _read(docs: DataFrame) -> DataFrame:
    text = docs.select("doc_id", text_of().alias("text"))
    return text.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def first_occurrences(marks: DataFrame) -> DataFrame:
    """Of ``marks`` (hi, lo, doc_id, pos), the first row of each line in each document. The window needs no other shuffle and no other sort than those of the ranges."""
    dealt = marks.repartitionByRange("hi", "lo", "doc_id").sortWithinPartitions("hi", "lo", "doc_id", "pos")
    along = Window.partitionBy("hi", "lo", "doc_id").orderBy("pos")
    return dealt.withColumn("nth", F.row_number().over(along)).filter("nth = 1").drop("nth")


def dropped_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, words): words maps the number of a block of 64 lines to the bits of its dropped lines; documents that keep every line have no row."""
    lines = _read(docs).select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    hi, lo = fingerprint(F.col("key"))
    marks = materialize(keyed.select("doc_id", "text_hash", "pos", hi.alias("hi"), lo.alias("lo")))
    counts = first_occurrences(marks.select("hi", "lo", "doc_id", "pos")).groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    common = materialize(counts.filter(F.col("n_docs") >= min_docs))
    dropped = marks.join(common, ["hi", "lo"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    word = F.floor(F.col("pos") / 64).cast("int").alias("word")
    words = dropped.groupBy("doc_id", "text_hash", word).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    bitmaps = materialize(words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")))
    discard(marks, common)
    return bitmaps


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, n_lines, n_dropped, kept_sha256, kept_text, dropped_words.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least ``min_chars``
    code points that are found in at least ``min_docs`` documents lose all their lines but those of the largest doc_id
    that holds them. A null text is one empty line. Rows that share a doc_id count as one document and are judged
    alike; rows without doc_id count as one document together, which never is the largest. Other columns are not read.
    An empty table gives an empty table. ``dropped_words`` is null for documents that keep every line.
    """
    bitmaps = dropped_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"), "words")
    same = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash"))
    touched = with_listed(_read(docs), bitmaps, same, "b_id", "b_hash").withColumn("lines", F.split("text", "\n", -1))
    kept = F.expr("flatten(transform(sequence(0, (size(lines) - 1) div 64), w -> filter(slice(lines, int(w * 64 + 1), 64), (x, i) -> (shiftright(coalesce(element_at(words, int(w)), 0L), i) & 1L) = 0L)))")
    dropped = F.expr("aggregate(map_values(words), 0L, (n, x) -> n + bit_count(x))")
    touched = touched.select("doc_id", F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"), "words")
    touched = touched.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text", F.col("words").alias("dropped_words"))
    # Counts and digests are made below the join, so that a caller who drops the text shuffles none.
    whole = _read(docs).select("doc_id", "text_hash", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.sha2("text", 256).alias("kept_sha256"), "text")
    rest = without_listed(whole, bitmaps.select("b_id", "b_hash"), same)
    rest = rest.select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "kept_sha256", F.col("text").alias("kept_text"), F.lit(None).cast(bitmaps.schema["words"].dataType).alias("dropped_words"))
    return touched.unionByName(rest)
