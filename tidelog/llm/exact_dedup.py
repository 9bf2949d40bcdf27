"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed size. The distinct blocks are sorted and numbered, so equal blocks, and only
those, share an integer. Adjacent names are then paired, the distinct pairs sorted and numbered in turn, until each
document has one name. Unlike a hash, the name can't collide.

Only texts that share length and a 64-bit fingerprint with another one are named: any other text is already known to
be alone. Every step is a sort, an aggregation with a map-side part or an equi-join, so one large group of copies is
combined before the shuffle or split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, normalised, text_of


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Each distinct row gets an integer by its place in the sort by (hash, keys): partition in the high bits, row in the low ones. Ranges are cut by the hash alone, so no block of text is sampled to the driver."""
    order = distinct.withColumn("order", F.xxhash64(*keys)).repartitionByRange("order").sortWithinPartitions("order", *keys)
    return materialize(order.drop("order").withColumn("name", F.monotonically_increasing_id()))


def name_texts(texts: DataFrame, block_chars: int = 4096) -> DataFrame:
    """``texts`` (rid, norm) to (rid, level, name): two rows agree in (level, name) if and only if their texts are equal."""
    pieces = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    blocks = texts.select("rid", F.posexplode(F.when(F.length("norm") == 0, F.array(F.lit(""))).otherwise(pieces)).alias("pos", "block"))
    names = _numbered(blocks.select("block").distinct(), "block")
    current = materialize(blocks.join(names, "block").select("rid", "pos", "name"))
    done, level = [], 0
    longest = current.agg(F.max("pos")).first()[0]
    while longest:
        last = current.groupBy("rid").agg(F.max("pos").alias("last"), F.max("name").alias("name"))
        done.append(last.filter("last = 0").select("rid", F.lit(level).alias("level"), "name"))
        half = F.floor(F.col("pos") / 2).cast("int")
        odd = F.col("pos") % 2 == 1
        pairs = current.groupBy("rid", half.alias("pos")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"), F.max("pos").alias("old"))
        pairs = pairs.filter("old > 0")  # a row of one block is done
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        current = materialize(pairs.join(names, ["a", "b"]).select("rid", "pos", "name"))
        longest //= 2
        level += 1
    out = current.select("rid", F.lit(level).alias("level"), "name")
    for x in done:
        out = out.unionByName(x)
    return out


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """The columns with the normalised text, its length and its fingerprint."""
    return docs.select(*columns, normalised(text_of()).alias("norm")).withColumn("n", F.length("norm")).withColumn("fp", F.xxhash64("norm"))


def _shared(digest: DataFrame) -> DataFrame:
    return materialize(digest.groupBy("n", "fp").count().filter("count > 1").select("n", "fp"))


def _grouped(texts: DataFrame, block_chars: int) -> tuple[DataFrame, DataFrame]:
    """``texts`` (rid, doc_id, norm, more): (the rows with their names, the first row and the size of each group of equal texts)."""
    named = materialize(texts.drop("norm").join(name_texts(texts.select("rid", "norm"), block_chars), "rid"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    return named, materialize(named.groupBy("level", "name").agg(first, F.count("*").alias("group_size")))


def exact_dedup(docs: DataFrame, block_chars: int = 4096) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one space; a null text counts
    as empty. Of equal texts the row with the smallest doc_id stays. A null doc_id ranks last, so it stays only in a
    group without any id (then keep_id is null). Repeated rows count as copies: exactly one row of a group is kept,
    even when doc_ids repeat. Other columns of ``docs`` are not read. An empty table gives an empty table.
    """
    digest = materialize(_keyed(docs, "doc_id").select("doc_id", "n", "fp", F.sha2("norm", 256).alias("text_sha256")))
    shared = _shared(digest)
    alone = digest.join(shared, ["n", "fp"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    texts = materialize(_keyed(docs, "doc_id").join(shared, ["n", "fp"], "left_semi").select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("rid")))
    named, groups = _grouped(texts, block_chars)
    copies = named.join(groups, ["level", "name"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")
    return alone.unionByName(copies)


def keep_first(docs: DataFrame, block_chars: int = 4096) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    shared = _shared(_keyed(docs))
    keyed = _keyed(docs.select(F.struct("*").alias("doc"), "text"), "doc")
    alone = keyed.join(shared, ["n", "fp"], "left_anti").select("doc.*")
    texts = materialize(keyed.join(shared, ["n", "fp"], "left_semi").select("doc", F.col("doc.doc_id").alias("doc_id"), "norm", F.monotonically_increasing_id().alias("rid")))
    _, groups = _grouped(texts.select("rid", "doc_id", "norm"), block_chars)
    firsts = texts.join(groups.select(F.col("first.rid").alias("rid")), "rid", "left_semi").select("doc.*")
    return alone.unionByName(firsts)
