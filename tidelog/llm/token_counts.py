"""Token counts by distinct pre-token.

The tokenizer ends every pre-token at ASCII white space, so a text's count is the sum over its pieces between white
space. Spark counts the pieces of the corpus with a map-side part and each distinct one is encoded once; only its
number of tokens is kept, no ids are made for a text. The numbers are then joined to the frequencies of each document
and summed. The numbers of the most common pieces, a table of bounded size, are broadcast, so that each task sums them
where the text is; the other pieces of a document are rows that are joined by the piece and summed by the document.

A tokenizer whose tokens cross white space is found out by probes; its texts are encoded whole, as those of a
sentencepiece model are.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, discard, map_texts, materialize, text_of

#: At most so many pieces of at most so many bytes are broadcast.
MOST_COMMON, COMMON_BYTES = 200_000, 64
#: Texts whose tokens must be those of their pieces, if tokens end at white space.
PROBES = ("a b", "a  b", " a", "a ", "a\nb", "a\t\tb\n", "the end. The end", "1 1", "x , y", "don't 's", "é è", " \n ", "A B\r\nC")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _ids(path: str, texts: list[str]) -> list[list[int]]:
    if path.endswith(".model"):
        return _processor(path).encode(texts, num_threads=1)
    return [e.ids for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def ends_at_space(path: str) -> bool:
    """Whether the tokens of a text are those of its pieces between ASCII white space."""
    return all(whole == [i for piece in _ids(path, [w.decode() for w in text.encode().split()]) for i in piece] for text, whole in zip(PROBES, _ids(path, list(PROBES)), strict=True))


def piece_table(docs: DataFrame, path: str) -> DataFrame:
    """(piece, times, n_tokens) of each distinct piece of the corpus, encoded once."""
    pieces = docs.select(F.explode(F.split(text_of(), SPACES)).alias("piece")).filter("piece <> ''").groupBy("piece").agg(F.count("*").alias("times"))

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            n = pa.array(list(map(len, _ids(path, b.column("piece").to_pylist()))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("times"), n], names=["piece", "times", "n_tokens"])

    return materialize(pieces.mapInArrow(encode, "piece string, times bigint, n_tokens int"))


def _common(table: DataFrame) -> tuple[dict[bytes, int], DataFrame]:
    """The numbers of the most common pieces, and the table of the others. The least frequency of a common one follows from how many pieces have each frequency."""
    short = F.octet_length("piece") <= COMMON_BYTES
    sizes = table.filter(short).groupBy(F.least("times", F.lit(100_000)).alias("times")).count().collect()
    room, least = MOST_COMMON, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["times"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["times"]
    common = short & (F.col("times") >= least)
    return {r["piece"].encode(): r["n_tokens"] for r in table.filter(common).select("piece", "n_tokens").collect()}, table.filter(~common)


def _by_piece(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row."""
    table = piece_table(docs, path)
    known, others = _common(table)

    def count(rows: dict) -> dict:
        out = {"doc_id": rows["doc_id"], "n_bytes": [], "known": [], "pieces": [], "times": []}
        for text in rows["text"]:
            data = text.encode()
            frequencies = Counter(data.split())  # bytes.split() cuts at the six ASCII white-space characters
            rest = [w for w in frequencies if w not in known]
            out["pieces"].append([w.decode() for w in rest])
            out["times"].append([frequencies.pop(w) for w in rest])
            out["known"].append(sum(known[w] * n for w, n in frequencies.items()))
            out["n_bytes"].append(len(data))
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_texts(docs, count, f"doc_id {kind}, n_bytes bigint, known bigint, pieces array<string>, times array<int>")
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()))
    wanted = rows.select("rid", F.explode(F.arrays_zip("pieces", "times")).alias("x")).select("rid", F.col("x.pieces").alias("piece"), F.col("x.times").alias("n"))
    sums = wanted.join(others.select("piece", "n_tokens"), "piece").groupBy("rid").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("more"))
    out = materialize(rows.select("doc_id", "n_bytes", "known", "rid").join(sums, "rid", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")))
    discard(table, rows)
    return out


def _by_text(docs: DataFrame, path: str) -> DataFrame:
    def count(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in rows["text"]], "n_tokens": list(map(len, _ids(path, rows["text"])))}

    return map_texts(docs, count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Counts are those of the library for the file at ``path`` (tokenizers for .json, sentencepiece for .model) without
    added begin, end or special tokens; special strings in a text are handled as the library does by default. A null
    or empty text has no bytes and no tokens. doc_id, null or repeated, is passed on. Other columns are not read. An
    empty table gives an empty table.
    """
    by_piece = not path.endswith(".model") and ends_at_space(path)
    return (_by_piece if by_piece else _by_text)(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
