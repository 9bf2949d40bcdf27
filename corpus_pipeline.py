"""Corpus pipeline: quality rules, exact dedup, near-dedup, redaction of secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``, whatever they are, unchanged but for redacted texts. A stage needs doc_id and
text; it has a defined result for nulls in any column, repeated rows and empty tables, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import materialize
from tidelog.llm.exact_dedup import keep_first
from tidelog.llm.minhash_dedup import keep_one
from tidelog.llm.packing import best_fit
from tidelog.llm.quality_rules import fit, keep_quality
from tidelog.llm.secret_scan import redact


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null or empty text has no words and goes; without labels of both kinds only the base rules judge."""
    return keep_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, a null doc_id last; of repeated rows one."""
    return keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays. Shingles have five words here, as near copies in general; the four words of the op9 query are that query's contract. Texts without words are nobody's copies and stay."""
    return keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a marker; n_chars, if there is such a column, follows the text. Null texts stay null; no row goes."""
    redacted = redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the bins that they are packed in; a text without words has one piece in no bin, a document without source conflicts with none."""
    return best_fit(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained model and greedy packing can't be put in SQL; a test holds the rows of run() on a small table against brute force, the field by the best of all paths with its fitted weights.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
