"""A training corpus from raw documents: reject, deduplicate, cut repeats, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, minhash, mixing, quality, scratch, substrings
from millrace.llm.names import column, fresh
from millrace.llm.queries import MULTILINGUAL

#: SQL cannot express the last stages; tests/llm holds the rows against plain Python.
ORACLE_SQL = None

#: Ids of removed documents that may be broadcast (some 60 bytes each in memory); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Similarity of word shingles from which documents are near-duplicates here; op3 has a limit of its own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go. Null and empty texts fail the rules; repeated rows and
    equal scores are judged alike; a null doc_id has no label; an empty table gives an empty one."""
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix = fresh(docs.columns, "_quality_")
    return quality.judge(docs, trusted, prefix=prefix).filter(F.col(f"{prefix}kept")).select(*map(column, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates stays, all its rows with it. Null and empty texts
    and null ids are linked with nothing and stay; an empty table gives an empty one. Only doc_id and text are read."""
    name = fresh(docs.columns, "_gone")
    gone = scratch.table(minhash.near_duplicates(docs, percent=NEAR_PERCENT).filter("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, column("doc_id").cast("long") == F.col(name), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id has go; untouched texts stay as they are, and so do texts that are
    null, empty or without an id, and rows of one id among themselves. n_chars follows the text, where there is one."""
    prefix = fresh(docs.columns, "_cut_")
    cut = substrings.remove_repeats(docs, prefix=prefix)
    touched, kept = F.col(f"{prefix}n_removed") > 0, F.col(f"{prefix}kept")
    made = {"text": F.when(touched, kept).otherwise(column("text")), "n_chars": F.when(touched, F.length(kept).cast("long")).otherwise(column("n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[made[c].alias(c) if made.get(c) is not None else column(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with all its columns. Texts without words have no size and are taken as often
    as their place in the order of hashes says; null sources are one source; equal ids are taken together; an empty table gives an empty one."""
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row: doc_id, lang, source, n_tokens and ids. Null and empty texts have none; rows repeat as they come;
    other columns go; an empty table gives an empty one."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), MULTILINGUAL, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one is stored; the last one's remains, since the result
    is read from it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, "stage")
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
