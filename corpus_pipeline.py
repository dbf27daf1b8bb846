"""A corpus from documents to packed sequences: toxicity, language, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import language, near_dups, packing, toxicity
from maskloom.llm.common import key_remainder
from maskloom.llm.library import read_vocabulary
from maskloom.llm.queries import BYTE_END, SEQUENCE, labels
from maskloom.session import materialise, spread

# how sure the language must be before a document is rejected for being labelled otherwise
SURE = 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model learns from labels that are not held out."""
    docs = spread(docs)
    learnt = labels(spark, sf_dir, "toxic").where(key_remainder("doc_id", 5) != 0)
    model = toxicity.learn(docs, learnt, "doc_id", "text", "toxic")
    row = docs.select(F.struct("*").alias("doc"), "text")
    scored = toxicity.score(row, "text", model, ["doc"])
    return scored.where("score < 0.5").select("doc.*")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that are surely in another language than they are labelled."""
    docs = spread(docs)
    profiles = language.learn_profiles(docs.where(key_remainder("doc_id", 4) != 2), "doc_id", "text", "lang")
    row = docs.select(F.struct("*").alias("doc"), "text")
    found = language.identify(row, "text", profiles, keep=["doc"])
    other = (F.col("doc.lang") != F.col("lang_pred")) & (F.col("score") >= SURE)
    rejected = (F.col("lang_pred") == language.UNKNOWN) | F.coalesce(other, F.lit(False))
    return found.where(~rejected).select("doc.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id stays."""
    return near_dups.distinct_documents(spread(docs), "doc_id", "text", size=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 1024 tokens."""
    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack_documents(spread(docs), "doc_id", "text", vocabulary, BYTE_END, SEQUENCE, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("near_dedup", one_of_near_duplicates),
    ("packing", pack_sequences),
]
# SQL can express none of the stages; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
