"""Vocabularies, merges and tokenizer settings on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators.vocabulary import CONTINUATION, Vocabulary
from maskloom.sources.files import read_file, save_file

# The settings stored beside a vocabulary.
CONFIG = {
    "do_lower_case": True,
    "unk_token": "[UNK]",
    "sep_token": "[SEP]",
    "pad_token": "[PAD]",
    "cls_token": "[CLS]",
    "mask_token": "[MASK]",
    "model_max_length": 512,
}
CONFIG_SCHEMA = (
    "do_lower_case boolean, unk_token string, sep_token string, pad_token string, "
    "cls_token string, mask_token string, model_max_length int"
)
ADDED_TOKENS_SCHEMA = (
    "added_tokens_decoder map<string, struct<content: string, lstrip: boolean, normalized: boolean, "
    "rstrip: boolean, single_word: boolean, special: boolean>>"
)


def save_vocabulary(vocabulary: Vocabulary, spark: SparkSession, path: str, **settings: object) -> None:
    vocabulary.token_table(spark).write.parquet(f"{path}/vocab")
    vocabulary.merge_table(spark).write.parquet(f"{path}/merges")
    config = {**CONFIG, **settings}
    names = [field.split()[0] for field in CONFIG_SCHEMA.split(", ")]
    spark.createDataFrame([tuple(config[n] for n in names)], CONFIG_SCHEMA).coalesce(1).write.json(f"{path}/config")


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    return Vocabulary.from_tables(spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges"))


def save_tokenizer_files(vocabulary: Vocabulary, path: str) -> None:
    """The files that the tokenizers library opens: ``vocab.txt``, or ``vocab.json`` and ``merges.txt`` for BPE."""
    names = sorted(vocabulary.tokens, key=vocabulary.tokens.get)
    if [vocabulary.tokens[n] for n in names] != list(range(len(names))):
        raise ValueError("ids must run from 0 without a gap")
    if any(CONTINUATION in left[:2] or CONTINUATION in right[:2] for left, right in vocabulary.merges) or not (
        vocabulary.merges
    ):
        save_file(f"{path}/vocab.txt", "".join(f"{n}\n" for n in names).encode())
        return
    save_file(f"{path}/vocab.json", json.dumps(vocabulary.tokens, ensure_ascii=False).encode())
    merges = "".join(f"{left} {right}\n" for left, right in vocabulary.merges)
    save_file(f"{path}/merges.txt", ("#version: 0.2\n" + merges).encode())


def load_wordpiece_file(path: str) -> Vocabulary:
    """A ``vocab.txt``: one token a line, its id is the line number from 0."""
    lines = read_file(path).decode().split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return Vocabulary({line.removesuffix("\r"): i for i, line in enumerate(lines)})


def load_byte_level_files(vocab: str, merges: str) -> Vocabulary:
    """A ``vocab.json`` with its ``merges.txt``."""
    tokens = json.loads(read_file(vocab))
    lines = [x for x in read_file(merges).decode().split("\n") if x and not x.startswith("#version")]
    pairs = [tuple(line.split(" ")) for line in lines]
    if len(pairs) > Vocabulary.MAX_TOKENS:
        raise ValueError(f"{len(pairs)} merges are too many to broadcast")
    return Vocabulary(dict(sorted(tokens.items(), key=lambda t: t[1])), pairs)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The settings as one row."""
    return spark.read.schema(CONFIG_SCHEMA).option("multiLine", "true").json(path)


def read_added_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per added token of a settings file that lists them by id."""
    raw = spark.read.schema(ADDED_TOKENS_SCHEMA).option("multiLine", "true").json(path)
    rows = raw.select(F.explode("added_tokens_decoder").alias("id", "_t"))
    return rows.select(F.col("id").cast("int").alias("id"), "_t.*")
