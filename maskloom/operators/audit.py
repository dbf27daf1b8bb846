"""Checks that no test material reached the training side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def _per_split(names: tuple[str, ...]) -> list:
    return [F.count_if(F.col("split") == name).alias(f"n_{name}") for name in names]


def straddling_documents(windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with windows in more than one split, with the number of windows in each."""
    return (
        windows.groupBy(key)
        .agg(F.min("split").alias("_low"), F.max("split").alias("_high"), *_per_split(SPLITS))
        .where(F.col("_low") != F.col("_high"))
        .drop("_low", "_high")
    )


def recipe_overlap(trained: DataFrame, evaluated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that one recipe trains on and another evaluates on. Only keys are shuffled."""
    train = trained.where(F.col("split") == "train").select(key)
    test = evaluated.where(F.col("split") == "test").select(key)
    return test.join(train, key, "left_semi")


def shared_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts that occur in more than one split, with the number of copies in each.

    Copies are counted before the shuffle and never paired, so a text that fills a third of the table is one
    group of partial counts.
    """
    return (
        df.select(F.sha2(text, 256).alias("text_hash"), "split")
        .groupBy("text_hash")
        .agg(F.min("split").alias("_low"), F.max("split").alias("_high"), *_per_split(SPLITS))
        .where(F.col("_low") != F.col("_high"))
        .drop("_low", "_high")
    )
