"""Filters and projections over documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions import text as T


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def min_length(df: DataFrame, text: str = "text", at_least: int = 30) -> DataFrame:
    """Keep texts of at least ``at_least`` code points, measured as they are. Null never passes."""
    return df.where(T.text_length(F.col(text)) >= at_least)


def strip_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, T.strip(F.col(text)))


def remove_html(df: DataFrame, html: str = "html") -> DataFrame:
    return df.withColumn(html, T.remove_tags(F.col(html)))


def remove_link(df: DataFrame, html: str = "html") -> DataFrame:
    return df.withColumn(html, T.remove_links(F.col(html)))


def quality_filter(df: DataFrame, quality: str = "pwa", at_least: float = 0.9) -> DataFrame:
    """Keep rows of a quality of at least ``at_least``; null and NaN are dropped."""
    return df.where(T.quality_at_least(F.col(quality), at_least))


def flatten_struct(df: DataFrame, column: str) -> DataFrame:
    """Replace a struct column by its fields."""
    rest = [name for name in df.columns if name != column]
    return df.select(*rest, f"{column}.*")


def flatten_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str = "value") -> DataFrame:
    """One row per value of ``columns``."""
    values = F.array(*[F.col(name).cast("string") for name in columns])
    return df.select(*keys, F.explode(values).alias(out))


def distinct_text(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per text with its smallest key and number of copies.

    Copies merge before the shuffle, so a text that fills a third of the table costs one row per task.
    """
    return df.groupBy(text).agg(F.min(key).alias(key), F.count("*").alias("n_copies"))


def head(df: DataFrame, key: str, n: int = 1000) -> DataFrame:
    """The first ``n`` rows by ``key``."""
    return df.orderBy(key).limit(n)
