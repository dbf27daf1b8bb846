"""Encoded documents to model inputs: windows, padding, and the chunk cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import tokens as K
from maskloom.operators.ordering import running_total
from maskloom.session import materialise


def token_windows(
    encoded: DataFrame,
    ids: str = "ids",
    max_length: int = 512,
    overlap: int = 256,
    out: str = "input_ids",
    specials: K.Specials = K.SPECIALS,
) -> DataFrame:
    """One row per window; ``win`` counts from 0 within the document. Row by row, without a shuffle."""
    rest = [c for c in encoded.columns if c != ids]
    cut = K.windows(F.col(ids), max_length, overlap, specials)
    return encoded.select(*rest, F.posexplode(cut).alias("win", out))


def model_inputs(windows: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Add the attention mask and the special-tokens mask, by place. Do it before padding, which fills them up too."""
    return windows.withColumn("attention_mask", K.attention_mask(F.col(ids))).withColumn(
        "special_tokens_mask", K.special_tokens_mask(F.col(ids))
    )


def windows_per_document(encoded: DataFrame, ids: str = "ids", max_length: int = 512, overlap: int = 256) -> DataFrame:
    rest = [c for c in encoded.columns if c != ids]
    sizes = encoded.select(*rest, F.size(ids).alias("n_tokens"))
    return sizes.withColumn("n_windows", K.window_count(F.col("n_tokens"), max_length, overlap))


def truncate_first(
    encoded: DataFrame,
    ids: str = "ids",
    max_length: int = 512,
    out: str = "input_ids",
    specials: K.Specials = K.SPECIALS,
) -> DataFrame:
    rest = [c for c in encoded.columns if c != ids]
    return encoded.select(*rest, K.first_window(F.col(ids), max_length, specials).alias(out))


def pad_static(
    windows: DataFrame, length: int = 512, ids: str = "input_ids", specials: K.Specials = K.SPECIALS
) -> DataFrame:
    """Pad every window to ``length``: ids with the padding id, masks, where there are any, with 0 and 1."""
    fills = {ids: F.lit(specials.pad)}
    fills |= {"attention_mask": F.lit(0).cast("tinyint"), "special_tokens_mask": F.lit(1).cast("tinyint")}
    padded = {c: K.pad_to(F.col(c), F.lit(length), fill) for c, fill in fills.items() if c in windows.columns}
    return windows.withColumns(padded)


def _window_size(n: Column, win: Column, max_length: int, overlap: int) -> Column:
    """Ids in window ``win`` of a document of ``n`` content tokens, with the special tokens."""
    content, step = max_length - 2, max_length - 2 - overlap
    return (F.least(n - win * step, F.lit(content)) + 2).cast("int")


def window_sizes(
    encoded: DataFrame, key: str = "doc_id", ids: str = "ids", max_length: int = 512, overlap: int = 256
) -> DataFrame:
    """Every window with its size and its position ``window_index`` in the whole table.

    Positions follow from running totals over documents; the ids themselves are not moved.
    """
    per_document = windows_per_document(encoded.select(key, ids), ids, max_length, overlap)
    per_document = materialise(per_document, "document-sizes")
    placed = running_total(per_document, key, F.col("n_windows"), "before")
    every = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("win"))
    return every.select(
        key,
        "win",
        (F.col("before") + F.col("win")).alias("window_index"),
        _window_size(F.col("n_tokens"), F.col("win"), max_length, overlap).alias("n_ids"),
    )


def pad_dynamic(sized: DataFrame, batch_size: int = 16, multiple: int = 8) -> DataFrame:
    """Add the batch of each window and the length to pad it to: the batch maximum, rounded up."""
    batch = F.expr(f"window_index div {int(batch_size)}")
    longest = F.max("n_ids").over(Window.partitionBy("batch"))  # a batch holds batch_size rows
    padded = (F.ceil(longest / F.lit(multiple)) * multiple).cast("int")
    return sized.withColumn("batch", batch).withColumn("padded_length", padded)


def padding_waste(padded: DataFrame, max_length: int = 512) -> DataFrame:
    """Real, dynamically padded and statically padded ids over all batches."""
    return padded.agg(
        F.countDistinct("batch").alias("n_batches"),
        F.count("*").alias("n_windows"),
        F.sum("n_ids").alias("real_ids"),
        F.sum("padded_length").alias("dynamic_ids"),
        (F.count("*") * max_length).alias("static_ids"),
    )


def chunk_cap(per_document: DataFrame, index: str, batch_size: int = 1000) -> DataFrame:
    """Windows that survive when each batch of documents keeps only as many windows as it has documents.

    ``per_document`` has a dense ``index`` and ``n_windows``. Early long documents keep all their windows and
    late ones may lose all: off in every recipe, here to show the effect.
    """
    batch = F.expr(f"`{index}` div {int(batch_size)}")
    by_batch = Window.partitionBy("batch")  # a batch holds batch_size documents
    earlier = by_batch.orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    placed = per_document.withColumn("batch", batch).select(
        "*",
        F.coalesce(F.sum("n_windows").over(earlier), F.lit(0)).alias("before"),
        F.count("*").over(by_batch).alias("room"),
    )
    kept = F.least(F.col("n_windows"), F.greatest(F.col("room") - F.col("before"), F.lit(0)))
    wins = F.sequence(F.lit(0), F.col("kept").cast("int") - 1)
    return (
        placed.withColumn("kept", kept)
        .where(F.col("kept") > 0)
        .select("*", F.explode(wins).alias("win"))
        .drop("before", "room", "kept")
    )
