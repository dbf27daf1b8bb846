"""Passages that held-out texts share with other documents.

Words are runs of characters other than ASCII white space, A-Z in lower case. A passage is a longest run of words of a
text whose every ``gram`` consecutive words stand somewhere in a text of the other side, ``least`` words long at least.

The held-out side is the smaller one: its grams are kept once each. Documents are first searched by few of their
grams only, then the documents with a hit are compared gram by gram. The first step loses nothing: a passage holds at
least ``least - gram + 1`` consecutive grams, and of every so many the one with the smallest hash is among the few.
No pairs of texts are formed, so a passage that a third of all rows hold costs each row its own grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.session import broadcast_if_small, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A row of the tables that may be broadcast is a hash and a digest, 100 bytes: 50 MB at this many.
_FEW = 500_000


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _slices(words: str, gram: int, of) -> Column:
    """``of`` each run of ``gram`` words, in order; none where the text has fewer."""
    starts = F.sequence(F.lit(1), F.size(words) - (gram - 1))
    return F.when(F.size(words) >= gram, F.transform(starts, lambda i: of(F.slice(words, i, gram)))).otherwise(F.array())


def _digest(words: Column) -> Column:
    return F.sha2(F.concat_ws(" ", words), 256)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), _words(text).alias("_words")).where(F.col("_key").isNotNull())


def _grams(texts: DataFrame, gram: int) -> DataFrame:
    """One row per place of a text: key, place from 0, digest of the gram that begins there."""
    return texts.select("_key", F.posexplode(_slices("_words", gram, _digest)).alias("_at", "_gram"))


def _searched(texts: DataFrame, gram: int, least: int) -> DataFrame:
    """The grams that suffice to find every passage: of each ``least - gram + 1`` in a row the one of smallest hash."""
    row = least - gram + 1
    hashed = texts.select("_key", _slices("_words", gram, F.xxhash64).alias("_hashes"))
    starts = F.sequence(F.lit(1), F.size("_hashes") - (row - 1))
    lowest = F.transform(starts, lambda i: F.array_min(F.slice("_hashes", i, row)))
    # no filter on the size: pushed below, it would split the text again for every gram
    few = F.when(F.size("_hashes") >= row, F.array_distinct(lowest)).otherwise(F.array())
    return hashed.select("_key", F.explode(few).alias("_hash"))


def _runs(places: DataFrame, gram: int, least: int, *more: Column) -> DataFrame:
    """Runs of consecutive places of a key: where they start and how many words they cover."""
    order = Window.partitionBy("_key").orderBy("_at")
    runs = places.withColumn("_run", F.col("_at") - F.row_number().over(order)).groupBy("_key", "_run")
    words = (F.count("*") + (gram - 1)).cast("long").alias("n_words")
    return runs.agg(F.min("_at").cast("long").alias("start"), words, *more).where(F.col("n_words") >= least).drop("_run")


def _check(gram: int, least: int) -> None:
    if not 1 <= gram <= least:
        raise ValueError("a passage has at least as many words as a gram, and a gram has one or more")


def shared_passages(
    docs: DataFrame,
    held_out: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    gram: int = 8,
    least: int = 13,
) -> DataFrame:
    """Passages of documents whose every gram stands in a held-out text: key, start, n_words, item.

    ``start`` counts words from 0; ``item`` is the smallest held-out item that holds the first gram. Rows without a
    key, null and empty texts, and texts of fewer than ``least`` words have none. Keys of documents are unique;
    held-out items may repeat. Other columns play no part.
    """
    _check(gram, least)
    theirs = _texts(held_out, item, text)
    runs = theirs.select("_key", F.explode(_slices("_words", gram, lambda words: words)).alias("_run"))
    known = (
        runs.select("_key", _digest("_run").alias("_gram"), F.xxhash64("_run").alias("_hash"))
        .groupBy("_gram", "_hash")
        .agg(F.min("_key").alias("_item"))
    )
    known = materialise(known, "held-out-grams")
    ours = _texts(docs, key, text)
    hashes = broadcast_if_small(known.select("_hash").distinct(), _FEW)
    found = materialise(_searched(ours, gram, least).join(hashes, "_hash", "left_semi").select("_key").distinct(), "found")
    places = _grams(ours.join(found, "_key", "left_semi"), gram).join(
        broadcast_if_small(known.select("_gram", "_item"), _FEW), "_gram"
    )
    runs = _runs(places, gram, least, F.min_by("_item", "_at").alias("item"))
    return runs.select(F.col("_key").alias(key), "start", "n_words", "item")


def leaked_items(
    docs: DataFrame,
    held_out: DataFrame,
    passages: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    gram: int = 8,
) -> DataFrame:
    """What of each held-out text stands in the passages found in ``docs``, one row per item.

    item, n_grams (places of the text), n_leaked (places whose gram lies in a passage), longest (words of the longest
    run of such places, 0 if none). ``passages`` is what ``shared_passages`` gave with the same ``gram``. Items are
    unique; those without a key are left out, those with fewer than ``gram`` words have no places.
    """
    wanted = passages.select(F.col(key).alias("_key"), F.struct("start", "n_words").alias("_passage"))
    spans = wanted.groupBy("_key").agg(F.collect_list("_passage").alias("_passages"))
    ours = _texts(docs, key, text).join(spans, "_key")
    pieces = ours.select("_key", "_words", F.explode("_passages").alias("_p")).select(
        "_key", F.slice("_words", (F.col("_p.start") + 1).cast("int"), F.col("_p.n_words").cast("int")).alias("_words")
    )
    leaked = materialise(_grams(pieces, gram).select("_gram").distinct(), "leaked-grams")
    theirs = _texts(held_out, item, text)
    places = _grams(theirs, gram).join(broadcast_if_small(leaked, _FEW), "_gram", "left_semi")
    per_item = _runs(places, gram, gram).groupBy("_key").agg(
        F.sum(F.col("n_words") - (gram - 1)).alias("n_leaked"), F.max("n_words").alias("longest")
    )
    counted = theirs.select("_key", F.greatest(F.size("_words") - (gram - 1), F.lit(0)).cast("long").alias("n_grams"))
    return counted.join(per_item, "_key", "left").select(
        F.col("_key").alias(item),
        "n_grams",
        F.coalesce("n_leaked", F.lit(0)).cast("long").alias("n_leaked"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
    )
