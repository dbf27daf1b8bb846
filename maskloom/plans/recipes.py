"""The three ways the operators are put together: the older corpus build, the current one, and held-out scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions import tokens as K
from maskloom.operators import cleaning, encoding, ngrams, ordering, scoring, splitting, summary, windows
from maskloom.operators.vocabulary import Vocabulary
from maskloom.session import materialise


def clean_corpus(df: DataFrame, drop: list[str], key: str = "doc_id") -> DataFrame:
    """Drop columns, drop short texts, strip, and split 90 to 10."""
    kept = cleaning.min_length(cleaning.drop_columns(df, drop))
    return splitting.threshold_split(cleaning.strip_text(kept), key, test_size=0.1, seed=666)


def legacy_windows(
    df: DataFrame, vocabulary: Vocabulary, drop: list[str], key: str = "doc_id", cap_batch: int | None = None
) -> DataFrame:
    """The older build: clean, encode, overlapping windows padded to full length, with masks.

    ``cap_batch`` turns on the chunk cap: of each so many documents, only as many windows stay as there are documents.
    """
    corpus = clean_corpus(df, drop, key)
    encoded = encoding.encode_wordpiece(corpus.select(key, "split", "text"), vocabulary)
    if cap_batch is not None:
        encoded = materialise(encoded, "encoded")
        sizes = materialise(windows.windows_per_document(encoded.select(key, "ids")), "document-sizes")
        kept = windows.chunk_cap(ordering.dense_index(sizes, key), "idx", cap_batch).select(key, "win")
        cut = windows.token_windows(encoded).join(kept, [key, "win"], "left_semi")
        return windows.pad_static(windows.model_inputs(cut))
    return windows.pad_static(windows.model_inputs(windows.token_windows(encoded)))


def current_windows(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", unit: str = "doc") -> DataFrame:
    """The current build: good scans only, encode, overlapping windows, train, validation and test.

    ``unit="window"`` parts the windows of one document between train and validation.
    """
    good = cleaning.quality_filter(df)
    cut = windows.token_windows(encoding.encode_wordpiece(good.select(key, "text"), vocabulary))
    keys = [key] if unit == "doc" else [key, "win"]
    return windows.model_inputs(splitting.three_way_split(cut, keys, key))


def train_bigrams(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Pair counts over the train texts, as a table."""
    encoded = encoding.encode_wordpiece(df.select("text"), vocabulary)
    counted = scoring.bigram_counts(encoded.select(K.with_specials(F.col("ids")).alias("input_ids")))
    return materialise(counted, "bigrams")


def held_out_positions(texts: DataFrame, vocabulary: Vocabulary, keys: list[str]) -> DataFrame:
    """The maskable positions of the first window of each text, as a table."""
    encoded = encoding.encode_wordpiece(texts.select(*keys, "text"), vocabulary)
    return materialise(scoring.bigrams(windows.truncate_first(encoded), keys, with_size=True), "positions")


def train_trigrams(df: DataFrame, vocabulary: Vocabulary, least: int = 1) -> ngrams.TrigramModel:
    """A trigram model of the train texts."""
    encoded = encoding.encode_wordpiece(df.select("text"), vocabulary)
    counted = ngrams.trigram_counts(encoded.select(K.with_specials(F.col("ids")).alias("input_ids")))
    return ngrams.train(materialise(counted, "trigrams"), len(vocabulary), least)


def trigram_losses(
    texts: DataFrame, model: ngrams.TrigramModel, vocabulary: Vocabulary, keys: list[str]
) -> DataFrame:
    """Loss of every maskable position of the first window of each text."""
    encoded = encoding.encode_wordpiece(texts.select(*keys, "text"), vocabulary)
    positions = ngrams.trigrams(windows.truncate_first(encoded), keys, with_size=True)
    return ngrams.losses(materialise(positions, "positions"), model)


def score_held_out(
    texts: DataFrame,
    counts: DataFrame,
    vocabulary: Vocabulary,
    keys: list[str],
    models: dict[str, float],
    weighting: str = "batch",
) -> DataFrame:
    """Pseudo-perplexity of each text under each model; a model is a name and its smoothing."""
    positions = held_out_positions(texts, vocabulary, keys)
    losses = scoring.model_losses(positions, counts, len(vocabulary), models)
    return scoring.pseudo_perplexity(losses, ["model", *keys], weighting).select("model", *keys, "ppl")


def held_out_report(results: DataFrame) -> DataFrame:
    """Summary table per model and sample."""
    return summary.describe(results, ["model", "sample"], "ppl")
