"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import text as T
from maskloom.functions import tokens as K
from maskloom.operators import (
    audit,
    cleaning,
    encoding,
    lookup,
    masking,
    ordering,
    passages,
    scoring,
    splitting,
    summary,
    together,
    vocabulary,
    windows,
)
from maskloom.plans import recipes
from maskloom.session import materialise, scratch_path, spread
from maskloom.sources import artifacts, tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# The vocabulary of the queries: frequent words, frequent endings, and two characters without continuation.
N_WORDS, N_ENDINGS, WITHOUT = 1000, 200, ("q", "z")
# The size that the training queries ask for.
TRAINED_SIZE = 30_512
MODELS = {"bigram-0.1": 0.1, "bigram-1": 1.0}
ITEM = ["sample", "item"]


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return spread(df.select(*columns) if columns else df, "doc_id")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id")


def _held_out(spark: SparkSession, sf: str) -> DataFrame:
    """Two held-out collections, told apart by ``sample``."""
    first = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.lit("benchmark").alias("sample"), F.col("item_id").cast("string").alias("item"), "text"
    )
    second = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.lit("conversations").alias("sample"), F.concat_ws("-", "conv_id", "turn").alias("item"), "text"
    )
    return spread(first.union(second), *ITEM)


def _scan_quality() -> Column:
    """A stand-in for scan quality, with some values that are not numbers."""
    value = F.col("doc_id") * 37 % 101 / F.lit(100.0)
    return F.when(F.col("doc_id") % 53 == 0, F.lit(float("nan"))).otherwise(value)


def _with_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, "doc_id", "text").withColumn("pwa", _scan_quality())


def _train(df: DataFrame) -> DataFrame:
    return splitting.threshold_split(df, "doc_id", test_size=0.1, seed=666).where(F.col("split") == "train")


def _vocabulary(spark: SparkSession, sf: str) -> vocabulary.Vocabulary:
    counts = vocabulary.bert_word_counts(_train(_documents(spark, sf, "doc_id", "text")))
    return vocabulary.basic_vocabulary(counts, N_WORDS, N_ENDINGS, WITHOUT)


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_wordpiece(_documents(spark, sf, "doc_id", "text"), _vocabulary(spark, sf))


def _text(ids: str) -> Column:
    return F.concat_ws(" ", F.col(ids).cast("array<string>"))


def _md5_of_ids(ids: str) -> Column:
    """MD5 of ``_text``, from whole Arrow batches: a string for each number would cost more than the digest."""

    def digests(arrays: pa.Array) -> pa.Array:
        texts = pc.binary_join(arrays.cast(pa.list_(pa.string())), " ").fill_null("")
        return pa.array([md5(t.encode(), usedforsecurity=False).hexdigest() for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(digests, "string")(F.col(ids))


# Sources


@query
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    df = _documents(spark, sf)
    path = scratch_path(spark, "csv")
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, df.schema)


@query
def split_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    df = splitting.threshold_split(_documents(spark, sf, "doc_id", "text"), "doc_id", test_size=0.1, seed=666)
    path = scratch_path(spark, "splits")
    tables.write_splits(df, path)
    return tables.read_split(spark, path, "test").select("doc_id", "text")


@query
def explode_results(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.create_map("text", F.struct((F.col("n_chars") / F.lit(8.0)).alias("ppl")))
    nested = F.to_json(F.struct(F.col("source").alias("model"), entry.alias("results")))
    return tables.explode_results(_documents(spark, sf).select("doc_id", nested.alias("json")), "json")


@query
def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    tables.write_parquet(_documents(spark, sf), path)
    return tables.read_parquet(spark, path)


@query
def comma_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    path = scratch_path(spark, "csv")
    tables.write_csv(talks, path, ",")
    return tables.read_csv(spark, path, talks.schema, ",")


@query
def sample_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sample")
    tables.write_sample(_held_out(spark, sf), path)
    return tables.read_sample(spark, path)


@query
def results_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select(
        F.col("source").alias("model"), F.col("lang").alias("sample"), "text", (F.col("n_chars") / 8.0).alias("ppl")
    )
    path = scratch_path(spark, "results")
    tables.write_results(rows, path)
    return tables.read_result_rows(spark, path, "model string, sample string, text string, ppl double")


@query
def statistics_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "source", "lang", "n_chars")
    rows = docs.select(F.col("source").alias("model"), F.col("lang").alias("sample"), "n_chars")
    path = scratch_path(spark, "statistics")
    tables.write_statistics(summary.describe(rows, ["model", "sample"], "n_chars"), path)
    read = tables.read_statistics(spark, path)
    return read.select("model", "sample", "stat", F.round("value", 6).alias("value"))


@query
def vocabulary_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "vocabulary")
    artifacts.save_vocabulary(_vocabulary(spark, sf), spark, path)
    return artifacts.load_vocabulary(spark, path).token_table(spark)


@query
def vocabulary_file_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "vocabulary-file")
    artifacts.save_tokenizer_files(_vocabulary(spark, sf), path)
    return artifacts.load_wordpiece_file(f"{path}/vocab.txt").token_table(spark)


@query
def rows_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """The documents at the positions that the labelled documents' ids name."""
    docs = ordering.dense_index(_documents(spark, sf, "doc_id"), "doc_id")
    wanted = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("idx")).distinct()
    return lookup.semi_lookup(docs, wanted, ["idx"])


@query
def lookup_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the totals of its source, by the way for tables that are too large to broadcast."""
    docs = materialise(_documents(spark, sf, "doc_id", "source", "n_chars"), "facts")
    totals = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("sum_chars"))
    totals = materialise(totals, "totals")
    return lookup.lookup(docs.drop("n_chars"), totals, ["source"], share=0.1, max_broadcast=0)


# Filters and cleaning


@query
def text_length(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, "doc_id", "text").select(
        "doc_id", T.text_length(F.col("text")).cast("long").alias("text_length")
    )


@query
def filter_min_length(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.min_length(_documents(spark, sf, "doc_id", "text"))


@query
def strip_text(spark: SparkSession, sf: str) -> DataFrame:
    before = F.element_at(F.array(*map(F.lit, ["", "\u001c\n ", " \t", " 　"])), _turn(0))
    after = F.element_at(F.array(*map(F.lit, ["\u0085", "", "  \r", "\u000b\u000c "])), _turn(1))
    padded = _documents(spark, sf, "doc_id", "text").withColumn("text", F.concat(before, "text", after))
    return cleaning.strip_text(padded)


def _turn(shift: int) -> Column:
    return ((F.col("doc_id") + shift) % 4 + 1).cast("int")


@query
def remove_html(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.remove_html(_pages(spark, sf))


@query
def remove_link(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.remove_link(_pages(spark, sf))


@query
def filter_quality(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.quality_filter(_with_quality(spark, sf)).select("doc_id", "pwa")


@query
def flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props")
    parsed = events.select("event_id", F.from_json("props", "k long").alias("props"))
    return cleaning.flatten_struct(parsed, "props")


@query
def flatten_values(spark: SparkSession, sf: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    return cleaning.flatten_values(talks, ["conv_id", "turn"], ["role", "text"])


@query
def distinct_text(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.distinct_text(_documents(spark, sf, "doc_id", "text"), "doc_id")


@query
def dense_index(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.dense_index(filter_min_length(spark, sf).select("doc_id"), "doc_id")


@query
def head_n(spark: SparkSession, sf: str) -> DataFrame:
    docs = splitting.threshold_split(_documents(spark, sf, "doc_id", "text"), "doc_id", test_size=0.1, seed=666)
    return cleaning.head(docs.where(F.col("split") == "test"), "doc_id", 1000).select("doc_id", "text")


@query
def dense_index_text_key(spark: SparkSession, sf: str) -> DataFrame:
    """Positions in the order of a text key."""
    keyed = _documents(spark, sf, "doc_id", "source").select(F.concat_ws("/", "source", "doc_id").alias("key"))
    return ordering.dense_index(materialise(keyed, "keys"), "key")


@query
def head_50(spark: SparkSession, sf: str) -> DataFrame:
    docs = splitting.threshold_split(_documents(spark, sf, "doc_id", "text"), "doc_id", test_size=0.1, seed=666)
    return cleaning.head(docs.where(F.col("split") == "test"), "doc_id", 50).select("doc_id", "text")


# Shuffle, split, sample


@query
def seeded_shuffle_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.seeded_rank(_documents(spark, sf, "doc_id"), "doc_id", 666)


@query
def split_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.threshold_split(_documents(spark, sf, "doc_id"), "doc_id", test_size=0.1, seed=666)


@query
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.exact_split(_documents(spark, sf, "doc_id"), "doc_id", 0.2, 420)


@query
def split_exact_train(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.exact_train_split(_documents(spark, sf, "doc_id"), "doc_id", 0.8, 42)


@query
def split_three_way_doc(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.three_way_split(_documents(spark, sf, "doc_id"), ["doc_id"], "doc_id")


def _window_keys(spark: SparkSession, sf: str) -> DataFrame:
    per_document = windows.windows_per_document(_encoded(spark, sf))
    wins = F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("win")
    return per_document.select("doc_id", wins)


@query
def split_three_way_window(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.three_way_split(_window_keys(spark, sf), ["doc_id", "win"], "doc_id")


@query
def split_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """Test membership by equal texts: no text has copies on both sides."""
    docs = _documents(spark, sf, "doc_id", "text")
    return splitting.group_split(docs, "text", 0.2, 42).select("doc_id", "split")


@query
def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    texts = _held_out(spark, sf)
    picked = [
        splitting.sample(texts.where(F.col("sample") == name), *ITEM, n=n, seed=42)
        for name, n in [("benchmark", 30), ("conversations", 300)]
    ]
    return picked[0].union(picked[1])


@query
def leak_windows(spark: SparkSession, sf: str) -> DataFrame:
    return audit.straddling_documents(split_three_way_window(spark, sf))


@query
def leak_recipes(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "doc_id")
    shuffled = splitting.positional_split(ordering.seeded_rank(docs, "doc_id", 666, "at"), "at", 0.2, 420)
    in_order = splitting.positional_split(ordering.dense_index(docs, "doc_id", "at"), "at", 0.2, 420)
    return audit.recipe_overlap(shuffled, in_order)


@query
def leak_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "doc_id", "text")
    return audit.shared_text(splitting.threshold_split(docs, "doc_id", test_size=0.1, seed=666))


def _benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")


@query
def leak_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.shared_passages(_documents(spark, sf, "doc_id", "text"), _benchmark(spark, sf))


@query
def leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = _documents(spark, sf, "doc_id", "text"), _benchmark(spark, sf)
    return passages.leaked_items(docs, held_out, passages.shared_passages(docs, held_out))


# Words, vocabulary, encoding


def _word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.bert_word_counts(_documents(spark, sf, "doc_id", "text"))


@query
def pretokenize(spark: SparkSession, sf: str) -> DataFrame:
    split = _documents(spark, sf, "doc_id", "text").select("doc_id", T.bert_words(F.col("text")).alias("words"))
    return split.select("doc_id", F.size("words").cast("long").alias("n_words"), F.concat_ws(" ", "words").alias("words"))


@query
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _word_counts(spark, sf)


@query
def wp_alphabet(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.alphabet(_word_counts(spark, sf))


@query
def wp_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.pair_counts(_word_counts(spark, sf))


@query
def basic_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(spark, sf).token_table(spark)


@query
def wordpiece_encode(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encoding.encode_words(_word_counts(spark, sf), _vocabulary(spark, sf))
    return encoded.select("word", "cnt", _text("ids").alias("ids"))


@query
def wordpiece_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _text("ids").alias("ids"))


@query
def oov_rate(spark: SparkSession, sf: str) -> DataFrame:
    vocab = _vocabulary(spark, sf)
    encoded = encoding.encode_wordpiece(head_n(spark, sf), vocab, special_tokens=T.SPECIAL_TOKENS)
    rate = encoding.unknown_rate(encoded, vocab)
    return rate.withColumn("oov_percent", F.round("oov_percent", 6))


@query
def train_wordpiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = _train(_documents(spark, sf, "doc_id", "text"))
    return together.train_wordpiece(docs, TRAINED_SIZE).token_table(spark)


@query
def train_byte_level(spark: SparkSession, sf: str) -> DataFrame:
    docs = _train(_documents(spark, sf, "doc_id", "text"))
    return together.train_byte_level(docs, TRAINED_SIZE).merge_table(spark)


@query
def byte_level_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "doc_id", "text")
    vocab = together.train_byte_level(_train(docs), TRAINED_SIZE)
    encoded = encoding.encode_byte_level(docs, vocab)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _text("ids").alias("ids"))


@query
def vocabulary_sizes(spark: SparkSession, sf: str) -> DataFrame:
    docs = _train(_documents(spark, sf, "doc_id", "text"))
    basic = _vocabulary(spark, sf)
    trained = together.train_byte_level(docs, TRAINED_SIZE)
    return vocabulary.vocabulary_sizes({"wordpiece": basic, "byte_level": trained}, spark)


@query
def sample_5(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that the tokens of two vocabularies are compared on."""
    docs = _documents(spark, sf, "doc_id", "text")
    test = splitting.threshold_split(docs, "doc_id", test_size=0.1, seed=666).where(F.col("split") == "test")
    return splitting.sample(test, "doc_id", n=5, seed=42).select("doc_id", "text")


@query
def compare_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "doc_id", "text")
    test = splitting.threshold_split(docs, "doc_id", test_size=0.1, seed=666).where(F.col("split") == "test")
    picked = splitting.sample(test, "doc_id", n=5, seed=42)
    trained = together.train_byte_level(_train(docs), TRAINED_SIZE)
    return encoding.compare_tokens(picked, "doc_id", _vocabulary(spark, sf), trained)


# Windows and padding


@query
def windows_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return windows.windows_per_document(_encoded(spark, sf))


@query
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.token_windows(_encoded(spark, sf)).select(
        "doc_id", "win", F.size("input_ids").alias("n_ids"), _text("input_ids").alias("input_ids")
    )


@query
def special_masks(spark: SparkSession, sf: str) -> DataFrame:
    whole = _encoded(spark, sf).select("doc_id", K.with_specials(F.col("ids")).alias("input_ids"))
    masks = windows.model_inputs(whole)
    return masks.select("doc_id", *[_text(c).alias(c) for c in ("input_ids", "attention_mask", "special_tokens_mask")])


@query
def special_masks_literal(spark: SparkSession, sf: str) -> DataFrame:
    """Special tokens written out in the texts have their ids, but count as text in the masks."""
    vocab = _vocabulary(spark, sf)
    text = F.concat(F.lit("[PAD] a [SEP] "), "text", F.lit(" [MASK] b [CLS]"))
    docs = _documents(spark, sf, "doc_id", "text").withColumn("text", text)
    encoded = encoding.encode_wordpiece(docs, vocab, special_tokens=T.SPECIAL_TOKENS)
    specials = K.Specials.of(vocab.tokens)
    cut = windows.model_inputs(windows.token_windows(encoded, specials=specials))
    masks = windows.pad_static(cut, specials=specials)
    return masks.select(
        "doc_id", "win", *[_text(c).alias(c) for c in ("input_ids", "attention_mask", "special_tokens_mask")]
    )


@query
def truncate_first(spark: SparkSession, sf: str) -> DataFrame:
    return windows.truncate_first(_encoded(spark, sf)).select("doc_id", _text("input_ids").alias("input_ids"))


@query
def pad_static(spark: SparkSession, sf: str) -> DataFrame:
    padded = windows.pad_static(windows.model_inputs(windows.token_windows(_encoded(spark, sf))))
    return padded.select("doc_id", "win", *[_text(c).alias(c) for c in ("input_ids", "attention_mask")])


@query
def pad_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    return windows.pad_dynamic(windows.window_sizes(_encoded(spark, sf)), batch_size=16)


@query
def padding_waste(spark: SparkSession, sf: str) -> DataFrame:
    return windows.padding_waste(windows.pad_dynamic(windows.window_sizes(_encoded(spark, sf)), batch_size=32))


@query
def chunk_cap(spark: SparkSession, sf: str) -> DataFrame:
    per_document = materialise(windows.windows_per_document(_encoded(spark, sf)), "document-sizes")
    indexed = ordering.dense_index(per_document, "doc_id")
    return windows.chunk_cap(indexed, "idx", 1000).select("doc_id", "win", "batch")


@query
def chunk_cap_100(spark: SparkSession, sf: str) -> DataFrame:
    """The cap over batches of 100 documents, so that it bites in each of many batches."""
    per_document = materialise(windows.windows_per_document(_encoded(spark, sf)), "document-sizes")
    return windows.chunk_cap(ordering.dense_index(per_document, "doc_id"), "idx", 100).select("doc_id", "win", "batch")


@query
def token_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    encoded = splitting.threshold_split(_encoded(spark, sf), "doc_id", test_size=0.1, seed=666)
    stats = summary.length_statistics(encoded, ["split"], F.size("ids") + 2)
    floats = ["mean", "median", "percentile_95", "percentile_99"]
    return stats.select("split", "n", "min", "max", *[F.round(c, 6).alias(c) for c in floats])


# Masks, losses, perplexity


@query
def mlm_mask_plan(spark: SparkSession, sf: str) -> DataFrame:
    vocab = _vocabulary(spark, sf)
    cut = windows.token_windows(encoding.encode_wordpiece(_documents(spark, sf, "doc_id", "text"), vocab))
    return masking.mask_plan(cut, ["doc_id", "win"], len(vocab))


@query
def mlm_masked_windows(spark: SparkSession, sf: str) -> DataFrame:
    vocab = _vocabulary(spark, sf)
    cut = windows.token_windows(encoding.encode_wordpiece(_documents(spark, sf, "doc_id", "text"), vocab))
    masked = masking.mask_for_training(cut, ["doc_id", "win"], len(vocab))
    return masked.select("doc_id", "win", _text("input_ids").alias("input_ids"), _text("labels").alias("labels"))


@query
def mlm_mask_rates(spark: SparkSession, sf: str) -> DataFrame:
    return masking.mask_rates(windows.token_windows(_encoded(spark, sf)), ["doc_id", "win"])


@query
def pppl_expand(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encoding.encode_wordpiece(_held_out(spark, sf), _vocabulary(spark, sf))
    expanded = masking.expand_masks(windows.truncate_first(encoded), ITEM)
    return expanded.select(*ITEM, "pos", "label", _md5_of_ids("masked_ids").alias("masked_md5"))


def _bigrams(spark: SparkSession, sf: str, vocab: vocabulary.Vocabulary) -> DataFrame:
    return recipes.train_bigrams(_train(_documents(spark, sf, "doc_id", "text")), vocab)


@query
def bigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _bigrams(spark, sf, _vocabulary(spark, sf))


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    vocab = _vocabulary(spark, sf)
    positions = recipes.held_out_positions(_held_out(spark, sf), vocab, ITEM)
    return scoring.bigram_losses(positions, _bigrams(spark, sf, vocab), len(vocab))


@query
def bigram_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _losses(spark, sf).drop("n").withColumn("loss", F.round("loss", 6))


def _trigram_losses(spark: SparkSession, sf: str, least: int) -> DataFrame:
    vocab = _vocabulary(spark, sf)
    model = recipes.train_trigrams(_train(_documents(spark, sf, "doc_id", "text")), vocab, least)
    return recipes.trigram_losses(_held_out(spark, sf), model, vocab, ITEM)


@query
def trigram_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of every held-out position under a smoothed trigram model of the train texts."""
    losses = _trigram_losses(spark, sf, least=1)
    return losses.select(*ITEM, "pos", "a", "b", "c", F.round("loss", 6).alias("loss"))


@query
def pseudo_ppl_trigram(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo-perplexity of every held-out text under trigrams seen at least twice."""
    scored = scoring.pseudo_perplexity(_trigram_losses(spark, sf, least=2), ITEM)
    every = scoring.score_all(_held_out(spark, sf), scored, ITEM)
    return every.select(*ITEM, "n_tokens", F.round("ppl", 6).alias("ppl"))


def _perplexity(spark: SparkSession, sf: str, weighting: str) -> DataFrame:
    scored = scoring.pseudo_perplexity(_losses(spark, sf), ITEM, weighting)
    every = scoring.score_all(_held_out(spark, sf), scored, ITEM)
    return every.select(*ITEM, "n_tokens", F.round("ppl", 6).alias("ppl"))


@query
def pseudo_ppl_batch4(spark: SparkSession, sf: str) -> DataFrame:
    return _perplexity(spark, sf, "batch")


@query
def pseudo_ppl_token(spark: SparkSession, sf: str) -> DataFrame:
    return _perplexity(spark, sf, "token")


@query
def corpus_ppl(spark: SparkSession, sf: str) -> DataFrame:
    vocab = _vocabulary(spark, sf)
    docs = splitting.threshold_split(_documents(spark, sf, "doc_id", "text"), "doc_id", test_size=0.1, seed=666)
    encoded = encoding.encode_wordpiece(docs.select("split", "text"), vocab)
    whole = encoded.select("split", K.with_specials(F.col("ids")).alias("input_ids"))
    pairs = materialise(scoring.bigram_counts(whole, ["split"]), "pairs")
    counts = pairs.where(F.col("split") == "train").drop("split")
    scored = scoring.corpus_perplexity(pairs, counts, len(vocab))
    return scored.select(
        "split", "n_tokens", F.round("eval_loss", 6).alias("eval_loss"), F.round("perplexity", 6).alias("perplexity")
    )


def _results(spark: SparkSession, sf: str) -> DataFrame:
    vocab = _vocabulary(spark, sf)
    return recipes.score_held_out(_held_out(spark, sf), _bigrams(spark, sf, vocab), vocab, ITEM, MODELS)


@query
def ppl_describe(spark: SparkSession, sf: str) -> DataFrame:
    report = recipes.held_out_report(materialise(_results(spark, sf), "results"))
    return report.withColumn("value", F.round("value", 6))


@query
def events_describe(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    return summary.describe(events, ["event_type"], "value").withColumn("value", F.round("value", 6))


@query
def quantiles_by_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quartiles of all events by the way for more values than a task should hold."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    found = summary.exact_quantiles(events, ["event_type"], "value", [0.25, 0.5, 0.75, 0.99], 64, max_values=0)
    return found.select("event_type", "share", F.round("value", 6).alias("value"))


@query
def quantiles_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles of lengths, where large sources are counted in rounds and small ones held by one aggregate."""
    docs = _documents(spark, sf, "lang", "source", "n_chars")
    found = summary.exact_quantiles(docs, ["lang", "source"], "n_chars", [0.05, 0.5, 0.95], 16, max_values=40)
    return found.select("lang", "source", "share", F.round("value", 6).alias("value"))


@query
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    expected = _documents(spark, sf, "doc_id", "source")
    return summary.completeness(expected, spark.read.parquet(f"{sf}/labels.parquet"), ["doc_id"], ["source"])


@query
def own_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo-perplexity with a scorer passed in: here a loss that falls with the token's id and grows with its place."""
    vocab = _vocabulary(spark, sf)
    encoded = encoding.encode_wordpiece(_held_out(spark, sf), vocab)
    expanded = masking.expand_masks(windows.truncate_first(encoded), ITEM)

    def make():
        return lambda rows: rows["pos"] / 512 + 1 / (1 + rows["label"]) + rows["masked_ids"].map(len) / 1000

    losses = scoring.score_with(expanded, ITEM, make)
    scored = scoring.pseudo_perplexity(losses, ITEM)
    return scored.select(*ITEM, "n_tokens", F.round("ppl", 6).alias("ppl"))


@query
def missing_results(spark: SparkSession, sf: str) -> DataFrame:
    expected = split_threshold(spark, sf).where(F.col("split") == "test")
    return summary.missing_results(expected, spark.read.parquet(f"{sf}/labels.parquet"), ["doc_id"])


@query
def model_compare(spark: SparkSession, sf: str) -> DataFrame:
    compared = summary.compare_models(materialise(_results(spark, sf), "results"), ITEM)
    return compared.withColumn("mean_ppl", F.round("mean_ppl", 6))


# Whole recipes


@query
def legacy_corpus(spark: SparkSession, sf: str) -> DataFrame:
    made = recipes.legacy_windows(_documents(spark, sf), _vocabulary(spark, sf), ["lang", "source", "n_chars"])
    return made.select("doc_id", "win", "split", F.md5(_text("input_ids")).alias("ids_md5"))


@query
def legacy_corpus_capped(spark: SparkSession, sf: str) -> DataFrame:
    made = recipes.legacy_windows(
        _documents(spark, sf), _vocabulary(spark, sf), ["lang", "source", "n_chars"], cap_batch=100
    )
    return made.select("doc_id", "win", "split", F.md5(_text("input_ids")).alias("ids_md5"))


@query
def current_corpus(spark: SparkSession, sf: str) -> DataFrame:
    made = recipes.current_windows(_with_quality(spark, sf), _vocabulary(spark, sf))
    return made.select("doc_id", "win", "split", F.md5(_text("input_ids")).alias("ids_md5"))


@query
def split_word_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, split, and describe the number of words per split."""
    corpus = recipes.clean_corpus(_documents(spark, sf), ["lang", "source", "n_chars"])
    stats = summary.length_statistics(corpus, ["split"], F.size(T.bert_words(F.col("text"))))
    floats = ["mean", "median", "percentile_95", "percentile_99"]
    return stats.select("split", "n", "min", "max", *[F.round(c, 6).alias(c) for c in floats])
