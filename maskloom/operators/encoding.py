"""Texts to token ids.

Whole documents are encoded where they are read: the JVM splits words (texts of plain Latin characters only at blanks),
and each Arrow batch looks up its distinct words or pieces in the broadcast vocabulary. Nothing is shuffled, so frequent words and long documents cost no more than
their share. Distinct words alone are encoded by joins.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from maskloom.functions import text as T
from maskloom.functions.bytepairs import merge_pairs, merge_table
from maskloom.operators.vocabulary import CONTINUATION, Vocabulary
from maskloom.session import bound_batches

UNKNOWN = "[UNK]"
LONGEST_WORD = 100
IDS = ST.ArrayType(ST.IntegerType(), False)
# Distinct words a task remembers between batches before it starts afresh.
MEMORY = 200_000
# Rows encoded at a time: the arrays of places need many times the memory of the texts.
ROWS = 500


def wordpiece_encoder(
    tokens: dict[str, int], longest_piece: int, longest_word: int = LONGEST_WORD
) -> Callable[[str], list[int]]:
    """Longest match from the left; a word with an unmatched rest, or a longer word, is one unknown token."""
    rest = {token[len(CONTINUATION) :]: i for token, i in tokens.items() if token.startswith(CONTINUATION)}
    # continuations are mostly much shorter than whole words
    longest_rest = min(longest_piece, max(map(len, rest), default=0))
    unknown = tokens[UNKNOWN]

    def encode(word: str) -> list[int]:
        size = len(word)
        if not 0 < size <= longest_word:
            return [unknown]
        ids: list[int] = []
        start, known, longest = 0, tokens, longest_piece
        while start < size:
            end = min(size, start + longest)
            while end > start and (found := known.get(word[start:end])) is None:
                end -= 1
            if end == start:
                return [unknown]
            ids.append(found)
            start, known, longest = end, rest, longest_rest
        return ids

    return encode


def wordpiece_ids(
    word: str, tokens: dict[str, int], longest_piece: int, longest_word: int = LONGEST_WORD
) -> list[int]:
    """The ids of one word."""
    return wordpiece_encoder(tokens, longest_piece, longest_word)(word)


def byte_level_ids(word: str, tokens: dict[str, int], merges: dict[int, int]) -> list[int]:
    """Join the neighbours of lowest merge rank until none is left, in n log n steps for a word of n letters."""
    return merge_pairs([tokens[letter] for letter in word], merges)


def _encode_rows(words: pa.Array, memory: dict[str, bytes], to_ids: Callable[[str], list[int]]) -> pa.Array:
    """The arrays of token ids of arrays of words."""
    coded = words.flatten().dictionary_encode()
    if len(memory) > MEMORY:
        memory.clear()
    entries = []
    for word in coded.dictionary.to_pylist():
        ids = memory.get(word)
        if ids is None:
            ids = memory[word] = array("i", to_ids(word)).tobytes()
        entries.append(ids)
    sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(entries), np.int32)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes[codes])])
    # position of each output id inside the flat id list of its word
    picks = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[codes], sizes[codes])
    rows = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(flat[picks], pa.int32()))


def _encode_batches(
    batches: Iterator[pa.RecordBatch], column: str, out: str, to_ids: Callable[[str], list[int]]
) -> Iterator[pa.RecordBatch]:
    """Replace the word array ``column`` by the array ``out`` of token ids."""
    memory: dict[str, bytes] = {}
    for whole in batches:
        kept = [name for name in whole.schema.names if name != column]
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            encoded = _encode_rows(batch.column(column), memory, to_ids)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], encoded], [*kept, out])


def _encode(
    df: DataFrame, text: str, words: Column, out: str, make: Callable[[], Callable[[str], list[int]]]
) -> DataFrame:
    bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c != text]
    schema = ST.StructType([*[df.schema[c] for c in kept], ST.StructField(out, IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encode_batches(batches, "_words", out, make())

    return df.select(*kept, words.alias("_words")).mapInArrow(run, schema)


def _with_marks(vocabulary: Vocabulary, special_tokens: Sequence[str], marks: Sequence[str]) -> dict[str, int]:
    marked = {marks[T.SPECIAL_TOKENS.index(t)]: vocabulary.tokens[t] for t in special_tokens}
    return {**vocabulary.tokens, **marked}


def encode_wordpiece(
    df: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    out: str = "ids",
    special_tokens: Sequence[str] = T.RELOADED_SPECIALS,
    longest_word: int = LONGEST_WORD,
    **normalisation: bool,
) -> DataFrame:
    """Replace ``text`` by its WordPiece ids, without opening and closing tokens.

    ``special_tokens`` written out in a text get their own id. Words of more than ``longest_word`` characters are
    unknown.
    """
    known = (_with_marks(vocabulary, special_tokens, T.WORDPIECE_MARKS), vocabulary.longest_piece)
    shared = df.sparkSession.sparkContext.broadcast(known)

    def make() -> Callable[[str], list[int]]:
        tokens, longest = shared.value
        split, encode = T.words_of_piece(**normalisation), wordpiece_encoder(tokens, longest, longest_word)
        return lambda piece: [i for word in split(piece) for i in encode(word)]

    pieces = T.bert_pieces(F.col(text), special_tokens=special_tokens, **normalisation)
    return _encode(df, text, pieces, out, make)


def encode_byte_level(
    df: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    out: str = "ids",
    special_tokens: Sequence[str] = T.SPECIAL_TOKENS,
) -> DataFrame:
    """Replace ``text`` by its byte-level BPE ids."""
    ids = vocabulary.tokens
    merges = merge_table([(ids[a], ids[b], ids[a + b]) for a, b in vocabulary.merges])
    known = (_with_marks(vocabulary, special_tokens, T.BYTE_LEVEL_MARKS), merges)
    shared = df.sparkSession.sparkContext.broadcast(known)

    def make() -> Callable[[str], list[int]]:
        tokens, merges = shared.value
        return lambda word: byte_level_ids(word, tokens, merges)

    return _encode(df, text, T.byte_level_words(F.col(text), special_tokens), out, make)


def encode_words(counts: DataFrame, vocabulary: Vocabulary, longest_word: int = LONGEST_WORD) -> DataFrame:
    """Add the WordPiece ids of distinct words; nothing is shuffled."""
    shared = counts.sparkSession.sparkContext.broadcast((vocabulary.tokens, vocabulary.longest_piece))
    schema = ST.StructType([counts.schema["word"], counts.schema["cnt"], ST.StructField("ids", IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = wordpiece_encoder(*shared.value, longest_word)
        for batch in batches:
            ids = [encode(w) for w in batch.column("word").to_pylist()]
            columns = [batch.column("word"), batch.column("cnt"), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "cnt", "ids"])

    return counts.select("word", "cnt").mapInArrow(run, schema)


def encode_words_by_joins(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The same by joining the words' parts with the vocabulary, all in the JVM: a cross-check of ``encode_words``.

    ``counts`` must be distributed by word, as an aggregate by word is; then nothing more is shuffled.
    """
    table = vocabulary.token_table(counts.sparkSession)  # bounded by the vocabulary size
    word, start = F.col("word"), F.col("start")
    starts = F.when(F.length("word") <= LONGEST_WORD, F.sequence(F.lit(0), F.length("word") - 1))
    ends = F.sequence(F.lit(1), F.least(F.length("word") - start, F.lit(vocabulary.longest_piece)))
    parts = (
        counts.select("word", "cnt", F.explode(F.coalesce(starts, F.array(F.lit(0)))).alias("start"))
        .select("word", "cnt", "start", F.explode(ends).alias("size"))
        .withColumn("prefix", F.when(start > 0, CONTINUATION).otherwise(""))
        .withColumn("token", F.concat("prefix", F.substring("word", start + 1, F.col("size"))))
    )
    # One row per word stays without a match, so that no word is lost; other parts that match nothing go at once.
    found = parts.join(F.broadcast(table), "token", "left").where(
        F.col("id").isNotNull() | ((start == 0) & (F.col("size") == 1))
    )
    # size and id in one number, so that the aggregate finds the longest match and its id together
    match = F.shiftleft(F.col("size").cast("long"), 32) + F.col("id")
    longest = found.groupBy("word", "cnt", "start").agg(F.max(match).alias("match"))
    # at most LONGEST_WORD entries per word
    chains = longest.groupBy("word", "cnt").agg(
        F.map_from_entries(F.collect_list(F.struct("start", "match"))).alias("matches")
    )
    nothing = F.array().cast(IDS)
    begin = F.struct(F.lit(0).alias("at"), nothing.alias("ids"), (F.length("word") <= LONGEST_WORD).alias("ok"))

    def step(state: Column, _: Column) -> Column:
        found = F.try_element_at(F.col("matches"), state.at)
        moved = F.struct(
            (state.at + F.shiftright(found, 32).cast("int")).alias("at"),
            F.concat(state.ids, F.array(found.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))).alias("ids"),
            F.lit(True).alias("ok"),
        )
        stuck = F.struct(state.at.alias("at"), state.ids.alias("ids"), F.lit(False).alias("ok"))
        done = ~state.ok | (state.at >= F.length("word"))
        return F.when(done, state).when(found.isNull(), stuck).otherwise(moved)

    unknown = F.array(F.lit(vocabulary.tokens[UNKNOWN]))
    ids = F.aggregate(
        F.sequence(F.lit(1), F.length("word")), begin, step, lambda s: F.when(s.ok, s.ids).otherwise(unknown)
    )
    return chains.select("word", "cnt", ids.alias("ids"))


def pieces(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "pieces") -> DataFrame:
    """Add the token strings of an id array, joined by blanks."""
    names = sorted(vocabulary.tokens, key=vocabulary.tokens.get)
    shared = encoded.sparkSession.sparkContext.broadcast(names)
    fields = [*encoded.schema.fields, ST.StructField(out, ST.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [" ".join(shared.value[i] for i in row) for row in batch.column(ids).to_pylist()]
            columns = [*batch.columns, pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, out])

    return encoded.mapInArrow(run, ST.StructType(fields))


def unknown_rate(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """Tokens, unknown tokens and their share in percent; null for no tokens."""
    unknown = F.lit(vocabulary.tokens[UNKNOWN])
    counted = df.select(
        F.size(ids).cast("long").alias("n"), F.size(F.filter(ids, lambda i: i == unknown)).cast("long").alias("u")
    )
    total, unk = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0))
    return counted.agg(total.alias("n_tokens"), unk.alias("n_unknown")).withColumn(
        "oov_percent", F.try_divide(F.col("n_unknown") * F.lit(100.0), F.col("n_tokens"))
    )


def compare_tokens(
    sampled: DataFrame, key: str, first: Vocabulary, second: Vocabulary, text: str = "text"
) -> DataFrame:
    """WordPiece and byte-level tokens of the same texts side by side, in one pass."""
    texts = sampled.select(key, text, F.col(text).alias("_left"), F.col(text).alias("_right"))
    both = encode_wordpiece(texts, first, "_left", "_left_ids", special_tokens=T.SPECIAL_TOKENS)
    both = pieces(both, first, "_left_ids", "wordpiece_tokens").drop("_left_ids")
    both = encode_byte_level(both, second, "_right", "_right_ids")
    return pieces(both, second, "_right_ids", "byte_level_tokens").drop("_right_ids")
