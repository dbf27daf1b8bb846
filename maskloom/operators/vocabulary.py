"""Word counts, alphabets, pair counts, and training of WordPiece and byte-level BPE vocabularies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.storagelevel import StorageLevel

from maskloom.functions import text as T
from maskloom.session import shared_dir, spread

CONTINUATION = "##"
ALPHABET_LIMIT = 1000

VOCAB_SCHEMA = ST.StructType([ST.StructField("token", ST.StringType()), ST.StructField("id", ST.IntegerType())])
MERGE_SCHEMA = ST.StructType(
    [
        ST.StructField("rank", ST.IntegerType()),
        ST.StructField("left", ST.StringType()),
        ST.StructField("right", ST.StringType()),
    ]
)


@dataclass
class Vocabulary:
    """Token ids, and for BPE the merges in order. Its size is bounded by the vocabulary size asked for."""

    tokens: dict[str, int]
    merges: list[tuple[str, str]] = field(default_factory=list)
    rounds: int = 0

    # Far above any vocabulary in use; beyond it a table is no longer fit for a broadcast.
    MAX_TOKENS = 1_000_000

    def __post_init__(self) -> None:
        if len(self.tokens) > self.MAX_TOKENS:
            raise ValueError(f"a vocabulary of {len(self.tokens)} tokens is too large to broadcast")

    def __len__(self) -> int:
        return len(self.tokens)

    @property
    def longest_piece(self) -> int:
        return max((len(t.removeprefix(CONTINUATION)) for t in self.tokens), default=0)

    def token_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.tokens.items()), VOCAB_SCHEMA).coalesce(1)

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, left, right) for rank, (left, right) in enumerate(self.merges)]
        return spark.createDataFrame(rows, MERGE_SCHEMA).coalesce(1)

    @classmethod
    def from_tables(cls, tokens: DataFrame, merges: DataFrame | None = None) -> Vocabulary:
        """Read the tables back, after checking their size."""
        rows = tokens.select("token", "id").limit(cls.MAX_TOKENS + 1).collect()
        found = cls({r["token"]: r["id"] for r in sorted(rows, key=lambda r: r["id"])})
        if merges is not None:
            held = merges.limit(cls.MAX_TOKENS + 1).collect()
            if len(held) > cls.MAX_TOKENS:
                raise ValueError(f"more than {cls.MAX_TOKENS} merges are too many to broadcast")
            ordered = sorted(held, key=lambda r: r["rank"])
            found.merges = [(r["left"], r["right"]) for r in ordered]
        return found


def word_counts(df: DataFrame, words: Column) -> DataFrame:
    """Occurrences of each word. Counting starts before the shuffle, so frequent words cost little."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def bert_word_counts(df: DataFrame, text: str = "text", **normalisation: bool) -> DataFrame:
    """Occurrences of each word of ``bert_words``.

    No word crosses a blank, so the pieces between blanks are counted first, and each distinct one is split into words
    once.
    """
    pieces = df.select(F.explode(F.split(text, " ")).alias("_piece")).groupBy("_piece").agg(F.count("*").alias("_n"))
    words = pieces.select(F.explode(T.bert_words(F.col("_piece"), **normalisation)).alias("word"), "_n")
    return words.groupBy("word").agg(F.sum("_n").alias("cnt"))


def character_counts(counts: DataFrame) -> DataFrame:
    """Occurrences of each character over all words."""
    chars = counts.select(F.explode(F.split("word", "")).alias("ch"), "cnt").where(F.col("ch") != "")
    return chars.groupBy("ch").agg(F.sum("cnt").alias("cnt"))


def alphabet(counts: DataFrame, limit: int = ALPHABET_LIMIT) -> DataFrame:
    """The ``limit`` most frequent characters."""
    return character_counts(counts).orderBy(F.desc("cnt"), "ch").limit(limit)


def continuation_characters(counts: DataFrame) -> DataFrame:
    """Characters that occur after the first position of a word."""
    return character_counts(counts.withColumn("word", F.expr("substring(word, 2)")))


def symbols(word: Column, continuation: str = CONTINUATION) -> Column:
    """The word as an array of one-character symbols, all but the first with the continuation prefix."""
    chars = F.split(word, "")
    if not continuation:
        return chars
    return F.transform(chars, lambda c, i: F.when(i > 0, F.concat(F.lit(continuation), c)).otherwise(c))


def adjacent_pairs(items: Column) -> Column:
    """Neighbours in an array, as structs of ``left`` and ``right``."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.arrays_zip(F.slice(items, F.lit(1), n).alias("left"), F.slice(items, F.lit(2), n).alias("right"))


def count_pairs(words: DataFrame, items: Column) -> DataFrame:
    """Occurrences of each pair of neighbours, weighted by the word's count."""
    return (
        words.select(F.explode(adjacent_pairs(items)).alias("pair"), "cnt")
        .groupBy(F.col("pair.left").alias("left"), F.col("pair.right").alias("right"))
        .agg(F.sum("cnt").alias("cnt"))
    )


def pair_counts(counts: DataFrame, continuation: str = CONTINUATION) -> DataFrame:
    """Pair counts over one-character symbols: where vocabulary training starts."""
    return count_pairs(counts, symbols(F.col("word"), continuation))


def basic_vocabulary(
    counts: DataFrame,
    n_words: int,
    n_endings: int = 0,
    without: Sequence[str] = (),
    special_tokens: Sequence[str] = T.SPECIAL_TOKENS,
    alphabet_limit: int = ALPHABET_LIMIT,
) -> Vocabulary:
    """A vocabulary without merges: characters, their continuations, frequent words and frequent word endings.

    ``alphabet_limit`` characters are kept, the most frequent ones. ``without`` names characters that get no continuation, so that some words have no pieces.
    """
    kept = counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        chars = sorted(r["ch"] for r in alphabet(kept, alphabet_limit).collect())
        words = kept.where(F.length("word") > 1).orderBy(F.desc("cnt"), "word").limit(n_words)
        endings = (
            kept.where(F.length("word") >= 4)
            .groupBy(F.concat(F.lit(CONTINUATION), F.expr("right(word, 2)")).alias("token"))
            .agg(F.sum("cnt").alias("cnt"))
            .orderBy(F.desc("cnt"), "token")
            .limit(n_endings)
        )
        tokens = list(special_tokens) + chars
        tokens += [CONTINUATION + c for c in chars if c not in without]
        tokens += sorted(r["word"] for r in words.collect())
        tokens += sorted(r["token"] for r in endings.collect())
    finally:
        kept.unpersist()
    return Vocabulary({token: i for i, token in enumerate(tokens)})


def _symbol(token_id: int) -> str:
    """One character per token id, in id order, so that comparing text compares ids."""
    code = 0x100 + token_id
    return chr(code if code < 0xD800 else code + 0x800)  # past the surrogates


def _token_id(symbol: str) -> int:
    code = ord(symbol)
    return (code if code < 0xD800 else code - 0x800) - 0x100


def _joined(left: str, right: str, continuation: str) -> str:
    return left + (right.removeprefix(continuation) if continuation else right)


def _as_symbols(text: Column, chars: Sequence[str], ids: Sequence[int]) -> Column:
    """Rewrite known characters as symbols and drop the others."""
    if not chars:
        return F.lit("")
    known = "".join(rf"\x{{{ord(c):X}}}" for c in chars)
    return F.translate(F.regexp_replace(text, f"[^{known}]", ""), "".join(chars), "".join(map(_symbol, ids)))


def _start_state(counts: DataFrame, tokens: dict[str, int], chars: Sequence[str], continuation: str) -> DataFrame:
    """Each word as a string of symbols. Words of one symbol have no pair, so they are done."""
    word = F.col("word")
    if continuation:
        rest = [c for c in chars if continuation + c in tokens]
        packed = F.concat(
            _as_symbols(F.substring(word, 1, 1), chars, [tokens[c] for c in chars]),
            _as_symbols(F.expr("substring(word, 2)"), rest, [tokens[continuation + c] for c in rest]),
        )
    else:
        packed = _as_symbols(word, chars, [tokens[c] for c in chars])
    return counts.select(packed.alias("packed"), "cnt").where(F.length("packed") > 1)


def _cut(state: DataFrame) -> DataFrame:
    """End the lineage in the shared folder and keep a cached copy spread over all cores."""
    return spread(state.checkpoint(), "packed").persist(StorageLevel.MEMORY_AND_DISK)


def _merge(state: DataFrame, edits: Sequence[tuple[str, str]], step: int = 8) -> DataFrame:
    """Replace each pair of symbols by its token, from left to right.

    The chain is filled up to a multiple of ``step`` with edits of a symbol that no word holds, so that most
    rounds have a plan of the same shape and reuse its compiled code.
    """
    packed = F.col("packed")
    idle = [("\x00\x00", "\x00")] * (-len(edits) % step)
    for pair, token in [*edits, *idle]:
        packed = F.replace(packed, F.lit(pair), F.lit(token))
    return state.select(packed.alias("packed"), "cnt").where(F.length("packed") > 1)


def _best_pairs(state: DataFrame, min_frequency: int, limit: int) -> list[tuple[int, int, int]]:
    """The most frequent pairs of token ids with their counts, ties to the lower ids."""
    # one split, then neighbours: linear in the word, where a substring at every place would be quadratic
    letters = F.split("packed", "")
    rest = F.slice(letters, F.lit(2), F.size(letters) - 1)
    pairs = F.zip_with(F.slice(letters, F.lit(1), F.size(letters) - 1), rest, lambda a, b: F.concat(a, b))
    rows = (
        state.where(F.length("packed") > 1)
        .select(F.explode(pairs).alias("pair"), "cnt")
        .groupBy("pair")
        .agg(F.sum("cnt").alias("cnt"))
        .where(F.col("cnt") >= min_frequency)
        .orderBy(F.desc("cnt"), "pair")
        .limit(limit)
        .collect()
    )
    return [(_token_id(r["pair"][0]), _token_id(r["pair"][1]), r["cnt"]) for r in rows]


def _undisturbed(
    ranked: Sequence[tuple[int, int, int]], names: Sequence[str], tokens: dict[str, int], continuation: str, room: int
) -> list[tuple[int, int]]:
    """The longest run of best pairs whose merges give the same result one at a time or all together.

    Two pairs disturb each other only where one ends with the token the other begins with; merging either then
    changes the other's count. Pairs that share no such token keep their counts, and a pair with a new token
    neither counts more than the disturbed pair it came from nor goes before it in a tie, and that pair stands
    behind the run. A pair of equal tokens and a merge into an existing token lack these bounds, so they end
    the run.
    """
    chosen: list[tuple[int, int]] = []
    made: set[str] = set()
    lefts: set[int] = set()
    rights: set[int] = set()
    for left, right, _ in ranked:
        if len(made) >= room or left in rights or right in lefts:
            break
        token = _joined(names[left], names[right], continuation)
        chosen.append((left, right))
        if left == right or token in tokens or token in made:
            break
        made.add(token)
        lefts.add(left)
        rights.add(right)
    return chosen


def _close_to_best(ranked: Sequence[tuple[int, int, int]], rho: float, room: int) -> list[tuple[int, int]]:
    """All undisturbed pairs that count at least ``rho`` times the best one. Fewer rounds, another vocabulary."""
    chosen: list[tuple[int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for left, right, count in ranked:
        if len(chosen) >= room or count < rho * ranked[0][2]:
            break
        if left in rights or right in lefts or (left == right and chosen):
            continue
        chosen.append((left, right))
        if left == right:
            break
        lefts.add(left)
        rights.add(right)
    return chosen


def start_names(
    counts: DataFrame,
    special_tokens: Sequence[str],
    continuation: str,
    chars: Sequence[str] | None,
    alphabet_limit: int,
) -> list[str]:
    """The tokens before any merge: special tokens, the alphabet, and its characters within words."""
    if chars is None:
        chars = [r["ch"] for r in alphabet(counts, alphabet_limit).collect()]
    names = list(special_tokens) + [c for c in sorted(chars) if c not in special_tokens]
    if continuation:
        inner = continuation_characters(counts).where(F.col("ch").isin(list(chars)))
        names += sorted(continuation + r["ch"] for r in inner.collect())
    return names


def train(
    counts: DataFrame,
    vocab_size: int,
    min_frequency: int = 2,
    special_tokens: Sequence[str] = T.SPECIAL_TOKENS,
    continuation: str = CONTINUATION,
    chars: Sequence[str] | None = None,
    alphabet_limit: int = ALPHABET_LIMIT,
    rho: float | None = None,
    candidates: int = 512,
    cut_every: int = 12,
) -> Vocabulary:
    """Merge the most frequent pairs of tokens until the vocabulary is full or pairs get too rare.

    Each round is one job: rewrite the words, count pairs, bring the best ``candidates`` pairs to the driver.
    Only those, never words, leave the executors. Ties go to the pair of lower token ids. Every ``cut_every``
    rounds the words are checkpointed to the shared folder, which ends their lineage.

    Without ``chars`` the alphabet is the ``alphabet_limit`` most frequent characters. ``rho`` trades agreement for fewer rounds; without it merges are exactly those of one-at-a-time training.
    """
    shared_dir(counts.sparkSession)
    names = start_names(counts, special_tokens, continuation, chars, alphabet_limit)
    chars = sorted(chars if chars is not None else [n for n in names if len(n) == 1])
    tokens = {name: i for i, name in enumerate(names)}
    merges: list[tuple[str, str]] = []
    rounds = 0

    state = _cut(_start_state(counts, tokens, chars, continuation))
    held = [state]
    while len(tokens) < vocab_size:
        ranked = _best_pairs(state, min_frequency, candidates)
        if not ranked:
            break
        room = vocab_size - len(tokens)
        if rho is None:
            chosen = _undisturbed(ranked, names, tokens, continuation, room)
        else:
            chosen = _close_to_best(ranked, rho, room)
        edits = []
        for left, right in chosen:
            token = _joined(names[left], names[right], continuation)
            merges.append((names[left], names[right]))
            if token not in tokens:
                tokens[token] = len(tokens)
                names.append(token)
            edits.append((_symbol(left) + _symbol(right), _symbol(tokens[token])))
        rounds += 1
        merged = _merge(state, edits)
        merged = _cut(merged) if rounds % cut_every == 0 else merged.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(merged)
        state = merged
        if len(held) > 2:
            held.pop(0).unpersist()
    for frame in held:
        frame.unpersist()
    return Vocabulary(tokens, merges, rounds)


def train_wordpiece(df: DataFrame, vocab_size: int = 30_512, min_frequency: int = 2, text: str = "text", **options):
    """Train a WordPiece vocabulary on a text column."""
    counts = bert_word_counts(df, text).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return train(counts, vocab_size, min_frequency, **options)
    finally:
        counts.unpersist()


def train_byte_level(df: DataFrame, vocab_size: int = 30_512, min_frequency: int = 2, text: str = "text", **options):
    """Train a byte-level BPE vocabulary on a text column."""
    counts = word_counts(df, T.byte_level_words(F.col(text)))
    return train(counts, vocab_size, min_frequency, continuation="", chars=list(T.byte_symbols()), **options)


def vocabulary_sizes(vocabularies: dict[str, Vocabulary], spark: SparkSession) -> DataFrame:
    """Number of tokens per vocabulary."""
    tables = [v.token_table(spark).select(F.lit(name).alias("vocabulary")) for name, v in vocabularies.items()]
    combined = tables[0]
    for table in tables[1:]:
        combined = combined.union(table)
    return combined.groupBy("vocabulary").agg(F.count("*").alias("n_tokens"))
