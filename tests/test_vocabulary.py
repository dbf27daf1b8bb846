from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import BertWordPieceTokenizer, ByteLevelBPETokenizer

from maskloom.functions import text as T
from maskloom.operators import vocabulary as V


def one_at_a_time(words, start, continuation, vocab_size, min_frequency):
    """Merges in order, found by merging a single pair per step."""
    tokens = {t: i for i, t in enumerate(start)}
    state = [
        ([w[0], *[continuation + c for c in w[1:]]], n) for w, n in words.items()
    ]
    merges = []
    while len(tokens) < vocab_size:
        pairs = Counter()
        for symbols, n in state:
            for pair in zip(symbols, symbols[1:]):
                pairs[pair] += n
        if not pairs:
            break
        (left, right), n = min(pairs.items(), key=lambda p: (-p[1], tokens[p[0][0]], tokens[p[0][1]]))
        if n < min_frequency:
            break
        merges.append((left, right))
        joined = left + right.removeprefix(continuation)
        tokens.setdefault(joined, len(tokens))
        for symbols, _ in state:
            i = 0
            while i < len(symbols) - 1:
                if (symbols[i], symbols[i + 1]) == (left, right):
                    symbols[i : i + 2] = [joined]
                i += 1
    return tokens, merges


WORDS = {
    "aaaa": 9, "aaaaa": 7, "abab": 11, "ababab": 5, "banana": 12, "bandana": 8, "cabana": 8,
    "abc": 10, "bca": 10, "cab": 10, "zzzz": 3, "zzzzzz": 2, "once": 1, "nab": 4,
}


@pytest.mark.parametrize("continuation", ["##", ""])
def test_training_equals_one_merge_at_a_time(spark, continuation):
    counts = spark.createDataFrame(list(WORDS.items()), "word string, cnt long")
    chars = sorted({c for w in WORDS for c in w})
    inner = sorted({c for w in WORDS for c in w[1:]}) if continuation else []
    start = ["[UNK]", *chars, *[continuation + c for c in inner]]
    tokens, merges = one_at_a_time(WORDS, start, continuation, 45, 2)
    found = V.train(counts, 45, 2, special_tokens=["[UNK]"], continuation=continuation, cut_every=3)
    assert found.merges == merges
    assert found.tokens == tokens
    assert found.rounds < len(merges)


def test_rare_characters_are_dropped(spark):
    counts = spark.createDataFrame([("abx", 5), ("ab", 5), ("xab", 1)], "word string, cnt long")
    found = V.train(counts, 20, 2, special_tokens=["[UNK]"], chars=["a", "b"])
    assert found.merges == [("a", "##b")]


def test_byte_level_equals_the_library(documents, texts):
    library = ByteLevelBPETokenizer()
    library.train_from_iterator(
        texts, vocab_size=400, min_frequency=2, special_tokens=T.SPECIAL_TOKENS, show_progress=False
    )
    assert V.train_byte_level(documents, 400).tokens == library.get_vocab()


def test_wordpiece_equals_the_library(documents, texts):
    library = BertWordPieceTokenizer()
    library.train_from_iterator(
        texts, vocab_size=300, min_frequency=2, special_tokens=T.SPECIAL_TOKENS, show_progress=False
    )
    # ids of continuation characters follow no order there, so compare the sets
    assert set(V.train_wordpiece(documents, 300).tokens) == set(library.get_vocab())


def test_relaxed_training_takes_fewer_rounds(documents):
    counts = V.word_counts(documents, T.bert_words(F.col("text"))).cache()
    exact = V.train(counts, 180)
    relaxed = V.train(counts, 180, rho=0.7)
    assert relaxed.rounds < exact.rounds
    assert len(set(exact.tokens) & set(relaxed.tokens)) > 160


def test_symbols_follow_id_order():
    ids = [0, 5, 0xD6FF, 0xD700, 0xD701, 70000, 999_999]
    symbols = [V._symbol(i) for i in ids]
    assert [V._token_id(s) for s in symbols] == ids
    assert [s.encode() for s in symbols] == sorted(s.encode() for s in symbols)


def test_table_size_is_checked(monkeypatch):
    monkeypatch.setattr(V.Vocabulary, "MAX_TOKENS", 2)
    with pytest.raises(ValueError):
        V.Vocabulary({"a": 0, "b": 1, "c": 2})
