"""Training in one stage: against one merge at a time, rounds as jobs, and the tokenizers library."""

from hypothesis import given, settings
from hypothesis import strategies as st
from test_vocabulary import WORDS, one_at_a_time
from tokenizers import ByteLevelBPETokenizer

import pytest

from maskloom.functions import text as T
from maskloom.operators import together
from maskloom.operators import vocabulary as V
from pyspark.sql import functions as F


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=2, max_size=9), st.integers(1, 6), min_size=1, max_size=12), st.integers(1, 30))
def test_merges_of_one_task_equal_one_at_a_time(words, most):
    want, merges = one_at_a_time(words, list("abc"), "", 3 + most, 2)
    own = together.Words()
    for word, count in words.items():
        own.add(["abc".index(c) for c in word], count)
    found, _ = together.learn_merges(own, list("abc"), [], 3 + most, 2, "", 10**6, lambda message: [message])
    names = list(want)
    assert [(names[a], names[b]) for a, b in found] == merges


@pytest.mark.parametrize("continuation", ["##", ""])
def test_training_in_legs_equals_one_merge_at_a_time(spark, continuation):
    counts = spark.createDataFrame(list(WORDS.items()), "word string, cnt long")
    chars = sorted({c for w in WORDS for c in w})
    inner = sorted({c for w in WORDS for c in w[1:]}) if continuation else []
    start = ["[UNK]", *chars, *[continuation + c for c in inner]]
    tokens, merges = one_at_a_time(WORDS, start, continuation, 45, 2)
    found = together.train(counts, 45, 2, special_tokens=["[UNK]"], continuation=continuation, leg=6)
    assert found.merges == merges
    assert found.tokens == tokens


def test_nothing_to_train(spark):
    nothing = spark.createDataFrame([], "word string, cnt long")
    assert together.train(nothing, 20, special_tokens=["[UNK]"]).tokens == {"[UNK]": 0}
    once = spark.createDataFrame([("ab", 1), (None, 3), ("", 2)], "word string, cnt long")
    assert together.train(once, 20, special_tokens=["[UNK]"]).merges == []


def test_byte_level_equals_the_library_at_full_size(documents, texts):
    library = ByteLevelBPETokenizer()
    library.train_from_iterator(
        texts, vocab_size=30_512, min_frequency=2, special_tokens=T.SPECIAL_TOKENS, show_progress=False
    )
    found = together.train_byte_level(documents, 30_512)
    assert found.tokens == library.get_vocab()
    assert found.rounds < len(found.merges) / 3


def test_wordpiece_equals_training_by_jobs(documents):
    counts = V.word_counts(documents, T.bert_words(F.col("text"))).cache()
    by_jobs, found = V.train(counts, 250), together.train(counts, 250)
    assert found.tokens == by_jobs.tokens
    assert found.merges == by_jobs.merges
