"""Texts cut at blanks only, and bounded arrays: the same results as word by word."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from maskloom.functions import text as T
from maskloom.operators import encoding
from maskloom.operators import vocabulary as V

ODD = ["\t", "\n", "\r", "\x0b", "\x1c", "\x7f", "\xa0", "\xad", "İ", "ǆ", "ɏ", "ɐ", "Σ", "́", "한", "漢", "", "　"]


def _texts():
    random.seed(3)
    plain = [chr(c) for c in range(0x20, 0x7F)] + ["É", "ß", "ñ", "¿", "«", "½"] + [" "] * 20 + T.SPECIAL_TOKENS * 2
    texts = ["".join(random.choices(plain, k=30)) for _ in range(300)]
    return texts + ["".join(random.choices(plain + ODD * 3, k=30)) for _ in range(300)] + ["", " ", None]


def test_pieces_have_the_words_of_the_text(texts_frame):
    df = texts_frame(_texts())
    for options in ({}, {"special_tokens": T.SPECIAL_TOKENS}, {"lowercase": False}, {"strip_accents": False}):
        split = T.words_of_piece(**{k: v for k, v in options.items() if k != "special_tokens"})
        words, pieces = T.bert_words(F.col("text"), **options), T.bert_pieces(F.col("text"), **options)
        for row in df.select("text", words.alias("w"), pieces.alias("p")).collect():
            got = None if row["p"] is None else [w for piece in row["p"] for w in split(piece)]
            assert got == row["w"], row["text"]
    plain = df.where(T.is_plain(F.col("text"))).select(T.bert_pieces(F.col("text")).alias("p")).collect()
    assert len(plain) > 250 and all(" " not in piece for row in plain for piece in row["p"])


def test_words_counted_by_pieces(texts_frame):
    df = texts_frame(_texts() * 2)
    want = V.word_counts(df, T.bert_words(F.col("text"))).collect()
    assert sorted(V.bert_word_counts(df).collect()) == sorted(want)


def test_encoder_holds_few_rows_at_a_time():
    words = pa.array([["a", "b"], [], None, ["ab"]] * 400, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1600)), words], names=["k", "_words"])
    known = {"a": [1], "b": [2, 3], "ab": []}
    parts = list(encoding._encode_batches(iter([batch]), "_words", "ids", known.__getitem__))
    assert max(p.num_rows for p in parts) <= 500
    assert [x for p in parts for x in p.column("ids").to_pylist()] == [[1, 2, 3], [], [], []] * 400


def test_longest_match_with_short_continuations():
    tokens = {t: i for i, t in enumerate(["[UNK]", "ab", "abcd", "##b", "##cd", "a", "##e"])}
    encode = encoding.wordpiece_encoder(tokens, 4)
    assert [encode(w) for w in ("abcde", "abb", "abcdx", "", "a" * 101)] == [[2, 6], [1, 3], [0], [0], [0]]
