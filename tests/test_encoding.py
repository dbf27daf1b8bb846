import pytest
from pyspark.sql import functions as F
from test_text import ADVERSARIAL
from tokenizers import AddedToken, BertWordPieceTokenizer, ByteLevelBPETokenizer

from maskloom.functions import text as T
from maskloom.operators import encoding as E
from maskloom.operators import vocabulary as V
from maskloom.operators import windows as W


@pytest.fixture(scope="module")
def vocab(documents):
    counts = V.word_counts(documents, T.bert_words(F.col("text")))
    return V.basic_vocabulary(counts, 500, 100, ("q", "z"))


@pytest.fixture(scope="module")
def library(vocab):
    made = BertWordPieceTokenizer(vocab.tokens)
    made.add_special_tokens(T.SPECIAL_TOKENS)
    return made


def ids_of(frame, name="ids"):
    return [r[name] for r in frame.orderBy("doc_id").collect()]


def test_wordpiece_equals_the_library(texts_frame, texts, vocab, library):
    strings = ADVERSARIAL + texts
    want = [e.ids for e in library.encode_batch(strings, add_special_tokens=False)]
    assert ids_of(E.encode_wordpiece(texts_frame(strings), vocab, special_tokens=T.SPECIAL_TOKENS)) == want


def test_only_reloaded_specials_by_default(texts_frame, vocab):
    [ids] = ids_of(E.encode_wordpiece(texts_frame(["[MASK] <S>"]), vocab))
    assert ids[0] == vocab.tokens["[MASK]"] and vocab.tokens["<S>"] not in ids


def test_null_text_has_no_tokens(spark, vocab):
    frame = spark.createDataFrame([(0, None), (1, "the")], "doc_id long, text string")
    assert ids_of(E.encode_wordpiece(frame, vocab))[0] == []


def test_joins_give_the_same_ids(spark, documents, vocab):
    extra = spark.createDataFrame([("w" * 100,), ("w" * 101,), ("qqq",), ("☃",)], "word string")
    counts = V.word_counts(documents, T.bert_words(F.col("text"))).unionByName(extra.withColumn("cnt", F.lit(1)))
    joined = {r["word"]: r["ids"] for r in E.encode_words(counts, vocab).collect()}
    longest = vocab.longest_piece
    assert joined == {w: E.wordpiece_ids(w, vocab.tokens, longest) for w in joined}
    assert len(joined) == counts.count()


def test_byte_level_equals_the_library(texts_frame, texts, documents):
    vocab = V.train_byte_level(documents, 380)
    library = ByteLevelBPETokenizer(vocab.tokens, vocab.merges)
    library.add_special_tokens([AddedToken(t, special=True) for t in T.SPECIAL_TOKENS])
    strings = [s for s in ADVERSARIAL if s] + texts[:80]
    want = [e.ids for e in library.encode_batch(strings)]
    frame = texts_frame(strings)
    assert ids_of(E.encode_byte_level(frame, vocab)) == want
    sides = E.compare_tokens(frame.where("doc_id = 3"), "doc_id", V.Vocabulary({**vocab.tokens}), vocab).first()
    assert sides["byte_level_tokens"].split(" ") == library.encode(strings[3]).tokens
    rate = E.unknown_rate(E.encode_byte_level(frame.where("text not like '%[UNK]%'"), vocab), vocab).first()
    assert rate["n_unknown"] == 0 and rate["oov_percent"] == 0.0


def test_unknown_rate_of_nothing_is_null(texts_frame, vocab):
    row = E.unknown_rate(E.encode_wordpiece(texts_frame(["", " "]), vocab), vocab).first()
    assert tuple(row) == (0, 0, None)


def test_windows_equal_the_library(texts_frame, texts, vocab, library):
    library.enable_truncation(64, stride=32)
    want = []
    for doc, encoded in enumerate(library.encode_batch(texts)):
        want += [(doc, win, e.ids) for win, e in enumerate([encoded, *encoded.overflowing])]
    library.no_truncation()
    encoded = E.encode_wordpiece(texts_frame(texts), vocab, special_tokens=T.SPECIAL_TOKENS)
    rows = W.token_windows(encoded, max_length=64, overlap=32).orderBy("doc_id", "win").collect()
    assert [(r["doc_id"], r["win"], r["input_ids"]) for r in rows] == want


def test_memory_is_emptied(texts_frame, texts, vocab, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "MEMORY", 1)
    import pyarrow as pa

    batches = [pa.record_batch({"w": pa.array([[w, "a"]])}) for w in ("a", "b", "c", "d")]
    list(E._encode_batches(iter(batches), "w", "ids", lambda w: seen.append(w) or [1]))
    assert seen.count("a") > 1
