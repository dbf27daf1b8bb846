import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import BertWordPieceTokenizer, pre_tokenizers

from maskloom.functions import text as T

ADVERSARIAL = [
    "",
    " ",
    "\x1c\x1d\x1e\x1f a b\u0085",
    " x y　",
    "\n a \n b \n",
    "a<b\nc>d",
    "a<b\rc>d and a<b c>d",
    "unclosed <b",
    '<a href="x">k</a> "q" end',
    '<abbr "z">t',
    "Ærø Århus Été Ö é é İ ẞ ΟΔΟΣ",
    "漢字かなzero​width soft­hyphen nul\x00 �",
    "$5+<=>^ ¿«q» €9 `~|",
    "w" * 100 + " " + "w" * 101,
    "[MASK] and <S> or [CLS]x[SEP] ☃",
    "it's we're  I'll   'd\t\ttabs 123abc ",
    "﷐﷔ noncharacters",
    "tail   ",
    "한국어 각가힣 ো ஔ 𝅗𝅥 𪜀漢 naïve",
    "".join(f"a{chr(c)}b " for c in [0x378, 0x890, 0x8E2, 0x13430, 0xE000, 0xF0000, 0xFFFE, 0x200B, 0xAD, 0x1FAE8]),
]


def column(frame, expression):
    return [r[0] for r in frame.orderBy("doc_id").select(expression).collect()]


def test_strip_is_python_strip(texts_frame):
    frame = texts_frame(ADVERSARIAL)
    assert column(frame, T.strip(F.col("text"))) == [s.strip() for s in ADVERSARIAL]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from(T.whitespace() + "ab.")), min_size=1, max_size=50))
def test_strip_property(texts_frame, strings):
    assert column(texts_frame(strings), T.strip(F.col("text"))) == [s.strip() for s in strings]


def test_strip_keeps_null(spark):
    frame = spark.createDataFrame([(0, None)], "doc_id long, text string")
    assert column(frame, T.strip(F.col("text"))) == [None]


def test_tags_and_links(texts_frame):
    frame = texts_frame(ADVERSARIAL)
    assert column(frame, T.remove_tags(F.col("text"))) == [re.sub("<.*?>", "", s) for s in ADVERSARIAL]
    assert column(frame, T.remove_links(F.col("text"))) == [re.sub('<a.*"', "", s) for s in ADVERSARIAL]


def test_quality(spark):
    values = [float("nan"), None, 0.9, 0.8999999, 1.0]
    frame = spark.createDataFrame(list(enumerate(values)), "doc_id long, pwa double")
    kept = frame.where(T.quality_at_least(F.col("pwa"), 0.9)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [2, 4]


def test_bert_words_equal_the_library(texts_frame, texts):
    library = BertWordPieceTokenizer()
    strings = ADVERSARIAL + texts
    want = [
        [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(s))] for s in strings
    ]
    assert column(texts_frame(strings), T.bert_words(F.col("text"))) == want


def test_bert_words_with_accents(texts_frame):
    library = BertWordPieceTokenizer(strip_accents=False)
    strings = ["Ærø Århus Été", "plain"]
    want = [
        [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(s))] for s in strings
    ]
    assert column(texts_frame(strings), T.bert_words(F.col("text"), strip_accents=False)) == want


def test_byte_level_words_equal_the_library(texts_frame, texts):
    library = pre_tokenizers.ByteLevel(add_prefix_space=False)
    strings = ADVERSARIAL + texts
    want = [[w for w, _ in library.pre_tokenize_str(s)] for s in strings]
    assert column(texts_frame(strings), T.byte_level_words(F.col("text"))) == want


def test_byte_symbols_equal_the_library():
    assert set(T.byte_symbols()) == set(pre_tokenizers.ByteLevel.alphabet())
