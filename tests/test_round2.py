"""Special tokens by place, files of the tokenizers library, keys of any type, size switches, and shipping."""

import json
import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from maskloom.functions import tokens as K
from maskloom.functions.text import SPECIAL_TOKENS
from maskloom.operators import encoding, lookup, masking, ordering, scoring, splitting, summary, windows
from maskloom.operators.vocabulary import Vocabulary
from maskloom.session import shared_dir, shipped_zip
from maskloom.sources import artifacts, tables

NAMES = [*SPECIAL_TOKENS, "a", "b", "c", "##a", "##b", "##c", "ab"]


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary({t: i for i, t in enumerate(NAMES)})


def test_masks_go_by_place(spark, vocab):
    df = spark.createDataFrame([(1, "a [SEP] b [PAD] c [CLS] a [MASK]"), (2, "")], "doc_id long, text string")
    cut = windows.token_windows(encoding.encode_wordpiece(df, vocab, special_tokens=SPECIAL_TOKENS))
    rows = {r["doc_id"]: r for r in windows.pad_static(windows.model_inputs(cut), 12).collect()}
    assert rows[1]["input_ids"] == [2, 7, 3, 8, 0, 9, 2, 7, 4, 3, 0, 0]
    assert rows[1]["attention_mask"] == [1] * 10 + [0] * 2
    assert rows[1]["special_tokens_mask"] == [1, *[0] * 8, 1, 1, 1]
    assert rows[2]["attention_mask"] == [1, 1, *[0] * 10]
    padded = windows.pad_static(windows.model_inputs(cut), 12)
    masked = masking.mask_for_training(padded, ["doc_id"], len(NAMES), 0.999999, special="special_tokens_mask")
    labels = {r["doc_id"]: r["labels"] for r in masked.collect()}
    assert labels[1] == [-100, 7, 3, 8, 0, 9, 2, 7, 4, -100, -100, -100]
    assert set(labels[2]) == {-100}
    plan = masking.mask_plan(padded, ["doc_id"], len(NAMES), 0.999999, special="special_tokens_mask")
    assert sorted(r["pos"] for r in plan.where("doc_id = 1").collect()) == list(range(1, 9))
    rates = masking.mask_rates(padded, ["doc_id"], 0.999999, special="special_tokens_mask").first()
    assert rates["n_maskable"] == rates["n_chosen"] == 8


def test_special_ids_come_from_the_vocabulary(spark):
    other = Vocabulary({t: i for i, t in enumerate(["a", "b", "[MASK]", "[SEP]", "[CLS]", "[UNK]", "[PAD]"])})
    specials = K.Specials.of(other.tokens)
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    cut = windows.token_windows(encoding.encode_wordpiece(df, other), specials=specials)
    assert windows.pad_static(cut, 6, specials=specials).first()["input_ids"] == [4, 0, 1, 3, 6, 6]
    expanded = masking.expand_masks(cut, ["doc_id"], specials=specials).orderBy("pos").collect()
    assert [r["masked_ids"] for r in expanded] == [[4, 2, 1, 3], [4, 0, 2, 3]]


def test_wordpiece_file_opens_in_the_library(spark, vocab, tmp_path):
    artifacts.save_tokenizer_files(vocab, str(tmp_path))
    library = Tokenizer(models.WordPiece.from_file(f"{tmp_path}/vocab.txt", unk_token="[UNK]"))
    library.pre_tokenizer = pre_tokenizers.Whitespace()
    again = artifacts.load_wordpiece_file(f"{tmp_path}/vocab.txt")
    assert again.tokens == vocab.tokens
    df = spark.createDataFrame([(1, "abc ab cab d ba")], "doc_id long, text string")
    assert encoding.encode_wordpiece(df, again).first()["ids"] == library.encode("abc ab cab d ba").ids


def test_byte_level_files_open_in_the_library(spark, tmp_path):
    letters = pre_tokenizers.ByteLevel.alphabet()
    names = [*SPECIAL_TOKENS, *sorted(letters), "th", "Ġth", "Ġthe"]
    merges = [("t", "h"), ("Ġ", "th"), ("Ġth", "e")]
    vocab = Vocabulary({t: i for i, t in enumerate(names)}, merges)
    artifacts.save_tokenizer_files(vocab, str(tmp_path))
    library = Tokenizer(models.BPE.from_file(f"{tmp_path}/vocab.json", f"{tmp_path}/merges.txt"))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    again = artifacts.load_byte_level_files(f"{tmp_path}/vocab.json", f"{tmp_path}/merges.txt")
    assert again.tokens == vocab.tokens and again.merges == merges
    text = "the thé then  Théthe"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert encoding.encode_byte_level(df, again).first()["ids"] == library.encode(text).ids


def test_words_by_joins_agree(spark, vocab):
    words = [(w, 1) for w in ("a", "ab", "abc", "cab", "dad", "", "a" * 100, "a" * 101)]
    counts = spark.createDataFrame(words, "word string, cnt long").groupBy("word").agg(F.sum("cnt").alias("cnt"))
    one = {r["word"]: r["ids"] for r in encoding.encode_words(counts, vocab).collect() if r["word"]}
    two = {r["word"]: r["ids"] for r in encoding.encode_words_by_joins(counts, vocab).collect() if r["word"]}
    assert one == two
    short = {r["word"]: r["ids"] for r in encoding.encode_words(counts, vocab, longest_word=2).collect()}
    assert short["ab"] == one["ab"] and short["abc"] == [1]


def test_byte_level_word_of_many_letters_is_quick():
    tokens = {"a": 0, "aa": 1, "aaaa": 2}
    merges = encoding.merge_table([(0, 0, 1), (1, 1, 2)])
    start = time.perf_counter()
    assert encoding.byte_level_ids("a" * 100_000, tokens, merges) == [2] * 25_000
    assert time.perf_counter() - start < 5


def test_too_many_merges_raise(spark, monkeypatch):
    vocab = Vocabulary({t: i for i, t in enumerate("abcdefg")}, [("a", "b")] * 5)
    tables_ = vocab.token_table(spark), vocab.merge_table(spark)
    monkeypatch.setattr(Vocabulary, "MAX_TOKENS", 5)
    with pytest.raises(ValueError):
        Vocabulary.from_tables(tables_[0].limit(3), tables_[1].union(tables_[1]))


def test_quantiles_are_the_same_number_by_both_ways(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.sin("id") * 100).alias("v"))
    shares = [0.1, 0.25, 0.5, 0.75, 0.99]
    one = summary.exact_quantiles(df, ["g"], "v", shares)
    two = summary.exact_quantiles(df, ["g"], "v", shares, buckets=32, max_values=0)
    assert sorted(map(tuple, one.select("g", "share", "value").collect())) == sorted(
        map(tuple, two.select("g", "share", "value").collect())
    )


def test_lookup_refuses_a_table_that_repeats_keys(spark):
    facts = spark.createDataFrame([(i, 0) for i in range(50)], "row long, key long")
    table = spark.createDataFrame([(0, float(i)) for i in range(9)], "key long, value double")
    with pytest.raises(ValueError):
        lookup.lookup(facts, table, ["key"], share=0.5, max_broadcast=0).collect()


@pytest.mark.parametrize("kind", ["string", "double", "date", "long"])
def test_dense_index_of_any_key(spark, kind):
    numbers = spark.range(3000).select((F.col("id") * 37 % 3001).alias("n"))
    key = {
        "string": F.concat(F.lit("k"), F.col("n").cast("string")),
        "double": F.col("n") / 7,
        "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("n").cast("int")),
        "long": F.col("n"),
    }[kind]
    df = numbers.select(key.alias("key"))
    keys = sorted(r["key"] for r in df.collect())
    for buckets in (None, 7, 700):
        got = {r["key"]: r["idx"] for r in ordering.dense_index(df, "key", buckets=buckets).collect()}
        assert [got[k] for k in keys] == list(range(3000))


def test_exact_split_with_small_border(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    whole = splitting.exact_split(df, "k", 0.3, 5).where("split = 'test'").collect()
    column = splitting._first_by_draw(df, "k", 5, 0.3, "ROUND_CEILING", digits=1, most=2)
    assert sorted(r["k"] for r in df.where(column).collect()) == sorted(r["k"] for r in whole)
    assert len(whole) == 1500


def test_perplexity_in_one_shuffle_agrees(spark):
    rows = [(t, p, (p * 7 % 5) / 3.0, n) for t, n in enumerate([1, 3, 4, 5, 9]) for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "t long, pos int, loss double, n int")
    one = {r["t"]: (round(r["ppl"], 9), r["n_tokens"]) for r in scoring.pseudo_perplexity(df, ["t"]).collect()}
    two = scoring.pseudo_perplexity(df.drop("n"), ["t"]).collect()
    assert one == {r["t"]: (round(r["ppl"], 9), r["n_tokens"]) for r in two}


def test_statistics_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("m1", "s", "mean", 1.5), ("m1", "s", "std", None), ("m2", "s", "mean", 2.0)],
        "model string, sample string, stat string, value double",
    )
    assert tables.write_statistics_files(df, str(tmp_path)) == ["m1_s_stats.csv", "m2_s_stats.csv"]
    assert Path(f"{tmp_path}/m1_s_stats.csv").read_text() == "stat,value\nmean,1.5\nstd,\n"


def test_explode_results_of_null_and_broken_json(spark):
    long = "x" * 60_000
    good = json.dumps({"model": "m", "results": {long: {"ppl": 2.0}, "b": {"ppl": 1.0}}})
    df = spark.createDataFrame([(1, good), (2, None)], "id long, json string")
    rows = tables.explode_results(df, "json").collect()
    assert {(r["id"], r["text"], r["ppl"]) for r in rows} == {(1, long, 2.0), (1, "b", 1.0)}
    with pytest.raises(Exception):
        tables.explode_results(spark.createDataFrame([(1, "{")], "id long, json string"), "json").collect()


def test_shared_dir_of_a_local_session(spark):
    assert shared_dir(spark)


def test_package_is_shipped_to_workers(tmp_path):
    """From another folder, with no path set, workers import the package from the shipped zip."""
    with shipped_zip() as archive:
        script = f"""
import sys
sys.path.insert(0, {archive!r})
from maskloom.session import build_session
from maskloom.operators import encoding
from maskloom.operators.vocabulary import Vocabulary
assert encoding.__file__.startswith({archive!r})
spark = build_session("ship", "local[2]")
spark.sparkContext.addPyFile({archive!r})
vocab = Vocabulary({{t: i for i, t in enumerate({NAMES!r})}})
df = spark.createDataFrame([(1, "ab c")], "doc_id long, text string")
print("IDS", encoding.encode_wordpiece(df, vocab).first()["ids"])
"""
        env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
        env |= {k: v for k, v in os.environ.items() if k.startswith(("JAVA", "SPARK"))}
        run = subprocess.run(
            [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
        )
    assert "IDS [13, 9]" in run.stdout, run.stderr[-2000:]
