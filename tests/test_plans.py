"""What the plans must look like to hold on large data."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from maskloom.functions import text as T
from maskloom.operators import audit, cleaning, encoding, masking, scoring, splitting, summary, windows
from maskloom.operators import vocabulary as V
from maskloom.plans import recipes


@pytest.fixture(scope="module")
def scan(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def vocab():
    names = [*T.SPECIAL_TOKENS, *"abc", *["##" + c for c in "abc"]]
    return V.Vocabulary({t: i for i, t in enumerate(names)})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"\bExchange (?:hash|range|Round|Single)", plan(df)))


def test_current_recipe_shuffles_nothing(scan, vocab):
    docs = scan.withColumn("pwa", F.col("n_chars") / 10000.0)
    made = masking.mask_for_training(recipes.current_windows(docs, vocab), ["doc_id", "win"], len(vocab))
    assert shuffles(made) == 0
    assert plan(made).count("MapInArrow") == 1


def test_legacy_recipe_shuffles_nothing_and_reads_two_columns(scan, vocab):
    made = recipes.legacy_windows(scan, vocab, ["lang", "source", "n_chars"])
    assert shuffles(made) == 0
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(made)


def test_quality_filter_reaches_the_scan(spark, tmp_path, scan):
    scan.select("doc_id", (F.col("n_chars") / 1000.0).alias("pwa")).write.parquet(str(tmp_path / "t"))
    text = plan(cleaning.quality_filter(spark.read.parquet(str(tmp_path / "t"))))
    assert "GreaterThanOrEqual(pwa,0.9)" in text


@pytest.mark.parametrize(
    "make",
    [
        lambda d: cleaning.distinct_text(d, "doc_id"),
        lambda d: audit.shared_text(splitting.threshold_split(d, "doc_id", test_size=0.1, seed=666)),
        lambda d: V.word_counts(d, T.bert_words(F.col("text"))),
        lambda d: summary.length_statistics(d.withColumn("split", F.lit("a")), ["split"], F.length("text")),
    ],
)
def test_groups_merge_before_the_shuffle(scan, make):
    text = plan(make(scan))
    assert "partial_" in text.split("Exchange hashpartitioning")[1]


def test_distinct_words_are_shuffled_once(scan, vocab):
    counts = V.word_counts(scan, T.bert_words(F.col("text")))
    encoded = encoding.encode_words(counts, vocab)
    assert shuffles(encoded) == 1 and "MapInArrow" in plan(encoded)
    joined = encoding.encode_words_by_joins(counts, vocab)
    assert shuffles(joined) == 1 and "BroadcastHashJoin" in plan(joined)


def test_perplexity_is_shuffled_once(spark):
    losses = spark.createDataFrame([(1, 1, 0.5)], "doc_id long, pos int, loss double")
    assert shuffles(scoring.pseudo_perplexity(losses, ["doc_id"])) == 1


def test_sample_is_a_top_k(scan):
    text = plan(splitting.sample(scan, "doc_id", n=10, seed=42))
    assert "TakeOrderedAndProject" in text and shuffles(splitting.sample(scan, "doc_id", n=10, seed=42)) == 0


def test_windows_of_a_large_row_stay_in_the_jvm(spark):
    big = spark.range(1).select(F.col("id").alias("doc_id"), F.sequence(F.lit(10), F.lit(300_000)).alias("ids"))
    cut = windows.token_windows(big)
    assert cut.count() == 1 + -(-(299_991 - 510) // 254)
    assert "Python" not in plan(cut)
