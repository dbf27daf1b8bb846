"""Quality rules, resampling, language and toxicity, against plain Python versions and held-out labels."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskloom.llm import language, quality_rules, resampling, toxicity
from maskloom.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
WORDS = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t ", None),
        (4, "123 $$$ 456", "b"),
        (5, "a b c a b c a b c\n\na b c\na b c\n a b c", "b"),
        (6, "word " * 30_000, "a"),
        (6, "word " * 30_000, "a"),
        (None, "Ünï code ÀÉ ßß x y|z&", "b"),
        (7, "one\x0btwo\x0cthree\x85four five", "b"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return {r["doc_id"]: r for r in docs.collect()}


# Quality rules


def base(text):
    words = re.findall(WORDS, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORDS, x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_statistics(odd):
    table = quality_rules.text_statistics(odd, "text")
    assert "n_words" in table.columns and dict(table.dtypes)["n_words"] == "bigint"
    for row in table.collect():
        assert tuple(row[c] for c in quality_rules.COUNTS[:5]) == base(row["text"])
    assert quality_rules.text_statistics(odd.limit(0), "text").count() == 0


def test_rules_find_a_planted_conjunction():
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (3000, 3))
    low = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)) | (x[:, 2] > 0.95)
    rules = quality_rules.learn_rules(x, low, ["a", "b", "c"])
    covered = np.zeros(len(x), bool)
    for rule in rules:
        covered |= quality_rules._holds(x, ["a", "b", "c"], rule.conditions)
    assert (covered == low).mean() > 0.98
    assert any({c[0] for c in rule.conditions} == {"a", "b"} for rule in rules)


def test_rules_of_nothing():
    names = ["a"]
    assert quality_rules.learn_rules(np.zeros((0, 1)), np.zeros(0, bool), names) == []
    assert quality_rules.learn_rules(np.ones((50, 1)), np.ones(50, bool), names) == []
    assert quality_rules.learn_rules(np.arange(50.0)[:, None], np.zeros(50, bool), names) == []


def test_verdict_is_the_first_rule_that_holds(spark):
    rules = [
        quality_rules.Rule((("symbols_per_word", ">", 0.5), ("repeat_share", "<=", 0.5)), 9, 0),
        quality_rules.Rule((("symbols_per_word", ">", 0.2),), 9, 0),
    ]
    rows = [(10, 6, 0), (10, 6, 9), (10, 3, 0), (10, 0, 0), (0, 0, 0)]
    df = spark.createDataFrame(rows, "n_words long, n_symbols long, n_repeat_words long")
    for column in quality_rules.COUNTS:
        if column not in df.columns:
            df = df.withColumn(column, F.lit(0))
    assert [r[0] for r in df.select(quality_rules.verdict(rules)).collect()] == [1, 2, 2, 0, 0]
    assert df.select(quality_rules.verdict([])).distinct().collect()[0][0] == 0
    assert str(rules[0]) == "symbols_per_word > 0.5 and repeat_share <= 0.5"


def test_quality_query(spark):
    known = labelled(spark, MIDDLE)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = REGISTRY["op1_quality_rules"](spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    good = bad = 0
    for row in rows:
        found = base(docs[row["doc_id"]])
        assert tuple(row[c] for c in quality_rules.COUNTS[:5]) == found
        assert row["base_failed"] == (found[0] < 50 or 100 * found[4] > 50 * found[0])
        assert not (row["base_failed"] and row["kept"])
        if row["doc_id"] in known and not row["base_failed"]:
            quality = known[row["doc_id"]]["quality"]
            good += quality == 1 and not row["kept"]
            bad += quality == 0 and row["kept"]
    assert good <= 3 and bad <= 3


# Resampling


def test_take_largest_with_ties(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=2000) * 20) / 10
    rows = [(i % 700, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, v double")
    for k in (0, 1, 500, 1999, 2000, 5000):
        got = resampling.take_largest(df, "v", "id", k).where("sampled").collect()
        order = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        # rows that are equal in value and key go together
        assert len(got) >= min(k, 2000) and set(order) == {(r["id"], r["v"]) for r in got}
        assert len(got) <= min(k, 2000) + 5
    same = spark.createDataFrame([(i, 1.5) for i in range(50)], "id long, v double")
    assert [r["id"] for r in resampling.take_largest(same, "v", "id", 7).where("sampled").orderBy("id").collect()] == list(
        range(7)
    )


def test_weights_follow_the_target(spark):
    rows = [(i, "good fine text", True) for i in range(30)] + [(100 + i, "bad junk noise", False) for i in range(30)]
    df = spark.createDataFrame([*rows, (1000, None, False), (1001, "", None)], "id long, text string, t boolean")
    weights = resampling.learn_weights(df, "text", F.col("t"))
    got = {r["id"]: r["log_weight"] for r in resampling.weigh(df, "text", weights).collect()}
    assert got[0] > 0 > got[100] and got[1000] == got[1001] == 0
    assert not resampling.learn_weights(df, "text", F.lit(False)).any()
    assert resampling.weigh(df.limit(0), "text", weights).count() == 0


def test_gumbel_sample_follows_the_weights(spark):
    # of two rows the one with weight w is drawn first with the chance w / (w + 1)
    pairs = spark.range(4000).select(
        "id", (resampling.gumbel("id", 1) + math.log(3.0) > resampling.gumbel("id", 2)).alias("first")
    )
    share = pairs.agg(F.avg(F.col("first").cast("double"))).first()[0]
    assert abs(share - 0.75) < 0.03


def test_classifier_query(spark):
    known = labelled(spark, MIDDLE)
    rows = REGISTRY["op4_quality_classifier"](spark, MIDDLE).collect()
    assert len(rows) == 1000
    share = sum(r["quality"] for r in known.values()) / len(known)
    assert sum(r["sampled"] for r in rows) == round(1000 * share)
    kept = {r["doc_id"]: r["kept"] for r in rows}
    good = [kept[d] for d, r in known.items() if r["quality"] == 1]
    low = [kept[d] for d, r in known.items() if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(low) < 0.2
    border = min(r["gumbel_key"] for r in rows if r["sampled"])
    assert all(r["gumbel_key"] <= border for r in rows if not r["sampled"])


# Language


def plain_ngrams(text):
    counts = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for size in language.SIZES:
            for i in range(len(padded) - size + 1):
                gram = padded[i : i + size]
                if gram.strip():
                    counts[gram] = counts.get(gram, 0) + 1
    return counts


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab Éß漢.1\n", max_size=30))
def test_ngrams_equal_plain_version(text):
    grams, counts = language.ngrams(text)
    got = {}
    for gram, n in zip(grams.tolist(), counts.tolist()):
        letters = []
        while gram:
            letters.append(chr(gram & 0xFFFF))
            gram >>= 16
        got["".join(reversed(letters))] = n
    assert got == plain_ngrams(text)


def test_language_defined_cases(spark, odd):
    docs = spark.createDataFrame(
        [(1, "le la les des une", "fr"), (2, "the and of it is", "en"), (3, "none", None), (None, "the of", "en")],
        "doc_id long, text string, lang string",
    )
    profiles = language.learn_profiles(docs, "doc_id", "text", "lang")
    assert sorted(profiles) == ["en", "fr"]
    rows = language.identify(odd.withColumn("score", F.lit("x")), "text", profiles).collect()
    for row in rows:
        assert 0 <= row["score"] <= 1
        assert (row["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", row["text"] or ""))
    assert language.learn_profiles(docs.limit(0), "doc_id", "text", "lang") == {}
    assert {r["lang_pred"] for r in language.identify(docs, "text", {}).collect()} == {"und"}
    only = language.identify(docs, "text", {"en": profiles["en"]}).collect()
    assert {r["lang_pred"] for r in only} == {"en"} and all(0 <= r["score"] <= 1 for r in only)


def test_profiles_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = language.learn_profiles(docs.coalesce(1), "doc_id", "text", "lang", 50)
    assert one == language.learn_profiles(docs.repartition(7), "doc_id", "text", "lang", 50)


def test_language_query_on_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = [r for r in REGISTRY["op6_language_id"](spark, MIDDLE).collect() if r["held_out"]]
    assert len(rows) > 200
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows]) > 0.97


# Toxicity


def all_maximal(scores):
    """Maximal scoring segments by definition: take the best, then search left and right of it."""
    best, at = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-9:
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    left = all_maximal(scores[:a])
    right = [(x + b, y + b, s) for x, y, s in all_maximal(scores[b:])]
    return [*left, (a, b, best), *right]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-7, 6), max_size=14))
def test_segments_equal_definition(values):
    # no ties: the definition leaves open which of equal segments is the maximal one
    scores = np.array(values, float) + np.arange(1, len(values) + 1) * 0.0137
    got = toxicity.segments(scores)
    want = all_maximal(scores.tolist())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_defined_cases(spark, odd):
    rows = [(i, "you are a vile gronk today my friend", 1) for i in range(20)]
    rows += [(100 + i, "you are a good helper today my friend", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, docs, "doc_id", "text", "toxic")
    got = toxicity.score(odd.withColumn("score", F.lit("x")), "text", model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] < 0.5 for r in got)
    texts = spark.createDataFrame([("what a vile gronk",), ("gronkish gronks",), ("a good day",)], "text string")
    scores = [r["score"] for r in toxicity.score(texts, "text", model).collect()]
    assert scores[0] > 0.5 and scores[1] > 0.5 > scores[2]
    found = toxicity.score(texts, "text", model).first()["segments"]
    assert [(s["start"], s["end"]) for s in found] == [(2, 4)]
    for labels in (docs.limit(0), docs.where("toxic = 0"), docs.where("toxic = 1")):
        none = toxicity.learn(docs, labels, "doc_id", "text", "toxic")
        assert all(r["score"] < 0.5 for r in toxicity.score(docs, "text", none).collect())


def test_toxicity_finds_late_and_repeated_passages(spark):
    rows = [(i, "you are a vile gronk today my friend", 1) for i in range(20)]
    rows += [(100 + i, "you are a good helper today my friend", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, docs, "doc_id", "text", "toxic")
    calm, passage = ["good", "helper"] * 5_000, ["vile", "gronk"] * 8
    late = ([*calm, "vile", *calm, "gronk"] * 3) + calm + passage
    often = [*passage, *calm] * 6
    texts = spark.createDataFrame([(" ".join(late),), (" ".join(often),), (" ".join(passage + calm),)], "text string")
    got = toxicity.score(texts, "text", model).collect()
    ends = [(s["start"], s["end"]) for s in got[0]["segments"]]
    assert (len(late) - len(passage), len(late)) in ends and got[0]["score"] > 0.5
    places = [i * (len(passage) + len(calm)) for i in range(6)]
    assert [(s["start"], s["end"]) for s in got[1]["segments"]] == [(i, i + len(passage)) for i in places]
    # repeats are found, and tell nothing new: only the length of the text differs
    assert 0 < got[1]["evidence"] <= got[2]["evidence"]


def test_toxicity_query_on_held_out(spark):
    known = labelled(spark, MIDDLE)
    rows = [r for r in REGISTRY["op7_toxicity"](spark, MIDDLE).collect() if r["doc_id"] in known]
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50
    assert np.mean([r["predicted"] == known[r["doc_id"]]["toxic"] for r in held]) > 0.93
    clean = [r["predicted"] for r in rows if known[r["doc_id"]]["toxic"] == 0]
    assert np.mean(clean) < 0.02
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
