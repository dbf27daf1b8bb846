import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskloom.operators import lookup as L
from maskloom.operators import masking as M
from maskloom.operators import scoring as S
from maskloom.operators import summary


@pytest.fixture(scope="module")
def windows(spark):
    rows = [(n, [2, *[10 + (k * k + n) % 7 for k in range(n)], 3]) for n in (0, 1, 3, 4, 5, 9, 60)]
    return spark.createDataFrame(rows, "doc_id long, input_ids array<int>")


def brute_losses(windows, alpha, size):
    pairs = Counter()
    for _, ids in windows:
        pairs.update(zip(ids[:-2], ids[1:-1]))
    context = Counter()
    for (prev, _), n in pairs.items():
        context[prev] += n
    return {
        (doc, pos): -math.log((pairs[ids[pos - 1], ids[pos]] + alpha) / (context[ids[pos - 1]] + alpha * size))
        for doc, ids in windows
        for pos in range(1, len(ids) - 1)
    }


def test_losses_and_perplexities(windows):
    rows = [tuple(r) for r in windows.collect()]
    want = brute_losses(rows, 0.5, 20)
    positions = S.bigrams(windows, ["doc_id"])
    losses = S.bigram_losses(positions, S.bigram_counts(windows), 20, 0.5, share=0.2, max_broadcast=0).cache()
    got = {(r["doc_id"], r["pos"]): r["loss"] for r in losses.collect()}
    assert got == pytest.approx(want)
    texts = S.score_all(windows, S.pseudo_perplexity(losses, ["doc_id"], "token"), ["doc_id"])
    tokens = {r["doc_id"]: r["ppl"] for r in texts.collect()}
    batches = {r["doc_id"]: r["ppl"] for r in S.pseudo_perplexity(losses, ["doc_id"], "batch").collect()}
    assert tokens[0] is None and 0 not in batches
    for doc in (1, 3, 4, 5, 9, 60):
        mine = [want[doc, pos] for pos in range(1, doc + 1)]
        assert tokens[doc] == pytest.approx(math.exp(np.mean(mine)))
        runs = [np.mean(mine[i : i + 4]) for i in range(0, doc, 4)]
        assert batches[doc] == pytest.approx(math.exp(np.mean(runs)))
    assert tokens[5] != pytest.approx(batches[5]) and tokens[4] == pytest.approx(batches[4])
    with pytest.raises(ValueError):
        S.pseudo_perplexity(losses, ["doc_id"], "other")


def test_corpus_perplexity(windows):
    rows = [tuple(r) for r in windows.collect()]
    want = np.mean(list(brute_losses(rows, 1.0, 20).values()))
    pairs = S.bigram_counts(windows.withColumn("split", F.lit("a")), ["split"])
    row = S.corpus_perplexity(pairs, S.bigram_counts(windows), 20).first()
    assert row["eval_loss"] == pytest.approx(want) and row["perplexity"] == pytest.approx(math.exp(want))


def test_models_in_one_pass(windows):
    positions = S.bigrams(windows, ["doc_id"])
    counts = S.bigram_counts(windows)
    both = S.model_losses(positions, counts, 20, {"a-0.5": 0.5, "b": 2.0})
    for name, alpha in (("a-0.5", 0.5), ("b", 2.0)):
        alone = S.bigram_losses(positions, counts, 20, alpha)
        mine = both.where(F.col("model") == name)
        assert {tuple(r) for r in mine.select("doc_id", "pos", "loss").collect()} == {
            tuple(r) for r in alone.select("doc_id", "pos", "loss").collect()
        }


def test_own_scorer(windows):
    def make():
        return lambda batch: pd.Series(batch["label"] + batch["masked_ids"].map(len)).astype(float)

    expanded = M.expand_masks(windows, ["doc_id"])
    got = {(r["doc_id"], r["pos"]): r["loss"] for r in S.score_with(expanded, ["doc_id"], make).collect()}
    ids = dict(tuple(r) for r in windows.collect())
    assert got == {(d, p): i[p] + len(i) for d, i in ids.items() for p in range(1, len(i) - 1)}


@pytest.mark.parametrize("share, small", [(1.0, 0), (0.1, 0), (0.001, 0), (0.1, 2000)])
def test_lookup_with_heavy_keys(spark, share, small):
    """A third of all rows has one key; another heavy key and some light ones have no match."""
    keys = [0] * 1000 + [1] * 500 + [-1] * 500 + list(range(2, 1000)) + list(range(5000, 5010))
    facts = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "row long, key long")
    table = spark.createDataFrame([(k, k * 1.5) for k in range(1000)], "key long, value double")
    got = {r["row"]: r["value"] for r in L.lookup(facts, table, ["key"], share, small).collect()}
    assert got == {i: (k * 1.5 if 0 <= k < 1000 else None) for i, k in enumerate(keys)}


def test_semi_lookup(spark):
    df, chosen = spark.range(100), spark.createDataFrame([(3,), (50,)], "id long")
    for rows in (1, 10):
        assert sorted(r["id"] for r in L.semi_lookup(df, chosen, ["id"], rows).collect()) == [3, 50]


@pytest.mark.parametrize("buckets, small", [(2, 0), (16, 0), (256, 0), (256, 10_000)])
def test_exact_quantiles(spark, buckets, small):
    rng = np.random.default_rng(7)
    groups = {
        "skewed": [5.0] * 400 + rng.exponential(3.0, 601).tolist(),
        "same": [2.5] * 50,
        "one": [-1.0],
        "even": list(map(float, range(1000))),
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    shares = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    quantiles = summary.exact_quantiles(df, ["g"], "v", shares, buckets, small)
    got = {(r["g"], r["share"]): r["value"] for r in quantiles.collect()}
    want = {(g, s): np.quantile(vs, s) for g, vs in groups.items() for s in shares}
    assert got == pytest.approx(want)


def test_describe_equals_pandas(spark):
    values = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6]
    df = spark.createDataFrame([("m", "s", v) for v in values] + [("m", "s", None)], "model string, sample string, ppl double")
    got = {r["stat"]: r["value"] for r in summary.describe(df, ["model", "sample"], "ppl").collect()}
    want = pd.Series(values).describe().to_dict() | {"median": pd.Series(values).median()}
    assert got == pytest.approx(want) and set(got) == set(summary.DESCRIBE)


def test_length_statistics(spark):
    lengths = [2, 5, 5, 9, 100, 3]
    df = spark.createDataFrame([("a", n) for n in lengths], "split string, n int")
    row = summary.length_statistics(df, ["split"], F.col("n")).first()
    assert (row["min"], row["max"], row["n"]) == (2, 100, 6)
    assert row["mean"] == pytest.approx(np.mean(lengths)) and row["median"] == np.median(lengths)
    assert row["percentile_95"] == pytest.approx(np.percentile(lengths, 95))


def test_compare_models(spark):
    rows = [("s", 1, "a", 2.0), ("s", 1, "b", 1.0), ("s", 2, "a", 3.0), ("s", 2, "b", 3.0), ("s", 3, "a", None)]
    df = spark.createDataFrame(rows, "sample string, item int, model string, ppl double")
    got = {r["model"]: (r["n_texts"], r["wins"]) for r in summary.compare_models(df, ["sample", "item"]).collect()}
    assert got == {"a": (2, 1), "b": (2, 1)}
    expected = df.select("item").distinct()
    missing = summary.missing_results(expected, df.where("ppl is not null"), ["item"]).collect()
    assert [r["item"] for r in missing] == [3]
