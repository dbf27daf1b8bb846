"""Selection of places in heavy groups, splits by whole groups, and the trigram scorer."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.operators import audit, ngrams, scoring, selection, splitting, summary


@pytest.mark.parametrize("pieces, most", [(2, 1), (5, 3), (64, 10)])
def test_values_at_every_rank(spark, pieces, most):
    rng = np.random.default_rng(3)
    groups = {
        "wide": np.exp(rng.normal(0, 40, 300)).tolist(),
        "tied": rng.integers(0, 4, 200).astype(float).tolist(),
        None: [float("-inf"), -1e300, -0.0, 5e-324, 1.5, 1.5, float("inf")],
        "one": [7.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "_size string, v double")
    counted = df.groupBy("_size", F.col("v").alias("_v")).agg(F.count("*").alias("_n")).cache()
    wanted = [(g, k) for g, vs in groups.items() for k in {0, 1, len(vs) // 2, len(vs) - 1, len(vs)}] + [("none", 0)]
    places = spark.createDataFrame(wanted, "_size string, _rank long")
    got = {(r["_size"], r["_rank"]): r["_found"] for r in selection.values_at(counted, places, ["_size"], pieces, most).collect()}
    assert got == {(g, k): sorted(groups[g])[k] for g, k in wanted if g in groups and k < len(groups[g])}


def test_quantiles_of_light_and_heavy_groups_together(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 400 == 1, "few").otherwise("many").alias("g"),
        (F.sin("id") * 1e6).alias("v"),
    )
    shares = [0.0, 0.33, 0.5, 1.0]
    held = summary.exact_quantiles(df, ["g"], "v", shares).collect()
    mixed = summary.exact_quantiles(df, ["g"], "v", shares, 7, max_values=50).collect()
    assert len(held) == 12 and sorted(map(tuple, held), key=repr) == sorted(map(tuple, mixed), key=repr)


def test_quantiles_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert summary.exact_quantiles(df, ["g"], "v", [0.5]).collect() == []
    assert summary.exact_quantiles(df, ["g"], "v", [0.5], max_values=0).collect() == []


@pytest.mark.parametrize("histogram, wanted", [({1: 10}, 3), ({7: 1, 1: 3}, 4), ({5: 2}, 3), ({333: 1, 2: 300, 1: 67}, 200)])
def test_fitted_sizes(histogram, wanted):
    taken = splitting.fit_groups(histogram, wanted)
    rows = sum(size * count for size, count in taken.items())
    left = [size for size, count in histogram.items() if taken[size] < count]
    assert all(0 <= taken[s] <= c for s, c in histogram.items())
    assert rows <= wanted and wanted - rows < min(left)


def test_group_split_parts_no_text(spark):
    texts = ["hot"] * 400 + [f"pair {i // 2}" for i in range(200)] + [f"single {i}" for i in range(600)] + [None] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "_size long, text string")
    split = splitting.group_split(df, "text", 0.2, 42).cache()
    assert split.columns == ["_size", "text", "split"] and split.count() == len(texts)
    assert split.where("split = 'test'").count() == math.ceil(0.2 * len(texts))
    assert audit.shared_text(split).count() == 0
    again = splitting.group_split(df.repartition(5, "text"), "text", 0.2, 42)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))


def test_group_split_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert splitting.group_split(df, "text", 0.2, 42).collect() == []


VOCAB = 12


def windows_of(spark, rows):
    return spark.createDataFrame([(i, row) for i, row in enumerate(rows)], "item long, input_ids array<int>")


def some_windows(seed, n):
    rng = np.random.default_rng(seed)
    steps = [[2, *(int(x) for x in np.minimum(rng.geometric(0.3, rng.integers(0, 30)) + 3, VOCAB - 1)), 3] for _ in range(n)]
    return steps


def shares_by_hand(rows, least):
    """A share for any trigram, from the definition."""
    three = Counter((w[p - 2] if p > 1 else -1, w[p - 1], w[p]) for w in rows for p in range(1, len(w) - 1))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def off(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return ngrams.DEFAULT_DISCOUNTS
        y = n[0] / (n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        return d if all(0 <= x <= k + 1 for k, x in enumerate(d)) else ngrams.DEFAULT_DISCOUNTS

    def share(counts, gram, shorter, least=1):
        d = off(counts)
        inside = {g: v for g, v in counts.items() if g[:-1] == gram[:-1]}
        total = sum(inside.values())
        if not total:
            return shorter
        kept = {g: v - d[min(v, 3) - 1] for g, v in inside.items() if v >= least}
        return (kept.get(gram, 0) + (total - sum(kept.values())) * shorter) / total

    def both(a, b, c):
        first = share({(t,): v for t, v in one.items()}, (c,), 1 / VOCAB)
        return share(three, (a, b, c), share(two, (b, c), first), least)

    return both


@pytest.mark.parametrize("least", [1, 3])
@pytest.mark.parametrize("n", [1, 8, 60])
def test_trigram_shares_by_definition(spark, n, least):
    rows = some_windows(n, n)
    model = ngrams.train(ngrams.trigram_counts(windows_of(spark, rows)), VOCAB, least)
    contexts = [(-1, 2), (4, 4), (4, 5), (11, 4), (9, 9)]
    grams = [(a, b, c) for a, b in contexts for c in range(VOCAB)]
    got = {(r.a, r.b, r.c): math.exp(-r.loss) for r in ngrams.gram_losses(
        spark.createDataFrame(grams, "a int, b int, c int"), model).collect()}
    by_hand = shares_by_hand(rows, least)
    assert got == pytest.approx({g: by_hand(*g) for g in grams})
    for a, b in contexts:
        assert sum(got[a, b, c] for c in range(VOCAB)) == pytest.approx(1)


def test_trigrams_without_training_text(spark):
    model = ngrams.train(ngrams.trigram_counts(windows_of(spark, [[2, 3], []])), VOCAB)
    held = windows_of(spark, [[2, 5, 6, 3], [2, 3]])
    got = ngrams.losses(ngrams.trigrams(held, ["item"]), model).collect()
    assert sorted((r.item, r.pos, r.a, r.b, r.c) for r in got) == [(0, 1, -1, 2, 5), (0, 2, 2, 5, 6)]
    assert all(r.loss == pytest.approx(math.log(VOCAB)) for r in got)


def test_trigrams_beat_bigrams_on_held_out_texts(spark):
    """Each token of the train texts depends on the two before it."""
    rng = np.random.default_rng(0)

    def text():
        ids = [2, 5]
        for _ in range(40):
            ids.append(int((3 * ids[-1] + 5 * ids[-2]) % 8 + 4) if rng.random() < 0.8 else int(rng.integers(4, VOCAB)))
        return [*ids, 3]

    train, held = windows_of(spark, [text() for _ in range(80)]), windows_of(spark, [text() for _ in range(20)])
    model = ngrams.train(ngrams.trigram_counts(train), VOCAB)
    three = ngrams.losses(ngrams.trigrams(held, ["item"]), model).agg(F.avg("loss")).first()[0]
    two = scoring.bigram_losses(scoring.bigrams(held, ["item"]), scoring.bigram_counts(train), VOCAB)
    assert three < two.agg(F.avg("loss")).first()[0]
