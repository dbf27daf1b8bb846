import math

import pytest
from pyspark.sql import functions as F

from maskloom.functions.draws import threshold
from maskloom.operators import audit, cleaning, splitting


def sides(df, key="doc_id"):
    return {r[key]: r["split"] for r in df.collect()}


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(2000).withColumnRenamed("id", "doc_id")


def test_thresholds():
    assert threshold(0.1).startswith("1999") and threshold(0.2).startswith("3333") and threshold(0.5) == "8" + "0" * 15


def test_threshold_split_ignores_order_and_partitions(keys):
    one = sides(splitting.threshold_split(keys.coalesce(1), "doc_id", test_size=0.1, seed=666))
    other = sides(
        splitting.threshold_split(keys.repartition(7).orderBy(F.desc("doc_id")), "doc_id", test_size=0.1, seed=666)
    )
    assert one == other
    assert 0.07 < list(one.values()).count("test") / len(one) < 0.13


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 997])
def test_exact_split_sizes(keys, n):
    some = keys.where(F.col("doc_id") < n)
    found = list(sides(splitting.exact_split(some, "doc_id", 0.2, 420)).values())
    assert found.count("test") == math.ceil(n / 5) and len(found) == n
    found = list(sides(splitting.exact_train_split(some, "doc_id", 0.8, 42)).values())
    assert found.count("train") == n * 4 // 5 and len(found) == n


def test_three_way_split_covers(keys):
    found = list(sides(splitting.three_way_split(keys, ["doc_id"], "doc_id")).values())
    assert set(found) == {"train", "validation", "test"}
    assert 0.16 < found.count("test") / len(found) < 0.24


def test_sample_is_repeatable(keys):
    first = [r["doc_id"] for r in splitting.sample(keys, "doc_id", n=50, seed=42).collect()]
    second = [r["doc_id"] for r in splitting.sample(keys.repartition(9), "doc_id", n=50, seed=42).collect()]
    assert first == second and len(set(first)) == 50


def test_sample_takes_the_smallest_draws(spark):
    """Repeated keys, null keys, more rows wanted than there are, and a border inside one prefix."""
    rows = [(i,) for i in range(3000)] + [(7,)] * 40 + [(None,)] * 3
    df = spark.createDataFrame(rows, "doc_id long").repartition(5)
    everything = [r["doc_id"] for r in splitting.sample(df, "doc_id", n=9999, seed=1).collect()]
    assert len(everything) == len(rows) and everything[:3] == [None] * 3
    for n in (0, 1, 2, 3, 4, 100, 1500, 3042):
        assert [r["doc_id"] for r in splitting.sample(df, "doc_id", n=n, seed=1).collect()] == everything[:n]
    assert splitting.sample(df.limit(0), "doc_id", n=5, seed=1).collect() == []


def test_audits(spark):
    rows = [(1, 0, "train"), (1, 1, "validation"), (2, 0, "train"), (3, 0, "test")]
    windows = spark.createDataFrame(rows, "doc_id long, win int, split string")
    assert [tuple(r) for r in audit.straddling_documents(windows).collect()] == [(1, 1, 1, 0)]
    other = spark.createDataFrame([(2, "test"), (3, "test")], "doc_id long, split string")
    assert [r["doc_id"] for r in audit.recipe_overlap(windows, other).collect()] == [2]
    copies = [(i, "same", "train" if i % 3 else "test") for i in range(300)] + [(300, "alone", "test")]
    shared = audit.shared_text(spark.createDataFrame(copies, "doc_id long, text string, split string")).collect()
    assert [(r["n_train"], r["n_validation"], r["n_test"]) for r in shared] == [(200, 0, 100)]


def test_cleaning(spark):
    rows = [(0, None), (1, "x" * 29), (2, "x" * 30), (3, " " * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cleaning.min_length(frame).collect()) == [2, 3]
    copies = spark.createDataFrame([(5, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    found = {tuple(r) for r in cleaning.distinct_text(copies, "doc_id").collect()}
    assert found == {("a", 2, 2), ("b", 3, 1)}
