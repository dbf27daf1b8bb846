"""Names that operators use themselves as extra columns, exact sample sizes, bands that follow the similarity."""

import random

import pytest
from pyspark.sql import functions as F

from maskloom.llm import near_dups, packing, resampling

OWN = ["id", "row", "text", "_id", "_component", "root", "sketch", "bands", "first", "_turn", "_of"]


def copies():
    rng = random.Random(8)
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(90)]
        for copy in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(copy // 3):
                words[rng.randrange(90)] = f"x{rng.randrange(5000)}"
            rows.append((rng.randrange(10**6), " ".join(words)))
    hot = " ".join(f"h{i}" for i in range(40))
    rows += [(2_000_000 + i, hot) for i in range(300)]
    rows += [(2_000_000, hot)] * 200 + [(None, hot)] * 3 + [(3_000_000, None), (3_000_001, "")]
    return rows


def test_own_names_as_extra_columns(spark):
    rows = copies()
    df = spark.createDataFrame(rows, "`a.key` long, words string")
    wide = df.select("*", *[F.lit(f"mine {c}").alias(c) for c in OWN])
    plain = near_dups.near_duplicates(df, "a.key", "words").drop("node", "root").collect()
    found = near_dups.near_duplicates(wide, "a.key", "words", keep=wide.columns)
    assert {"id", "row", "_id", "_component", "sketch"} <= set(found.columns)
    assert all(r["_id"] == "mine _id" and r["sketch"] == "mine sketch" for r in found.collect())
    pairs = [(r["a.key"], r["n_shingles"], r["component_id"]) for r in found.collect()]
    assert sorted(pairs, key=repr) == sorted(map(tuple, plain), key=repr)
    kept = near_dups.one_of_each(found, "a.key")
    distinct = near_dups.distinct_documents(wide, "a.key", "words")
    assert distinct.columns == wide.columns and all(r["root"] == "mine root" for r in distinct.collect())
    keys = sorted((r["a.key"] for r in distinct.collect()), key=repr)
    assert keys == sorted((r["a.key"] for r in kept.collect()), key=repr)
    leaders = {component for _, _, component in pairs if component is not None}
    assert keys == sorted([*leaders, None, None, None], key=repr)


def test_distinct_documents_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node string")
    assert near_dups.distinct_documents(df, "doc_id", "text").collect() == []


@pytest.mark.parametrize("percent", [5, 30, 50, 70, 80, 85, 90, 95, 99])
def test_bands_miss_few_pairs_at_the_border(percent):
    rows, bands = near_dups.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= near_dups.MISS
    assert rows == 1 or rows * bands <= near_dups.MINIMA
    assert near_dups.banding(85) == (6, 32)


def test_pack_keeps_own_names(spark):
    names = ["row", "bucket", "rank", "first", "number", "n", "_first", "_rank", "_of", "_in", "_bucket", "_number"]
    df = spark.range(500).select(
        F.col("id").alias("doc_id"), (F.col("id") % 90 + 1).alias("length"), *[F.lit(f"mine {c}").alias(c) for c in names]
    )
    got = packing.pack(df, ["doc_id"], 100)
    assert got.columns == [*df.columns, "sequence_id", "offset"]
    rows = got.collect()
    assert len(rows) == 500 and all(r[c] == f"mine {c}" for r in rows for c in names)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 100


@pytest.mark.parametrize("k", [0, 1, 3, 6, 7, 11, 12])
def test_exactly_k_rows_with_null_and_repeated_keys(spark, k):
    keys = [None] * 6 + [4] * 5 + [9]
    df = spark.createDataFrame([(x, "same words", i) for i, x in enumerate(keys)], "id long, text string, _number int")
    for seed in range(3):
        out = resampling.resample(df.repartition(3), "id", "text", resampling.learn_weights(df, "text", F.lit(True)), k, seed)
        assert out.count() == 12 and out.where("sampled").count() == k
        assert sorted(r["_number"] for r in out.collect()) == list(range(12))


def test_largest_of_equal_values(spark):
    df = spark.createDataFrame([(None, 1.0)] * 4 + [(2, 1.0)] * 4 + [(3, 0.5)], "id long, v double")
    for k in range(1, 9):
        chosen = resampling.take_largest(df.repartition(4), "v", "id", k).where("sampled").collect()
        assert [r["id"] for r in chosen].count(None) == min(k, 4) and len(chosen) == k
