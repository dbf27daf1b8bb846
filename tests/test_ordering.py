import hashlib

import pytest
from pyspark.sql import functions as F

from maskloom.operators import ordering


@pytest.fixture(scope="module")
def clustered(spark):
    """Keys that lie close together but for a few far away, in mixed order."""
    keys = [*range(500), *range(10**9, 10**9 + 300), -(10**12), 10**15]
    rows = [(k, k % 7) for k in sorted(keys, key=lambda k: hash((k, 1)))]
    return spark.createDataFrame(rows, "doc_id long, weight int").repartition(5)


def test_dense_index(clustered):
    rows = ordering.dense_index(clustered, "doc_id").collect()
    assert {r["doc_id"]: r["idx"] for r in rows} == {k: i for i, k in enumerate(sorted(r["doc_id"] for r in rows))}
    assert len(rows) == clustered.count()


def test_running_total(clustered):
    rows = ordering.running_total(clustered, "doc_id", F.col("weight"), "before", buckets=7).collect()
    total = 0
    for row in sorted(rows, key=lambda r: r["doc_id"]):
        assert row["before"] == total
        total += row["weight"]


def test_empty_table(clustered):
    assert ordering.dense_index(clustered.where("doc_id is null"), "doc_id").collect() == []


@pytest.mark.parametrize("digits", [1, 3])
def test_seeded_rank(clustered, digits):
    rows = ordering.seeded_rank(clustered, "doc_id", 666, digits=digits).collect()
    want = sorted((r["doc_id"] for r in rows), key=lambda k: hashlib.md5(f"666:{k}".encode()).hexdigest())
    assert {r["doc_id"]: r["rank"] for r in rows} == {k: i for i, k in enumerate(want)}
