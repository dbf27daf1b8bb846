"""Losses under models whose names have dots, where the table of pairs is too large to broadcast."""

from maskloom.operators import scoring


def test_large_tables_keep_model_names(spark):
    positions = spark.createDataFrame(
        [("s", str(i), 1 + i % 9, i * i % 5, i % 7, 9) for i in range(300)],
        "sample string, item string, pos int, prev int, cur int, n int",
    )
    counts = spark.createDataFrame([(p, c, 1 + p * c) for p in range(4) for c in range(5)], "prev int, cur int, cnt long")
    models = {"bigram-0.1": 0.1, "bigram-1": 1.0, "v2.x": 2.0}
    small = scoring.model_losses(positions, counts, 7, models)
    large = scoring.model_losses(positions, counts, 7, models, max_broadcast=3, share=0.05)
    assert large.columns == small.columns
    assert sorted(large.collect()) == sorted(small.collect())
    assert large.count() == 3 * 300
