"""Dense positions and running totals over a whole table, without a single-task window.

Rows fall into buckets that follow the order. Bucket totals are few, so their running sum is a small table that
is broadcast; inside a bucket an ordinary window does the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from maskloom.functions.draws import draw

MAX_BUCKETS = 65536
# Rows that one task sorts, as long as there are fewer than MAX_BUCKETS buckets.
ROWS_PER_BUCKET = 100_000
# More cuts than this are searched in Arrow batches instead of an expression.
TREE = 512


def buckets_for(df: DataFrame) -> int:
    """As many buckets as the number of rows needs, and at least two for each core."""
    cores = 2 * df.sparkSession.sparkContext.defaultParallelism
    return max(2, min(MAX_BUCKETS, max(cores, -(-df.count() // ROWS_PER_BUCKET))))


def _cuts(df: DataFrame, key: str, buckets: int) -> list:
    """Values that divide ``key`` into about equal parts; at most ``buckets - 1`` of them.

    Numbers are summed up by a sketch. Of other types, the keys with the smallest hashes stand for all, some ten for
    each bucket: they only place the borders.
    """
    if not isinstance(df.schema[key].dataType, NumericType):
        kept = df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(10 * buckets)
        values = sorted(r[0] for r in kept.collect())
        return sorted({values[len(values) * i // buckets] for i in range(1, buckets)}) if values else []
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    row = df.agg(F.percentile_approx(key, shares, F.lit(10 * buckets)).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def _bucket(key: Column, cuts: list, first: int = 0) -> Column:
    """Number of cuts below or at ``key``, as a balanced tree of comparisons where they are few."""
    if not cuts:
        return F.lit(first)
    if len(cuts) > TREE:
        borders = np.array(cuts)

        def search(values: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(borders, np.array(values.to_pylist()), "right").astype(np.int32))

        return F.arrow_udf(search, "int")(key)
    middle = len(cuts) // 2
    return F.when(key < F.lit(cuts[middle]), _bucket(key, cuts[:middle], first)).otherwise(
        _bucket(key, cuts[middle + 1 :], first + middle + 1)
    )


def _prefix(df: DataFrame, bucket: Column, order: Column, weight: Column, out: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows that come earlier."""
    tagged = df.withColumn("_bucket", bucket).withColumn("_order", order).withColumn("_weight", weight.cast("long"))
    totals = tagged.groupBy("_bucket").agg(F.sum("_weight").alias("_total"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket, never more than MAX_BUCKETS
    starts = totals.select("_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.join(F.broadcast(starts), "_bucket")
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .drop("_bucket", "_order", "_weight", "_start")
    )


def running_total(df: DataFrame, key: str, weight: Column, out: str, buckets: int | None = None) -> DataFrame:
    """Sum of ``weight`` over the rows with a smaller ``key``, which must be unique.

    ``df`` is read three times (cuts, totals, rows); pass a table, not a costly plan.
    """
    cuts = _cuts(df, key, min(buckets or buckets_for(df), MAX_BUCKETS))
    return _prefix(df, _bucket(F.col(key), cuts), F.col(key), weight, out)


def dense_index(df: DataFrame, key: str, out: str = "idx", buckets: int | None = None) -> DataFrame:
    """Positions 0..n-1 in the order of the unique column ``key``."""
    return running_total(df, key, F.lit(1), out, buckets)


def seeded_rank(
    df: DataFrame, key: str, seed: int | str, out: str = "rank", digits: int | None = None
) -> DataFrame:
    """Positions 0..n-1 in a shuffled order fixed by ``seed`` and the unique column ``key``.

    Hash prefixes of ``digits`` hex digits are the buckets, evenly filled whatever the keys look like; without
    ``digits`` the number of rows decides.
    """
    if digits is None:
        digits = next(d for d in range(2, 5) if 16**d >= buckets_for(df) or d == 4)
    if 16**digits > MAX_BUCKETS:
        raise ValueError("too many buckets")
    drawn = draw(seed, F.col(key))
    return _prefix(df, F.substring(drawn, 1, digits), drawn, F.lit(1), out)
