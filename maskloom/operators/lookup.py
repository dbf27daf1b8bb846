"""Joins of many rows with one row per key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.session import broadcast_if_small, materialise


def _named(column: str) -> Column:
    """The column of exactly this name, which may have a dot."""
    return F.col("`" + column.replace("`", "``") + "`")


def lookup(
    facts: DataFrame, table: DataFrame, keys: list[str], share: float = 1e-3, max_broadcast: int = 500_000
) -> DataFrame:
    """Left join of ``facts`` with ``table``, which has one row per key.

    A table of at most ``max_broadcast`` rows, counted first, is broadcast. Beyond that, keys with at least ``share``
    of all facts are at most ``1 / share`` many, so their rows of ``table`` are broadcast. The other keys are shuffled, and none of them can hold more than that share. Rows found already
    go through the shuffle under keys that spread them evenly and match nothing.

    Both sides are read more than once; pass tables, not costly plans.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    if table.limit(max_broadcast + 1).count() <= max_broadcast:
        return facts.join(F.broadcast(table), keys, "left")
    values = [c for c in table.columns if c not in keys]
    sizes = facts.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = facts.agg(F.count("*").alias("_all"))
    limit = F.col("_n") >= F.ceil(F.lit(share) * total.scalar())
    frequent = materialise(sizes.where(limit).select(*keys).limit(int(1 / share) + 1), "frequent-keys")
    small = materialise(table.join(F.broadcast(frequent), keys, "left_semi"), "frequent-rows")
    if small.count() > int(1 / share) + 1:
        raise ValueError("the table repeats keys")
    ready = frequent.join(F.broadcast(small), keys, "left").withColumn("_ready", F.lit(True))
    ready = ready.select(*keys, *[_named(v).alias(f"_{v}") for v in values], "_ready")
    first = facts.join(F.broadcast(ready), keys, "left")
    done = F.coalesce("_ready", F.lit(False))
    spread = F.when(done, F.xxhash64(*[_named(c) for c in facts.columns])).otherwise(F.lit(0))
    rest = table.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.lit(0).cast("long").alias("_spread_key"),
        F.lit(False).alias("_open"),
        *[_named(v).alias(f"_rest_{v}") for v in values],
    )
    tagged = first.withColumn("_done", done).withColumn("_spread", spread)
    condition = (F.col("_spread") == F.col("_spread_key")) & (F.col("_done") == F.col("_open"))
    for key in keys:
        condition &= F.col(key) == F.col(f"_key_{key}")
    joined = tagged.join(rest, condition, "left")
    picked = [F.when(F.col("_done"), _named(f"_{v}")).otherwise(_named(f"_rest_{v}")).alias(v) for v in values]
    return joined.select(*[_named(c) for c in facts.columns], *picked)


def semi_lookup(df: DataFrame, chosen: DataFrame, keys: list[str], max_rows: int = 100_000) -> DataFrame:
    """Rows of ``df`` whose key is in ``chosen``, which is broadcast only if it has at most ``max_rows`` rows."""
    return df.join(broadcast_if_small(chosen, max_rows), keys, "left_semi")
