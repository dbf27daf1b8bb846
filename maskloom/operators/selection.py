"""Values at given places of sorted groups, where no task sorts or holds a whole group.

A place is looked for in a range of its group's values. A round cuts each range that is still too large at values of a
sketch, counts what falls into each piece, and goes on with the piece that holds the place. Only the last ranges are
sorted. Heavy groups are spread over all tasks in every round, as rows meet the ranges by a broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.session import broadcast_if_small, materialise

# Ranges beyond this number are joined by shuffle.
MAX_RANGES = 500_000


def same_group(rows: DataFrame, table: DataFrame, by: list[str], how: str = "inner", within: Column | None = None) -> DataFrame:
    """Join with a table of groups, where null is a group like others. The table is broadcast if it is small."""
    renamed = {c: f"_of_{i}" for i, c in enumerate(by)}
    right = broadcast_if_small(table.withColumnsRenamed(renamed), MAX_RANGES)
    equal = [F.col(f"`{c}`").eqNullSafe(F.col(of)) for c, of in renamed.items()]
    parts = equal if within is None else [*equal, within]
    return rows.join(right, reduce(Column.__and__, parts, F.lit(True)), how).drop(*renamed.values())


def _inside(counted: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    within = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    return same_group(counted, ranges, by, within=within)


def _narrow(counted: DataFrame, wide: DataFrame, by: list[str], pieces: int) -> DataFrame:
    """The same places in the pieces that hold them."""
    ranges = materialise(wide.select(*by, "_low", "_high", "_before").distinct(), "ranges")
    cuts = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cut_at = F.percentile_approx("_v", cuts, F.lit(10 * pieces)).alias("_cuts")
    found = _inside(counted, ranges, by).groupBy(*by, "_low", "_high", "_before").agg(cut_at)
    piece = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_piece")
    counts = (
        _inside(counted, materialise(found, "cuts"), by)
        .select(*by, F.col("_low").alias("_was"), "_before", piece, "_v", "_n")
        .groupBy(*by, "_was", "_before", "_piece")
        .agg(
            F.min("_v").alias("_low"),
            F.max("_v").alias("_high"),
            F.count("*").alias("_held"),
            F.sum("_n").alias("_size"),
        )
    )
    # at most ``pieces`` rows a range
    earlier = Window.partitionBy(*by, "_was").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    placed = counts.withColumn("_before", start).drop("_piece")
    holds = (
        (F.col("_was") == F.col("_old"))
        & (F.col("_rank") >= F.col("_before"))
        & (F.col("_rank") < F.col("_before") + F.col("_size"))
    )
    return same_group(wide.select(*by, "_rank", F.col("_low").alias("_old")), placed, by, within=holds).select(wide.columns)


def values_at(counted: DataFrame, places: DataFrame, by: list[str], pieces: int = 64, most: int = 200_000) -> DataFrame:
    """``places`` (group columns and ``_rank``, from 0) with ``_found``, the value of that rank in its group.

    ``counted`` is a table with the group columns, a number ``_v`` and how often it occurs, ``_n``; no null values.
    A range with at most ``most`` distinct values is sorted in one task; a larger one is cut into ``pieces``. Ranks
    outside a group, and groups without values, are left out.
    """
    inner = {c: f"_by_{i}" for i, c in enumerate(by)}  # so that no group column clashes with a name used here
    counted, places, by = counted.withColumnsRenamed(inner), places.withColumnsRenamed(inner), list(inner.values())
    groups = counted.groupBy(*by).agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_held"), F.sum("_n").alias("_size")
    )
    known = (F.col("_rank") >= 0) & (F.col("_rank") < F.col("_size"))
    state = same_group(places.select(*by, "_rank").distinct(), materialise(groups, "groups"), by, within=known)
    state = materialise(state.select(*by, "_rank", "_low", "_high", "_held", F.lit(0).cast("long").alias("_before")), "places")
    too_wide = (F.col("_held") > most) & (F.col("_low") < F.col("_high"))
    while state.where(too_wide).limit(1).count():
        narrowed = _narrow(counted, state.where(too_wide), by, pieces)
        state = materialise(state.where(~too_wide).unionByName(narrowed), "places")
    ranges = state.select(*by, "_low", "_high", "_before").distinct()
    sorted_values = Window.partitionBy(*by, "_low").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    until = F.col("_before") + F.sum("_n").over(sorted_values)
    running = _inside(counted, ranges, by).withColumn("_until", until)
    running = running.select(*by, F.col("_v").alias("_found"), (F.col("_until") - F.col("_n")).alias("_from"), "_until")
    holds = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_until"))
    found = same_group(running, state.select(*by, "_rank"), by, within=holds).select(*by, "_rank", "_found")
    return found.withColumnsRenamed({new: old for old, new in inner.items()})
