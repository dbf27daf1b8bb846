"""Summaries of results: exact quantiles, describe, token lengths, completeness and comparison of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.operators.selection import same_group, values_at
from maskloom.session import materialise

# The statistics of a summary table, in order.
DESCRIBE = ["count", "mean", "std", "min", "25%", "50%", "75%", "max", "median"]

PIECES = 64


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    shares: list[float],
    buckets: int | None = None,
    max_values: int = 200_000,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group and share.

    Groups of up to ``max_values`` distinct values, counted first, are held by the built-in aggregate. The others are
    fewer than one for ``max_values`` values; their quantiles are selected by rounds of counting ``buckets`` ranges (``values_at``), so no
    task holds more than ``max_values`` values of a group. Both ways give the same number to the last bit.
    """
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counted = materialise(counted, "quantiles")
    sizes = counted.groupBy(*by).agg(F.count("*").alias("_held"), F.sum("_n").alias("_total"))
    heavy = materialise(sizes.where(F.col("_held") > max_values).drop("_held"), "heavy-groups")
    light = same_group(counted, heavy.drop("_total"), by, "left_anti")
    found = F.percentile("_v", wanted, F.col("_n"))
    pairs = F.arrays_zip(wanted.alias("share"), found.alias("value"))
    held = light.groupBy(*by).agg(pairs.alias("_q")).select(*by, F.inline("_q"))
    if heavy.isEmpty():
        return held
    places = heavy.select(*by, "_total", F.explode(wanted).alias("share"))
    places = places.withColumn("_place", F.col("share") * (F.col("_total") - 1)).drop("_total")
    edges = F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("_rank")
    ranks = materialise(places.select("*", edges), "ranks")
    values = values_at(counted, ranks, by, buckets or PIECES, max(max_values, 1))
    values = materialise(values.withColumnRenamed("_rank", "_found_rank"), "selected")
    both = same_group(ranks, values, by, within=F.col("_rank") == F.col("_found_rank"))
    # weighted as the built-in aggregate does it
    low, high, place = F.col("_low"), F.col("_high"), F.col("_place")
    between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
    selected = (
        both.groupBy(*by, "share", "_place")
        .agg(F.min("_found").alias("_low"), F.max("_found").alias("_high"))
        .select(*by, "share", F.when(low == high, low.cast("double")).otherwise(between).alias("value"))
    )
    return held.unionByName(selected)


def describe(df: DataFrame, by: list[str], value: str, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, extremes, quartiles and median per group, as (group, stat, value)."""
    plain = df.groupBy(*by).agg(
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    shares = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    if exact:
        quartiles = exact_quantiles(df, by, value, list(shares.values()))
    else:
        approximate = F.percentile_approx(value, F.array(*[F.lit(s) for s in shares.values()]))
        spread = F.arrays_zip(F.array(*[F.lit(s) for s in shares.values()]).alias("share"), approximate.alias("value"))
        quartiles = df.groupBy(*by).agg(F.explode(spread).alias("q")).select(*by, "q.share", "q.value")
    names = F.create_map(*[x for name, share in shares.items() for x in (F.lit(share), F.lit(name))])
    middle = quartiles.where(F.col("share") == 0.5).select(*by, F.lit("median").alias("stat"), "value")
    return (
        plain.unpivot(by, ["count", "mean", "std", "min", "max"], "stat", "value")
        .unionByName(quartiles.select(*by, names[F.col("share")].alias("stat"), "value"))
        .unionByName(middle)
    )


def length_statistics(df: DataFrame, by: list[str], length: Column) -> DataFrame:
    """Extremes, mean, median and the 95th and 99th percentile of a whole-number length.

    Lengths are counted first, so a task holds one entry per distinct length, not per row.
    """
    counted = df.select(*by, length.alias("_length")).groupBy(*by, "_length").agg(F.count("*").alias("_n"))
    quantiles = F.percentile("_length", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("_n"))
    return (
        counted.groupBy(*by)
        .agg(
            F.sum("_n").alias("n"),
            F.min("_length").alias("min"),
            F.max("_length").alias("max"),
            (F.sum(F.col("_length") * F.col("_n")) / F.sum("_n")).alias("mean"),
            quantiles.alias("_q"),
        )
        .select(
            *by,
            "n",
            "min",
            "max",
            "mean",
            F.col("_q")[0].alias("median"),
            F.col("_q")[1].alias("percentile_95"),
            F.col("_q")[2].alias("percentile_99"),
        )
    )


def missing_results(expected: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys without a result."""
    return expected.select(*keys).join(finished.select(*keys), keys, "left_anti")


def completeness(expected: DataFrame, finished: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per group: expected keys, those with a result, and those without. A key counts once, however many results
    it has."""
    done = finished.select(*keys).distinct().withColumn("_done", F.lit(1))
    joined = expected.select(*dict.fromkeys([*by, *keys])).join(done, keys, "left")
    return joined.groupBy(*by).agg(
        F.count("*").alias("n_expected"),
        F.count("_done").alias("n_finished"),
        (F.count("*") - F.count("_done")).alias("n_missing"),
    )


def compare_models(results: DataFrame, item: list[str], model: str = "model", score: str = "ppl") -> DataFrame:
    """Per sample and model: texts, mean score, and on how many texts the model has the lowest score.

    A tie goes to the model that comes first by name.
    """
    sample = item[0]
    valid = results.where(F.col(score).isNotNull())
    best = valid.groupBy(*item).agg(F.min(F.struct(score, model)).alias("_best"))
    wins = best.groupBy(sample, F.col(f"_best.{model}").alias(model)).agg(F.count("*").alias("wins"))
    means = valid.groupBy(sample, model).agg(F.count("*").alias("n_texts"), F.avg(score).alias("mean_ppl"))
    return means.join(wins, [sample, model], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
