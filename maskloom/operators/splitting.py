"""Train, validation and test membership, and fixed samples."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.draws import below, draw
from maskloom.operators.selection import same_group, values_at
from maskloom.session import materialise


def split_name(seed: int | str, test_size: float, *keys: Column) -> Column:
    """'test' for about a share ``test_size`` of the keys, else 'train'."""
    return F.when(below(draw(seed, *keys), test_size), "test").otherwise("train")


def threshold_split(df: DataFrame, *keys: str, test_size: float, seed: int | str) -> DataFrame:
    """Membership by hash: no shuffle, and a row keeps its side when others come or go."""
    return df.withColumn("split", split_name(seed, test_size, *[F.col(k) for k in keys]))


def _border(keyed: DataFrame, wanted: int, digits: int = 2, most: int = 10_000) -> str:
    """The draw (``_draw``) of the row that is number ``wanted`` in the seeded order; there must be so many rows.

    Only counts per hash prefix are looked at, with a longer prefix where the border lies until at most ``most``
    rows share it; the rows themselves do not move.
    """
    border = ""
    while True:
        length = len(border) + digits
        inside = keyed.where(F.col("_draw").startswith(border))
        counted = inside.groupBy(F.substring("_draw", 1, length).alias("_prefix")).count()
        counts = {r["_prefix"]: r["count"] for r in counted.collect()}  # at most 16**digits
        for border in sorted(counts):
            if wanted <= counts[border]:
                break
            wanted -= counts[border]
        if counts[border] <= most or length >= 32:
            break
    # at most ``most`` rows, or rows with one and the same draw
    last = keyed.where(F.col("_draw").startswith(border)).orderBy("_draw").limit(min(wanted, most))
    return last.agg(F.max("_draw")).first()[0]


def _first_by_draw(
    df: DataFrame, key: str, seed: int | str, share: float, rounding: str, digits: int = 2, most: int = 10_000
) -> Column:
    """True for the rows that come first in the seeded order, a share of them rounded to whole rows."""
    drawn = draw(seed, F.col(key))
    wanted = int((Decimal(str(share)) * df.count()).to_integral_value(rounding))
    if wanted == 0:
        return F.lit(False)
    return drawn <= _border(df.select(drawn.alias("_draw")), wanted, digits, most)


def exact_split(df: DataFrame, key: str, test_size: float, seed: int | str) -> DataFrame:
    """Exactly ``ceil(test_size * n)`` test rows, the rest train."""
    first = _first_by_draw(df, key, seed, test_size, ROUND_CEILING)
    return df.withColumn("split", F.when(first, "test").otherwise("train"))


def exact_train_split(df: DataFrame, key: str, train_size: float, seed: int | str) -> DataFrame:
    """Exactly ``floor(train_size * n)`` train rows, the rest validation."""
    first = _first_by_draw(df, key, seed, train_size, ROUND_FLOOR)
    return df.withColumn("split", F.when(first, "train").otherwise("validation"))


def three_way_split(
    df: DataFrame,
    unit: list[str],
    test_key: str,
    test_size: float = 0.2,
    test_seed: int | str = 420,
    train_size: float = 0.8,
    seed: int | str = 42,
) -> DataFrame:
    """Train, validation and test.

    The test side is always chosen by document. ``unit`` names the columns that choose between train and
    validation: the document, or document and window, where windows of one document may part.
    """
    drawn = draw(seed, *[F.col(k) for k in unit])
    train = F.when(below(drawn, train_size), "train").otherwise("validation")
    test = below(draw(test_seed, F.col(test_key)), test_size)
    return df.withColumn("split", F.when(test, "test").otherwise(train))


def positional_split(df: DataFrame, position: str, test_size: float, seed: int | str) -> DataFrame:
    """Membership by position: what happens when rows are told apart only by where they stand."""
    return df.withColumn("split", split_name(seed, test_size, F.col(position)))


def sample(df: DataFrame, *keys: str, n: int, seed: int | str) -> DataFrame:
    """``n`` rows without replacement, in seeded order.

    The draw of the last row is found from counts first, so that only ``n`` rows are sorted, whatever the number of
    tasks. Rows with a null key have no draw and come first, as many as fit.
    """
    drawn = draw(seed, *[F.col(k) for k in keys])
    rows = df.withColumn("_draw", drawn)
    held = rows.groupBy(F.col("_draw").isNull().alias("null")).count().collect()
    counts = {r["null"]: r["count"] for r in held}
    wanted = n - counts.get(True, 0)
    if wanted <= 0:
        rows = rows.where(F.col("_draw").isNull())
    elif wanted < counts.get(False, 0):
        border = _border(rows.select("_draw").where(F.col("_draw").isNotNull()), wanted)
        rows = rows.where(F.col("_draw").isNull() | (F.col("_draw") <= border))
    return rows.orderBy("_draw", *keys).limit(n).drop("_draw")


def fit_groups(histogram: dict[int, int], wanted: int) -> dict[int, int]:
    """How many groups of each size to take, so that the rows come to ``wanted`` or as little below as steps allow.

    ``histogram`` has the number of groups of each size. Every size gives its share first; what is missing then is
    filled with the largest groups that fit. The sum falls short by less than the smallest group that was left.
    """
    rows = sum(size * count for size, count in histogram.items())
    taken = {size: wanted * count // rows for size, count in histogram.items()}
    missing = wanted - sum(size * count for size, count in taken.items())
    for size in sorted(histogram, reverse=True):
        more = min(histogram[size] - taken[size], missing // size)
        taken[size] += more
        missing -= more * size
    return taken


def group_split(df: DataFrame, group: str, test_size: float, seed: int | str) -> DataFrame:
    """``ceil(test_size * n)`` test rows, or fewer by less than a group, with equal values of ``group`` on one side.

    Where documents are copied, a split by document puts copies on both sides; this one takes whole groups. Which of
    the groups of one size are taken depends only on the seed and the group's value. Nulls are one group.

    The driver sees one number a group size; there are at most ``sqrt(2 n)`` sizes. Groups are counted before the
    shuffle, and the last group taken of each size is found by counting (``values_at``), as most groups may have one
    size. A group with a large share of the rows is a skewed key of one join, which adaptive execution splits.
    """
    keyed = df.withColumn("_group", F.coalesce(F.sha2(F.col(group).cast("string"), 256), F.lit("")))
    sizes = keyed.groupBy("_group").agg(F.count("*").alias("_size"))
    number = F.conv(F.substring(draw(seed, F.col("_group")), 1, 15), 16, 10).cast("long")
    sizes = materialise(sizes.withColumn("_v", number), "groups")
    histogram = {r["_size"]: r["count"] for r in sizes.groupBy("_size").count().collect()}
    if not histogram:
        return df.withColumn("split", F.lit("train"))
    rows = sum(size * count for size, count in histogram.items())
    wanted = int((Decimal(str(test_size)) * rows).to_integral_value(ROUND_CEILING))
    last = [(size, taken - 1) for size, taken in fit_groups(histogram, wanted).items() if taken]
    places = df.sparkSession.createDataFrame(last, "_size long, _rank long")
    counted = materialise(sizes.groupBy("_size", "_v").agg(F.count("*").alias("_n")), "draws")
    borders = materialise(values_at(counted, places, ["_size"]).drop("_rank"), "borders")
    sides = same_group(sizes, borders, ["_size"], "left")
    chosen = F.coalesce(F.col("_v") <= F.col("_found"), F.lit(False))
    sides = sides.select("_group", F.when(chosen, "test").otherwise("train").alias("split"))
    return keyed.join(sides, "_group", "left").select(*df.columns, "split")
