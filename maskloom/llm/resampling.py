"""Importance resampling of raw text towards a target.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. The shares of the buckets in target
and in raw text are two generative models; the logarithm of their ratio, summed over a text, is its weight. A Gumbel
number drawn from each key is added, and the rows with the largest sums are a sample without replacement in which
texts stand in proportion to their weights.

Defined cases: null and empty texts have the weight 0; without target or raw text all weights are 0, so the sample
is uniform; rows with equal sum are taken in the order of their keys, and rows that are equal in both are taken or
left together; more columns of the input are carried along, and one with the name of an output is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import annotate, name, texts_of, window_hashes, word_hashes
from maskloom.session import materialise

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 10_000


def _cells(text: str) -> np.ndarray:
    """The bucket of every word and every pair of neighbours."""
    tokens = TOKEN.findall(text.lower())
    if not tokens:
        return np.zeros(0, np.int64)
    hashes = word_hashes([t.encode("utf-8", "surrogatepass") for t in tokens])
    both = hashes if len(hashes) == 1 else np.concatenate([hashes, window_hashes(hashes, 2)])
    return (both % np.uint64(BUCKETS)).astype(np.int64)


def learn_weights(df: DataFrame, text: str, is_target: Column, smooth: float = 1.0) -> np.ndarray:
    """Log ratio for each bucket. All rows count as raw text; those with ``is_target`` count as target as well.

    Each task adds up its own rows, so ``BUCKETS`` rows a task are shuffled and ``BUCKETS`` rows reach the driver.
    """

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t, wanted in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                counts = np.bincount(_cells(t), minlength=BUCKETS)
                raw += counts
                if wanted:
                    target += counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["cell", "raw", "target"]
        )

    counts = df.select(name(text).alias("text"), F.coalesce(is_target, F.lit(False)).alias("target"))
    summed = counts.mapInArrow(run, "cell long, raw long, target long").groupBy("cell")
    rows = summed.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in rows:
        raw[row["cell"]], target[row["cell"]] = row["raw"], row["target"]
    if not raw.sum() or not target.sum():
        return np.zeros(BUCKETS)
    # target shares are smoothed towards the raw ones, so buckets that the target lacks are not ruled out
    p_raw = (raw + smooth) / (raw + smooth).sum()
    p_target = (target + smooth * BUCKETS * p_raw) / (target.sum() + smooth * BUCKETS)
    return np.log(p_target) - np.log(p_raw)


def weigh(df: DataFrame, text: str, weights: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Add ``log_weight`` to each text."""

    def kernel():
        def work(array):
            return [pa.array([float(weights[_cells(t)].sum()) for t in texts_of(array)], pa.float64())]

        return work

    return annotate(df, [text], kernel, "log_weight double", keep)


def gumbel(key: str, seed: int) -> Column:
    """A Gumbel number for each key, the same in every run."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), name(key)), F.lit(1 << 52))
    return -F.log(-F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 52))))


def take_largest(df: DataFrame, value: str, key: str, k: int, out: str = "sampled") -> DataFrame:
    """Mark the ``k`` rows with the largest ``value``, ties by ``key``; nothing is sorted as a whole.

    The border is narrowed by counts in 1,000 cells, again and again until its cell is small. ``df`` is read each
    time; pass a table.
    """
    total = df.count()
    if k >= total or k <= 0:
        return df.withColumn(out, F.lit(k >= total and k > 0))
    column = name(value)
    low, high = df.agg(F.min(column), F.max(column)).first()
    above, cells = 0, 1000
    while True:
        inside = df.where((column >= low) & (column <= high))
        width = (high - low) / cells
        if width <= 0 or low + width <= low:
            break
        cell = F.least(F.floor((column - F.lit(low)) / F.lit(width)), F.lit(cells - 1)).cast("int").alias("cell")
        found = inside.groupBy(cell).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        rows = sorted(found.collect(), key=lambda r: -r["cell"])
        for row in rows:
            if above + row["n"] >= k:
                break
            above += row["n"]
        if (low, high) == (row["low"], row["high"]):
            break
        low, high = row["low"], row["high"]
        if row["n"] <= 10_000:
            break
    if low < high:
        # at most 10,000 rows, or values that lie too close to be told apart by cells
        rows = df.where((column >= low) & (column <= high)).groupBy(column.alias("v")).count().orderBy(F.desc("v"))
        for row in rows.toLocalIterator():
            if above + row["count"] >= k:
                break
            above += row["count"]
        low = row["v"]
    # rows of this very value: the smallest keys
    tied = column == low
    last, need = _key_border(df.where(tied).groupBy(name(key).alias("_k")).count(), k - above)
    at_border = tied & name(key).eqNullSafe(F.lit(last))
    before = F.lit(False) if last is None else (name(key).isNull() | (name(key) < F.lit(last)))
    chosen = F.coalesce((column > low) | (tied & before), F.lit(False))
    edge = df.where(at_border)
    if edge.count() == need:
        return df.withColumn(out, chosen | F.coalesce(at_border, F.lit(False)))
    rest = df.where(~F.coalesce(at_border, F.lit(False))).withColumn(out, chosen)
    return rest.unionByName(_mark_some(edge, need, out))


def _key_border(tied: DataFrame, need: int) -> tuple[object, int]:
    """The key at which the running number of rows reaches ``need``, and how many of its rows are needed."""
    for row in tied.orderBy("_k").toLocalIterator():
        if row["count"] >= need:
            break
        need -= row["count"]
    return row["_k"], need


def _mark_some(rows: DataFrame, need: int, out: str) -> DataFrame:
    """Mark ``need`` of many rows of one key and value, which differ at most in other columns.

    They are numbered as they are written, so the choice stays whatever is read or repeated later; the driver sees how
    many rows each task wrote.
    """
    number = "_number"
    while number in rows.columns:
        number += "_"
    # numbers start at task * 2^33 and run on by one
    rows = materialise(rows.withColumn(number, F.monotonically_increasing_id()), "ties")
    counts = rows.groupBy(F.shiftright(number, 33).alias("task")).agg(F.count("*").alias("n")).orderBy("task")
    for row in counts.toLocalIterator():
        if row["n"] >= need:
            break
        need -= row["n"]
    return rows.withColumn(out, F.col(number) < F.lit((row["task"] << 33) + need)).drop(number)


def resample(
    df: DataFrame, key: str, text: str, weights: np.ndarray, k: int, seed: int = 11, keep: list[str] | None = None
) -> DataFrame:
    """Add ``log_weight``, ``gumbel_key`` and ``sampled`` (exactly ``k`` rows, or all if there are fewer)."""
    kept = df.columns if keep is None else keep
    weighed = weigh(df, text, weights, kept).withColumn("gumbel_key", F.col("log_weight") + gumbel(key, seed))
    return take_largest(materialise(weighed, "weighed"), "gumbel_key", key, k)
