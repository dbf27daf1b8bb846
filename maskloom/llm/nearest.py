"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions by several random rotations, shifted, and put in Hilbert order, once for each
curve. The orders are range-partitioned by Spark; positions follow from counts per partition. A curve is cut into cells
of fixed size, and a query visits the cells that its window of positions touches, where it meets the vectors themselves
and keeps its best. The best over all curves are the result. Equal vectors are searched once, with as many of their ids
as a result can hold, so a vector that very many rows share costs no more than another.

The measure is the inner product. Vectors are dealt into bands of norms, each with norms within a factor of two, and
each band has curves of its own. Within a band a further component makes all vectors equally long before the
projection; queries have the same length and none of that component, so that the largest product is the nearest point.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components,
and rows with a null id take no part; ties go to the smaller id; rows that repeat an id are one candidate for each
of their vectors; with fewer candidates than asked for, all are given; an empty table gives no rows; a product beyond
the range of doubles is infinite, and such products tie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import name
from maskloom.session import materialise

CURVES, DIMENSIONS, BITS = 16, 8, 7
CELL = 4096
OCTAVE = 8  # norms are counted in so many steps to a factor of two
SPREAD = 4.0  # the grid covers so many standard deviations of a random direction's coordinates


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (whole coordinates below 2^bits) on the Hilbert curve.

    The axes are first brought to the curve's transposed form by undoing its turns from the top bit down, then Gray
    decoded, and their bits are interleaved.
    """
    axes = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    one, zero = np.uint64(1), np.uint64(0)
    for level in range(bits - 1, 0, -1):
        bit, below = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(axes)):
            turned = (axes[i] & bit) != zero
            swap = np.where(turned, zero, (axes[0] ^ axes[i]) & below)
            axes[0] = axes[0] ^ np.where(turned, below, swap)
            axes[i] = axes[i] ^ (swap if i else zero)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flips = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((axes[-1] >> np.uint64(level)) & one, (one << np.uint64(level)) - one, zero)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << one | ((axis ^ flips) >> np.uint64(level)) & one
    return key


def _turns(dimension: int, curves: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A random orthonormal projection and a shift for each curve."""
    rng = np.random.default_rng(seed)
    width = min(DIMENSIONS, dimension)
    turns = [np.linalg.qr(rng.standard_normal((dimension, dimension)))[0][:, :width] for _ in range(curves)]
    return np.stack(turns), rng.uniform(0, 1, (curves, width))


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not all of them zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def default_window(n: int) -> int:
    """Positions to either side. Data without structure need a window that grows with the table, though more slowly."""
    return max(128, math.ceil(0.75 * n**0.75))


def nearest(
    df: DataFrame,
    key: str,
    vector: str,
    is_query: Column,
    k: int,
    window: int | None = None,
    curves: int = CURVES,
    seed: int = 7,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` rows found nearest to each query row.

    ``window`` is the number of neighbours on either side of each curve of each band that are compared; by default it
    follows from the number of vectors in the band.
    """
    kind = df.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = df.select(name(key).alias("id"), name(vector).cast(f"array<{kind}>").alias("vec"), is_query.alias("query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    # minus zero equals zero, but has another hash
    zero = F.lit(0).cast(kind)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, zero).otherwise(x)))
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    spark = df.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], out)
    dimension = most["size"]
    rows = rows.where(F.size("vec") == dimension).withColumn("query", F.coalesce("query", F.lit(False)))

    # one row for each vector, with the ids that a result may need: k, and one more for the query's own
    numbered = Window.partitionBy("vec").orderBy("id")
    few = rows.select("vec", "id").withColumn("_n", F.row_number().over(numbered)).where(F.col("_n") <= k + 1)
    held = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.where("query").select("vec").distinct().withColumn("asked", F.lit(True))
    uid = F.concat(F.hex(F.xxhash64("vec")), F.hex(F.xxhash64(F.lit(1), "vec")))
    vectors = held.join(asked, "vec", "left").select(
        uid.alias("uid"), "vec", "ids", F.coalesce("asked", F.lit(False)).alias("asked")
    )
    vectors = materialise(vectors, "vectors")
    bands = _bands(vectors)
    windows = [default_window(n) if window is None else window for _, _, n in bands]

    ordered = _ordered(vectors, dimension, curves, seed, bands)
    best = _visit(ordered, windows, k + 1)
    # the same vector may be found on several curves
    found = best.groupBy("asker", "uid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    each = found.select("asker", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    packed = each.groupBy("asker").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id"))).alias("found")
    )
    packed = materialise(packed, "found")
    queries = rows.where("query").select(F.col("id").alias("query_id"), uid.alias("asker"))
    hits = queries.join(packed, "asker").select(
        "query_id",
        F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("_i", "_hit"),
    )
    return hits.select(
        F.col("query_id").cast("long"),
        (F.col("_i") + 1).cast("int").alias("rank"),
        F.col("_hit.vec_id").cast("long").alias("vec_id"),
        (-F.col("_hit.m")).alias("score"),
    )


def _lengths(x: np.ndarray) -> np.ndarray:
    """Base-two logarithms of the norms, also of those whose square is beyond the range of doubles."""
    power = _powers(x)
    return power + np.log2((np.ldexp(x, -power[:, None]) ** 2).sum(axis=1)) / 2


def _powers(x: np.ndarray) -> np.ndarray:
    """The power of two just above the largest component of each vector."""
    return np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]


def _bands(vectors: DataFrame) -> list[tuple[float, float, int]]:
    """Least and largest norm (as base-two logarithms) and number of vectors of each band, the longest vectors first.

    A band begins at the largest norm below the one before, and takes in norms down to about half of it.
    """

    def run(batches):
        for batch in batches:
            found = _lengths(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["length"])

    lengths = vectors.select("vec").mapInArrow(run, "length double")
    steps = lengths.groupBy(F.floor(F.col("length") * OCTAVE).alias("step")).agg(
        F.min("length").alias("low"), F.max("length").alias("high"), F.count("*").alias("n")
    )
    out: list[list] = []
    first = None
    # exponents of doubles bound the number of steps
    for row in steps.orderBy(F.desc("step")).collect():
        if first is None or row["step"] <= first - OCTAVE:
            first = row["step"]
            out.append([row["low"], row["high"], row["n"]])
        else:
            out[-1][0] = row["low"]
            out[-1][2] += row["n"]
    return [tuple(x) for x in out]


def _ordered(
    vectors: DataFrame, dimension: int, curves: int, seed: int, bands: list[tuple[float, float, int]]
) -> DataFrame:
    """Every vector with its position on every curve of its band, and every query with its position on all curves.

    ``curve`` numbers the curves of all bands. Only vectors count for positions; a query stands before the next one.
    """
    kind = vectors.schema["vec"].dataType.simpleString()
    names = ["curve", "key", "uid", "vec", "ids", "asks"]
    schema = f"curve int, key long, uid string, vec {kind}, ids array<long>, asks boolean"

    def run(batches):
        turns, shifts = _turns(dimension + 1, curves, seed)
        # a random direction's coordinates are about normal, so the grid need not cover the whole ball
        reach = min(1.0, SPREAD / math.sqrt(dimension + 1))
        highs = np.array([high for _, high, _ in bands])
        lows = np.array([low for low, _, _ in bands])

        def keys(points: np.ndarray, curve: int) -> pa.Array:
            # the shift moves the grid by up to half of its width
            at = (points @ turns[curve] / reach + 1) / 4 + shifts[curve] / 2
            return pa.array(hilbert_keys(np.clip(at * 2**BITS, 0, 2**BITS - 1), BITS).view(np.int64))

        def rows(band: int, curve: int, key: pa.Array, batch: pa.RecordBatch, asks: bool) -> pa.RecordBatch:
            n = batch.num_rows
            ids = pa.array([[]] * n, pa.list_(pa.int64())) if asks else batch.column("ids")
            number = pa.array(np.full(n, band * curves + curve, np.int32))
            flag = pa.array(np.full(n, asks))
            return pa.RecordBatch.from_arrays([number, key, batch.column("uid"), batch.column("vec"), ids, flag], names)

        for batch in batches:
            x = _matrix(batch.column("vec"))
            power, length = _powers(x), _lengths(x)
            fraction = np.ldexp(x, -power[:, None])
            # the last bit of a logarithm may differ from the one that was counted, so the nearest band counts
            own = np.argmin(np.maximum(lows - length[:, None], length[:, None] - highs), axis=1)
            short = np.minimum(1.0, np.exp2(length - highs[own]))
            part = fraction * np.exp2(power - highs[own])[:, None]
            lifted = np.concatenate([part, np.sqrt(1 - short**2)[:, None]], axis=1)
            direction = fraction * np.exp2(power - length)[:, None]
            asking = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            askers = batch.take(pa.array(asking))
            level = np.concatenate([direction[asking], np.zeros((len(asking), 1))], axis=1)
            for curve in range(curves):
                placed = keys(lifted, curve)
                for band in np.unique(own).tolist():
                    some = pa.array(np.flatnonzero(own == band))
                    yield rows(band, curve, placed.take(some), batch.take(some), False)
                if len(asking):
                    placed = keys(level, curve)
                    for band in range(len(bands)):
                        yield rows(band, curve, placed, askers, True)

    def number(batches):
        """Partition, and how many vectors of the curve stand before within it."""
        from pyspark import TaskContext

        part, now, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            held = ~batch.column("asks").to_numpy(zero_copy_only=False)
            at = np.empty(len(curve), np.int64)
            edges = (np.flatnonzero(np.diff(curve)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, len(curve)]):
                if a == b:
                    continue
                if curve[a] != now:
                    now, before = curve[a], 0
                ends = np.cumsum(held[a:b])
                at[a:b] = before + ends - held[a:b]
                before += int(ends[-1])
            columns = [batch.column(c) for c in ("curve", "uid", "vec", "ids", "asks")]
            parts = pa.array(np.full(len(curve), part, np.int32))
            yield pa.RecordBatch.from_arrays(
                [*columns, parts, pa.array(at)], names=["curve", "uid", "vec", "ids", "asks", "_part", "_at"]
            )

    keyed = materialise(vectors.select("uid", "vec", "ids", "asked").mapInArrow(run, schema), "keyed")
    spark = vectors.sparkSession
    n = keyed.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 500_000))
    # points in one step of the grid stand in another order on each curve
    order = [F.col("curve"), F.col("key"), F.xxhash64("curve", "uid"), F.col("uid"), F.col("asks").desc()]
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # partition and place within it, fixed by being written
    numbered = f"curve int, uid string, vec {kind}, ids array<long>, asks boolean, _part int, _at long"
    sorted_ = materialise(sorted_.mapInArrow(number, numbered), "ordered")
    counts = sorted_.groupBy("curve", "_part").agg(F.count_if(~F.col("asks")).alias("_n"))
    earlier = Window.partitionBy("curve").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(
        counts.select("curve", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "starts"
    )
    return (
        sorted_.join(starts, ["curve", "_part"])
        .withColumn("position", F.col("_before") + F.col("_at"))
        .withColumn("band", F.floor(F.col("curve") / curves).cast("int"))
        .drop("_at", "_part", "_before")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors in double precision, one a row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products; infinite where they are beyond the range of doubles."""
    a, b = _powers(x), _powers(y)
    if not len(x) or not len(y) or int(a.max()) + int(b.max()) + x.shape[1].bit_length() < 1020:
        return x @ y.T
    product = np.ldexp(x, -a[:, None]) @ np.ldexp(y, -b[:, None]).T
    with np.errstate(over="ignore"):
        return np.ldexp(product, a[:, None] + b)


def _visit(ordered: DataFrame, windows: list[int], k: int) -> DataFrame:
    """The best ``k`` vectors of each cell for each query whose window touches it."""
    # the windows of at most some hundred bands, as one array
    window = F.element_at(F.array(*map(F.lit, windows)), F.col("band") + 1)
    low = F.floor((F.col("position") - window) / CELL)
    high = F.floor((F.col("position") + window) / CELL)
    fixed = ["curve", "band", "uid", "vec", "ids", "position"]
    held = ordered.where(~F.col("asks")).select(
        *fixed, F.floor(F.col("position") / CELL).alias("cell"), F.lit(False).alias("asks")
    )
    asks = ordered.where("asks").select(
        *fixed, F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("cell"), F.lit(True).alias("asks")
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        position = table.column("position").to_numpy()
        x = _matrix(table.column("vec").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.float64())))
        window = windows[table.column("band")[0].as_py()] if table.num_rows else 0
        here, there = np.flatnonzero(~asks), np.flatnonzero(asks)
        taken, asker, score = [], [], []
        for start in range(0, len(there), 256):
            some = there[start : start + 256]
            if not len(here):
                break
            product = _products(x[some], x[here])
            near = np.abs(position[some][:, None] - position[here]) <= window
            ranked = np.where(near, product, -np.inf)
            if k < len(here):
                # everything that ties with the k-th stays
                least = -np.partition(-ranked, k - 1, axis=1)[:, k - 1]
            else:
                least = np.full(len(some), -np.inf)
            row, col = np.nonzero((product >= least[:, None]) & near)
            asker.append(some[row])
            taken.append(here[col])
            score.append(product[row, col])
        if taken:
            asker, taken, score = map(np.concatenate, (asker, taken, score))
        else:
            asker = taken = np.zeros(0, np.int64)
            score = np.zeros(0)
        uid = table.column("uid")
        return pa.table(
            {
                "asker": uid.take(pa.array(asker, pa.int64())),
                "uid": uid.take(pa.array(taken, pa.int64())),
                "ids": table.column("ids").take(pa.array(taken, pa.int64())),
                "score": pa.array(score, pa.float64()),
            }
        )

    cells = held.unionByName(asks).groupBy("curve", "cell")
    return cells.applyInArrow(run, "asker string, uid string, ids array<long>, score double")
