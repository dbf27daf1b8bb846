"""Best-fit packing of documents into sequences of fixed size, by bin completion.

Lengths are few however many documents there are, so the search works on counts per length. It takes the largest
length left, enumerates the undominated fillings of the rest of its sequence, best fit first, and applies the chosen
one as often as the counts allow. The first dive is the best-fit solution and the first incumbent; the search goes
back only while the bound on waste still allows fewer sequences. Documents then find their place by their number
among those of equal length, which is counted per bucket of keys, so no length gathers in one task.

Defined cases: null text is the empty text, which still has its end id; only documents longer than a sequence are
cut, their first piece takes what is left over; equal documents and repeated rows each get a place of their own; an
empty table gives no rows; more columns of the pieces are carried along, and one with the name of an output is
replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import annotate, name, texts_of
from maskloom.llm.library import encoder
from maskloom.session import materialise

ROWS_PER_BUCKET = 5_000


# Documents to pieces


def cut_documents(
    df: DataFrame, text: str, vocabulary: str, end_id: int, size: int, keep: list[str] | None = None
) -> DataFrame:
    """One row per piece: ``piece`` (from 0), ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit)."""

    def kernel():
        encode, end = encoder(vocabulary, True), np.asarray([end_id], "<u4").tobytes()

        def work(array):
            rows = []
            for ids in encode(texts_of(array)):
                ids += end
                n = len(ids) // 4
                first = n % size or size
                cuts = [0, *range(first, n + 1, size)]
                rows.append(
                    [
                        {"piece": i, "start": a, "length": b - a, "ids": ids[4 * a : 4 * b]}
                        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
                    ]
                )
            kind = pa.struct(
                [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
            )
            return [pa.array(rows, pa.list_(kind))]

        return work

    kept = df.columns if keep is None else keep
    out = annotate(
        df, [text], kernel, "_pieces array<struct<piece: int, start: long, length: long, ids: binary>>", kept
    )
    taken = {"piece", "start", "length", "ids"}
    rest = [name(c) for c in kept if c.lower() not in taken]
    return out.select(*rest, F.inline("_pieces"))


# The plan


def lower_bound(counts: np.ndarray, size: int) -> int:
    """No packing has fewer sequences: by total length, and by lengths of which no two fit together."""
    total = int((np.arange(len(counts)) * counts).sum())
    return max(math.ceil(total / size), int(counts[size // 2 + 1 :].sum()))


def _dominated(filling: tuple[int, ...], left: int, usable: list[int]) -> bool:
    """Some item that was left out could stand for some of the filling and waste no more."""
    if len(filling) > 10:
        return False
    sums: dict[int, int] = {}
    for item in filling:
        for s, n in list(sums.items()):
            sums[s + item] = max(sums.get(s + item, 0), n + 1)
        sums[item] = max(sums.get(item, 0), 1)
    chosen = set(filling)
    for s, n in sums.items():
        for x in range(s if n > 1 else s + 1, s + left + 1):
            if x < len(usable) and usable[x] and x not in chosen:
                return True
    return False


def fillings(room: int, counts: list[int], most: int, steps: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first; at most ``most``, found in at most ``steps`` steps."""
    sizes = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s]]
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [steps]

    def extend(at: int, left: int, chosen: tuple[int, ...]) -> bool:
        """True when the search should end."""
        full = True
        for i in range(at, len(sizes)):
            item = sizes[i]
            if item > left or (chosen and item == chosen[-1] and chosen.count(item) >= counts[item]):
                continue
            if not counts[item]:
                continue
            full = False
            budget[0] -= 1
            if budget[0] < 0 or extend(i, left - item, (*chosen, item)):
                return True
        if full and not _dominated(chosen, left, counts):
            found.append((left, chosen))
            return sum(1 for waste, _ in found if waste == 0) >= most
        return False

    extend(0, room, ())
    if not found:
        # out of steps before the first one: the largest that fits, again and again
        left, chosen, used = room, (), {}
        for item in sizes:
            while item <= left and used.get(item, 0) < counts[item]:
                chosen, left, used[item] = (*chosen, item), left - item, used.get(item, 0) + 1
        found.append((left, chosen))
    found.sort(key=lambda x: (x[0], len(x[1])))
    return [chosen for _, chosen in found[:most]]


def plan(counts: np.ndarray, size: int, width: int = 4, nodes: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) for the given number of pieces of each length.

    Branch and bound over ``nodes`` nodes with ``width`` fillings each; it ends early when the incumbent meets the
    lower bound. Every piece is placed whatever the limits are; they only bound how long better plans are looked for.
    """
    counts = np.asarray(counts, np.int64)
    least, total = lower_bound(counts, size), int((np.arange(len(counts)) * counts).sum())
    best: list | None = None
    fewest = math.inf
    # a node: counts, sequences so far, waste so far, plan so far (a linked list)
    stack: list[tuple[list[int], int, int, tuple | None]] = [(counts.tolist(), 0, 0, None)]
    while stack and nodes > 0:
        now, used, waste, done = stack.pop()
        nodes -= 1
        # fewer sequences than the incumbent leave only so much waste
        if best is not None and waste > (fewest - 1) * size - total:
            continue
        largest = next((s for s in range(size, 0, -1) if now[s]), 0)
        if not largest:
            if used < fewest:
                fewest, best = used, []
                while done is not None:
                    best.append(done[0])
                    done = done[1]
                if fewest <= least:
                    break
            continue
        now[largest] -= 1
        options = fillings(size - largest, now, width, 400)
        now[largest] += 1
        for filling in reversed(options):
            chosen = (largest, *filling)
            need = {s: chosen.count(s) for s in set(chosen)}
            times = min(now[s] // n for s, n in need.items())
            rest = list(now)
            for s, n in need.items():
                rest[s] -= n * times
            wasted = (size - sum(chosen)) * times
            stack.append((rest, used + times, waste + wasted, ((chosen, times), done)))
    if best is None:
        # the node limit was reached during the first dive: finish it best fit first
        best = []
        while done is not None:
            best.append(done[0])
            done = done[1]
        while any(now):
            largest = next(s for s in range(size, 0, -1) if now[s])
            now[largest] -= 1
            filling = fillings(size - largest, now, 1, 100)[0]
            now[largest] += 1
            chosen = (largest, *filling)
            need = {s: chosen.count(s) for s in set(chosen)}
            times = min(now[s] // n for s, n in need.items())
            for s, n in need.items():
                now[s] -= n * times
            best.append((chosen, times))
    return best


# Places


def _numbered(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Each piece as ``row``, with its ``length`` and ``number``, 0..n-1 among the pieces of equal length.

    Only buckets of keys are sorted, never a length. The columns of a piece lie in a struct, so that none clashes.
    """
    rows = pieces.count()
    buckets = max(1, math.ceil(rows / ROWS_PER_BUCKET))
    order = [F.col("row").getField(k) for k in keys]
    tagged = pieces.select(F.struct("*").alias("row"), name("length").alias("length"))
    tagged = tagged.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = tagged.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = tagged.withColumn("rank", F.row_number().over(inside) - 1)
    number = (F.col("first") + F.col("rank")).cast("long").alias("number")
    return ranked.join(starts, ["length", "bucket"]).select("row", "length", number)


def _slots(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For runs of numbers within a length: where the run starts, its copies a sequence, first sequence, offset."""
    rows, taken, sequence = [], {}, 0
    for lengths, times in chosen:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            copies = lengths.count(length)
            rows.append((length, taken.get(length, 0), copies, sequence, offset))
            taken[length] = taken.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def pack(pieces: DataFrame, keys: list[str], size: int, width: int = 4, nodes: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``size``; such columns are replaced.

    ``keys`` tell pieces apart (more columns may be given where keys repeat). ``pieces`` is read three times; pass a
    table, not a costly plan.
    """
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``size`` rows
    counts = np.zeros(size + 1, np.int64)
    for row in found:
        if row["length"] is None or not 0 < row["length"] <= size:
            raise ValueError(f"a piece has length {row['length']}, not 1 to {size}")
        counts[row["length"]] = row["n"]
    of, first, copies, sequence, offset = _slots(plan(counts, size, width, nodes))
    search = of << 44 | first

    numbered = _numbered(pieces, keys)

    def kernel():
        def work(lengths, numbers):
            length, number = lengths.to_numpy(), numbers.to_numpy()
            at = np.searchsorted(search, length << 44 | number, "right") - 1
            within = number - first[at]
            places = offset[at] + within % copies[at] * length
            return [pa.array(sequence[at] + within // copies[at], pa.int64()), pa.array(places, pa.int64())]

        return work

    places = annotate(numbered, ["length", "number"], kernel, "sequence_id long, offset long", ["row"])
    new = ["sequence_id", "offset"]
    carried = [F.col("row").getField(c).alias(c) for c in pieces.columns if c.lower() not in new]
    return places.select(*carried, *new)


def pack_documents(
    df: DataFrame, key: str, text: str, vocabulary: str, end_id: int, size: int, with_ids: bool = True
) -> DataFrame:
    """Pieces of all documents with their places. Ids stay in the table or are reduced to ``ids_crc32``."""
    pieces = cut_documents(df.select(name(key), name(text)), text, vocabulary, end_id, size, [key])
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    if not with_ids:
        pieces = pieces.drop("ids")
    pieces = materialise(pieces, "pieces")
    return pack(pieces, [key, "piece", "ids_crc32"], size)

