"""What the operators share: batch functions over documents, caches, bounded samples, hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.session import BATCH_CONF, bound_batches  # noqa: F401

ROWS = 512
MEMO = 400_000


def name(column: str) -> Column:
    """A column whose name may hold dots or blanks."""
    return F.col("`" + column.replace("`", "``") + "`")


def annotate(
    df: DataFrame, inputs: list[str], kernel: Callable, fields: str, keep: list[str] | None = None
) -> DataFrame:
    """Add columns computed from whole batches; ``keep`` are the columns that stay, all by default.

    ``kernel()`` is called once a task and returns a function of one Arrow array per input, which returns one
    Arrow array per field. A kept column with the name of a field is replaced.
    """
    bound_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    source = df.select(
        F.struct(*map(name, keep)).alias("row"), *[name(c).alias(f"in{i}") for i, c in enumerate(inputs)]
    )
    new = T._parse_datatype_string(fields)
    schema = T.StructType([source.schema["row"], *new.fields])
    names = schema.fieldNames()

    def run(batches):
        work = kernel()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                columns = work(*[part.column(i) for i in range(1, part.num_columns)])
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    out = source.mapInArrow(run, schema)
    taken = {f.name.lower() for f in new.fields}
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in keep if c.lower() not in taken], *[f.name for f in new.fields]
    )


def texts_of(array: pa.Array) -> list[str]:
    """Strings; null is the empty string."""
    return [x if x is not None else "" for x in array.to_pylist()]


def words_of(text: str) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]``, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


class Memo(dict):
    """A dictionary that computes what is missing and holds at most about ``limit`` entries.

    When half of them are new, the older half goes, save what has been asked for again meanwhile.
    """

    def __init__(self, compute: Callable | None = None, limit: int = MEMO):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def store(self, key, value) -> None:
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def recall(self, keys) -> list:
        """Of distinct keys those that are in neither half; the others are in the new half afterwards."""
        missing, old = [key for key in keys if key not in self], self.old
        if not old:
            return missing
        self.update({key: old[key] for key in missing if key in old})
        return [key for key in missing if key not in old]

    def turn(self) -> None:
        """Let the older half go when the new one is full. Not between ``recall`` and the use of what it recalled."""
        if len(self) >= self.limit // 2:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.store(key, value)
        return value


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose key has the smallest hashes; the same rows in every run.

    A bound on the hash comes from counts first, so that the tasks together send about as many rows as are wanted to the
    sort, and not each of them so many. ``df`` is read up to three times.
    """
    hashed = F.xxhash64(name(key))
    rows = df.count()
    share = 1.2 * most / max(rows, 1)
    few = df
    while share < 1:
        few = df.where(hashed <= F.lit(int(share * 2**64) - 2**63).cast("long"))
        if few.count() >= most:
            break
        few, share = df, 2 * share
    return few.orderBy(hashed, name(key)).limit(most)


def key_remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null keys count as the empty text."""
    return F.crc32(F.coalesce(name(key).cast("string"), F.lit("")).cast("binary")) % divisor


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One number for each run of ``size`` neighbours; a shorter sequence is one run."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    last = len(hashes) - size + 1
    out = np.full(last, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + last])
    return out
