"""Token ids in binary files, with a minimal perfect hash index for access by key.

Rows are sorted by range of (key, hash of the text), so a key that very many rows share runs over several tasks. A task
encodes its rows as they come and closes a shard after so many rows or bytes. Shards hold the ids of consecutive
documents: a header, then nothing but ids; their numbers ascend with the keys, with gaps between tasks. Index
files hold, for the keys of one hash bucket, a minimal perfect hash function, and for each of its slots a fingerprint
of the key, the shard, the place and the length. A lookup opens one index file, computes one slot, compares the
fingerprint, and reads one run of ids. Files are written under a name of their own and then renamed, so a task that
runs again or twice does no harm.

Keys of other types than whole numbers are known to the index by a hash of 64 bits; two keys with the same hash are
found when the index is built, which then fails.

Defined cases: null text is the empty text, which still has its end id; a null key sorts first and can be looked up
as null; rows that repeat a key are told apart by ``copy`` (0, 1, .. in the order of their places); a key that is not in
the index is not found, but for one in 2^32; an empty table gives no shards.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from maskloom.llm.common import bound_batches, mix, name, texts_of
from maskloom.llm.library import encoder
from maskloom.session import qualified, scratch_path

SHARD_MAGIC, INDEX_MAGIC = b"MLIDS002", b"MLMPH002"
SHARD_HEADER = "<8sIQQ"  # magic, bytes an id, shard, number of ids
INDEX_HEADER = "<8sIIQQ"  # magic, bucket, levels, keys placed by levels, keys listed
ENTRY = np.dtype([("print", "<u4"), ("start", "<u4"), ("shard", "<u8"), ("length", "<u8")])
LISTED = np.dtype([("key", "<i8"), ("copy", "<i8")])
GAMMA, LEVELS = 2, 32
SHARD_BYTES = 2**26  # so that a place in a shard is a number of 32 bits
TASK_BITS = 32  # a shard's number: that of its task, then that within the task


# The hash function


def _hash(keys: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1B873593) % 2**64)
    return mix(mix(keys.astype(np.uint64) ^ start) + mix(copies.astype(np.uint64) + start))


def fingerprints(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return (_hash(keys, copies, 255) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of (key, copy): cascaded bit arrays, each holding the keys that met no other there.

    The slot is the number of set bits before the key's own. What is left after the last level is listed.
    """

    def __init__(self, levels: list[np.ndarray], listed: np.ndarray):
        self.levels, self.listed = levels, listed
        ones = [np.bitwise_count(level).astype(np.int64) for level in levels]
        ends = np.cumsum([0, *(int(x.sum()) for x in ones)])
        self.before = [end + np.concatenate([[0], np.cumsum(x)[:-1]]) for end, x in zip(ends, ones)]
        self.placed = int(ends[-1])
        self.extra = {(int(k), int(c)): self.placed + i for i, (k, c) in enumerate(listed.tolist())}

    @classmethod
    def build(cls, keys: np.ndarray, copies: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < LEVELS:
            words = max(1, math.ceil(GAMMA * len(keys) / 64))
            places = (_hash(keys, copies, len(levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(places, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            stay = ~alone[places]
            keys, copies = keys[stay], copies[stay]
        listed = np.zeros(len(keys), LISTED)
        listed["key"], listed["copy"] = keys, copies
        return cls(levels, listed)

    def slots(self, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """A slot for each key; any slot, or -1, for a key that is not in the set."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, (level, before) in enumerate(zip(self.levels, self.before)):
            if not len(open_):
                break
            places = _hash(keys[open_], copies[open_], i) % np.uint64(64 * len(level))
            word, bit = (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
            held = (level[word] >> bit) & np.uint64(1) == 1
            below = level[word[held]] & ((np.uint64(1) << bit[held]) - np.uint64(1))
            out[open_[held]] = before[word[held]] + np.bitwise_count(below)
            open_ = open_[~held]
        for i in open_:
            out[i] = self.extra.get((int(keys[i]), int(copies[i])), -1)
        return out

    def dump(self, bucket: int) -> bytes:
        sizes = np.array([len(x) for x in self.levels], "<u8").tobytes()
        head = struct.pack(INDEX_HEADER, INDEX_MAGIC, bucket, len(self.levels), self.placed, len(self.listed))
        return b"".join([head, sizes, *(x.astype("<u8").tobytes() for x in self.levels), self.listed.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, np.ndarray]:
        """The function and the entries that follow it."""
        magic, _, n_levels, placed, listed = struct.unpack_from(INDEX_HEADER, data)
        if magic != INDEX_MAGIC:
            raise ValueError("not an index file")
        at, levels = struct.calcsize(INDEX_HEADER) + 8 * n_levels, []
        for size in np.frombuffer(data, "<u8", n_levels, struct.calcsize(INDEX_HEADER)).tolist():
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        rest = np.frombuffer(data, LISTED, listed, at)
        return cls(levels, rest), np.frombuffer(data, ENTRY, placed + listed, at + rest.nbytes)


# Files


def _files(path: str):
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _save(path: str, chunks: Iterator[bytes], attempt: str) -> None:
    """Write under the attempt's own name, then rename."""
    system, place = _files(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{place}.{attempt}") as out:
        for chunk in chunks:
            out.write(chunk)
    try:
        system.move(f"{place}.{attempt}", place)
    except OSError:
        # some systems do not replace files: then an earlier attempt of the same task has done it
        if system.get_file_info(place).type.name != "File":
            raise
        system.delete_file(f"{place}.{attempt}")


def _attempt() -> str:
    from pyspark import TaskContext

    return f"attempt-{TaskContext.get().taskAttemptId()}"


def shard_file(path: str, shard: int) -> str:
    return f"{path}/shards/shard-{shard:015d}.ids"


def index_file(path: str, bucket: int) -> str:
    return f"{path}/index/index-{bucket:06d}.mph"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id", "copy"), F.lit(buckets)).cast("int")


def _id(key: Column, kind: T.DataType) -> Column:
    """What the index knows a key by: the number itself, or a hash of 64 bits of a key of another type."""
    return key.cast("long") if isinstance(kind, T.IntegralType) else F.when(key.isNotNull(), F.xxhash64(key))


class TokenStore:
    """A folder of shards and index files, and the table of shards."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, kind: T.DataType):
        self.spark, self.path, self.buckets, self.kind = spark, path, buckets, kind

    def entries(self) -> DataFrame:
        """What was written: key, copy, shard, start, length."""
        return self.spark.read.schema(_entry_schema(self.kind)).parquet(f"{self.path}/entries")

    def shards(self) -> DataFrame:
        """The place of each shard among all ids: shard, first, total. One row a shard."""
        totals = self.entries().groupBy("shard").agg(F.sum("length").alias("total"))
        earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("first"), "total")

    def keys(self, df: DataFrame, key: str) -> DataFrame:
        """The keys of a table, one for each row: rows that repeat a key ask for its copies in turn."""
        counted = df.groupBy(name(key).cast(self.kind).alias("key")).agg(F.count("*").alias("n"))
        return counted.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """For keys (``key``, ``copy``): shard, start and length as the index has them. Keys not found are left out."""
        path, buckets = self.path, self.buckets
        columns = ["key", "copy", "shard", "start", "length"]

        def run(batches):
            opened: dict[int, tuple] = {}
            for batch in batches:
                numbers = batch.column("bucket").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    bucket, rows = int(numbers[a]), batch.slice(a, b - a)
                    if bucket not in opened:
                        opened.clear()  # keys come bucket by bucket
                        system, place = _files(index_file(path, bucket))
                        with system.open_input_file(place) as file:
                            opened[bucket] = PerfectHash.load(file.read())
                    function, entries = opened[bucket]
                    key, copy = rows.column("id").to_numpy(), rows.column("inner").to_numpy()
                    slots = function.slots(key, copy)
                    found = slots >= 0
                    found[found] = entries["print"][slots[found]] == fingerprints(key[found], copy[found])
                    got, kept = entries[slots[found]], pa.array(found)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("key").filter(kept), rows.column("copy").filter(kept)]
                        + [pa.array(got[c].astype(np.int64)) for c in columns[2:]],
                        names=columns,
                    )

        wanted = keys.select(
            name("key").cast(self.kind).alias("key"),
            F.col("copy").cast("long").alias("copy"),
            _id(F.col("key"), self.kind).alias("id"),
        ).withColumn("bucket", _bucket(buckets))
        wanted = wanted.select("key", "copy", *_inner(), "bucket")
        dealt = wanted.repartition(_tasks(self.spark, buckets), "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(run, _entry_schema(self.kind))

    def read(self, keys: DataFrame) -> DataFrame:
        """The ids of each key (``key``, ``copy``), as little-endian unsigned 32-bit, with their place."""
        path, head = self.path, struct.calcsize(SHARD_HEADER)

        def run(batches):
            shard, file = None, None
            for batch in batches:
                ids = []
                for number, start, length in zip(
                    batch.column("shard").to_pylist(),
                    batch.column("start").to_pylist(),
                    batch.column("length").to_pylist(),
                ):
                    if number != shard:
                        if file is not None:
                            file.close()
                        system, place = _files(shard_file(path, number))
                        shard, file = number, system.open_input_file(place)
                        magic, width, _, _ = struct.unpack(SHARD_HEADER, file.read(head))
                        if magic != SHARD_MAGIC:
                            raise ValueError("not a shard")
                    file.seek(head + width * start)
                    data = np.frombuffer(file.read(width * length), f"<u{width}")
                    if len(data) != length:
                        raise ValueError(f"shard {number} ends before {start} + {length}")
                    ids.append(data.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=names)
            if file is not None:
                file.close()

        names = ["key", "copy", "shard", "start", "length", "ids"]
        found = self.lookup(keys)
        dealt = found.repartition(_tasks(self.spark, self.buckets), "shard").sortWithinPartitions("shard", "start")
        return dealt.mapInArrow(run, _entry_schema(self.kind).add("ids", T.BinaryType()))


def _entry_schema(kind: T.DataType) -> T.StructType:
    rest = [T.StructField(c, T.LongType()) for c in ("copy", "shard", "start", "length")]
    return T.StructType([T.StructField("key", kind), *rest])


def _inner() -> list[Column]:
    """The numbers that the hash function takes: ``id`` and ``inner``; the null key is 0 with copies below 0."""
    return [
        F.coalesce("id", F.lit(0)).alias("id"),
        F.when(F.col("key").isNull(), -1 - F.col("copy")).otherwise(F.col("copy")).alias("inner"),
    ]


def _tasks(spark: SparkSession, parts: int) -> int:
    return max(1, min(parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts // 4)))


def write_store(
    df: DataFrame,
    key: str,
    text: str,
    vocabulary: str,
    end_id: int,
    path: str | None = None,
    rows_per_shard: int = 4096,
) -> TokenStore:
    """Encode the texts, each followed by ``end_id``, and write shards and index.

    ``path`` must be a folder that all executors share; without it a fresh one in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = qualified(spark, path) if path else scratch_path(spark, "token-store")
    buckets = max(1, math.ceil(df.count() / rows_per_shard))
    kind = df.schema[key].dataType
    kind = T.LongType() if isinstance(kind, T.IntegralType) else kind
    # null text is the empty text; equal rows have equal ids and may go anywhere among each other
    narrow = df.select(name(key).cast(kind).alias("key"), F.coalesce(name(text), F.lit("")).alias("text"))
    narrow = narrow.withColumn("digest", F.xxhash64("text")).withColumn("salt", F.rand(7))
    order = [F.col("key").asc_nulls_first(), F.col("digest"), F.col("salt")]
    dealt = narrow.repartitionByRange(_tasks(spark, buckets), *order).sortWithinPartitions(*order)
    width = 2 if _largest_id(vocabulary, end_id) < 2**16 else 4
    schema = _entry_schema(kind)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def write(batches):
        """Rows arrive by key. A shard's ids are held until it is complete; it is bounded in rows and bytes, save for
        the one row that passes the bound. Copies of a key are counted within the task."""
        from pyspark import TaskContext

        attempt, shard = _attempt(), TaskContext.get().partitionId() << TASK_BITS
        encode, end = encoder(vocabulary, False), np.asarray([end_id], f"<u{width}").tobytes()
        held, n_rows, total, last, copy = [], 0, 0, (), 0

        def finish():
            head = struct.pack(SHARD_HEADER, SHARD_MAGIC, width, shard, total)
            _save(shard_file(path, shard), iter([head, *held]), attempt)

        for batch in batches:
            rows = []
            keys = batch.column(0).to_pylist()
            for k, ids in zip(keys, encode(texts_of(batch.column(1)))):
                if n_rows and (n_rows >= rows_per_shard or total * width > SHARD_BYTES):
                    finish()
                    shard, held, n_rows, total = shard + 1, [], 0, 0
                copy = copy + 1 if k == last else 0
                ids = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                n = len(ids) // width + 1
                rows.append((k, copy, shard, total, n))
                held += [ids, end]
                n_rows, total, last = n_rows + 1, total + n, k
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=schema.fieldNames()
                )
        if n_rows:
            finish()

    written = dealt.select("key", "text").mapInArrow(write, schema)
    written.write.parquet(f"{path}/entries-by-task")
    _number_copies(spark.read.schema(schema).parquet(f"{path}/entries-by-task")).write.parquet(f"{path}/entries")
    store = TokenStore(spark, path, buckets, kind)
    _write_index(store)
    return store


def _number_copies(entries: DataFrame) -> DataFrame:
    """Number the copies of keys that run over several tasks on from task to task."""
    task = F.shiftright("shard", TASK_BITS)
    place = F.struct("shard", "start")
    ends = entries.groupBy(task.alias("task")).agg(
        F.array(F.struct(F.min_by("key", place).alias("key")), F.struct(F.max_by("key", place).alias("key"))).alias("e")
    )
    ends = ends.select("task", F.explode(F.array_distinct("e")).alias("e")).select("task", "e.key")
    # at most two keys a task, so these tables are as small as the number of tasks
    over = ends.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    if over.isEmpty():
        return entries
    here = entries.withColumn("task", task)
    same = F.col("key").eqNullSafe(F.col("_key"))
    counts = here.join(F.broadcast(over), same).groupBy("_key", F.col("task").alias("_task")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_key", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    copy = (F.col("copy") + F.coalesce("_before", F.lit(0))).alias("copy")
    joined = here.join(F.broadcast(before), same & (F.col("task") == F.col("_task")), "left")
    return joined.select("key", copy, "shard", "start", "length")


def _largest_id(vocabulary: str, end_id: int) -> int:
    import json

    data = json.loads(vocabulary)
    return max(end_id, *data["model"]["vocab"].values(), *(t["id"] for t in data["added_tokens"]))


def _write_index(store: TokenStore) -> None:
    path = store.path

    def run(batches):
        attempt = _attempt()
        bucket, held = None, []

        def finish():
            table = pa.Table.from_batches(held)
            key, copy = table["id"].to_numpy(), table["inner"].to_numpy()
            if len(np.unique(np.stack([key, copy]), axis=1).T) < len(key):
                raise ValueError("two keys have the same hash")
            function = PerfectHash.build(key, copy)
            entries = np.zeros(len(key), ENTRY)
            at = function.slots(key, copy)
            entries["print"][at] = fingerprints(key, copy)
            for column in ("shard", "start", "length"):
                entries[column][at] = table[column].to_numpy()
            _save(index_file(path, bucket), iter([function.dump(bucket), entries.tobytes()]), attempt)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32())], names=["bucket"])

        for batch in batches:
            numbers = batch.column("bucket").to_numpy()
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for a, b in zip([0, *edges], [*edges, len(numbers)]):
                if a == b:
                    continue
                if bucket is not None and numbers[a] != bucket:
                    yield finish()
                    held = []
                bucket = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield finish()

    keyed = store.entries().withColumn("id", _id(F.col("key"), store.kind)).withColumn("bucket", _bucket(store.buckets))
    keyed = keyed.select(*_inner(), "shard", "start", "length", "bucket")
    dealt = keyed.repartition(_tasks(store.spark, store.buckets), "bucket").sortWithinPartitions("bucket")
    dealt.mapInArrow(run, "bucket int").write.parquet(f"{path}/index-done")
