"""Near-duplicate documents by MinHash, banding, verification and connected components.

Documents with the same set of shingles are one class, found by a digest of the set, so copies are never paired. Each
class has a signature of minima under universal hash functions; bands of the signature are bucket keys. Links come in
two steps. First every class of a bucket is compared with the bucket's centre, the class that shares the most buckets:
by signature, then on the full sets. Then components are found, and only buckets that still hold more than one are
looked at again: the classes outside a bucket's main component meet all its classes, in cells of bounded size, on full
sets. So no two classes of a bucket stay uncompared unless they are connected anyway, and no step emits the pairs of a
group. Components come from alternating large-star and small-star steps.

Defined cases: a null key takes no part, its row has a null component and is kept; null, empty and blank texts have
no shingles and are linked with nothing; a text with fewer words than a shingle is one shingle; repeated rows are one
class; more columns of the input are carried along, and one with the name of an output is replaced. The number of
bands follows from the wanted similarity (``banding``).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import annotate, list_array, mix, name, texts_of, window_hashes, word_hashes
from maskloom.session import materialise

# A pair at the wanted similarity shares no band with at most this chance, with about this many minima.
MISS, MINIMA = 3e-7, 200
CELL = 128


def banding(percent: int) -> tuple[int, int]:
    """Minima a band, as many as fit, and the number of bands."""
    if percent >= 100:
        return 8, 1  # equal sets are one class already

    def bands(rows: int) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))

    rows = 1
    while (rows + 1) * bands(rows + 1) <= MINIMA:
        rows += 1
    return rows, bands(rows)


def lower_ascii(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit numbers."""
    return np.unique(window_hashes(word_hashes(lower_ascii(text).split()), size))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Universal hash functions: odd multipliers and offsets; the upper half of the product is the hash."""
    rng = np.random.default_rng(20_220_601)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minima(values: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), 2**32 - 1, np.uint64)
    for start in range(0, len(values), 2048):
        block = values[start : start + 2048, None] * factors
        block += offsets
        block >>= np.uint64(32)
        np.minimum(out, block.min(axis=0), out=out)
    return out


def signatures(df: DataFrame, text: str, size: int, percent: int, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_shingles``, ``node`` (digest of the set; null if empty), ``sketch`` (a byte for each minimum) and
    ``bands`` (one bucket key for each band)."""

    n_rows, n_bands = banding(percent)

    def kernel():
        factors, offsets = _functions(n_rows * n_bands)
        seeds = mix(np.arange(1, n_bands + 1, dtype=np.uint64))

        def work(array):
            n, node, sketch, bands = [], [], [], []
            for t in texts_of(array):
                found = shingles(t, size)
                n.append(len(found))
                if not len(found):
                    node.append(None)
                    sketch.append(None)
                    continue
                node.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                low = minima(found, factors, offsets)
                sketch.append(low.astype(np.uint8).tobytes())
                key = seeds.copy()
                for column in low.reshape(n_bands, n_rows).T:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
                bands.append(key)
            values = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
            lengths = np.where(np.array(n, np.int64) > 0, n_bands, 0)
            return [
                pa.array(n, pa.int64()),
                pa.array(node, pa.binary()),
                pa.array(sketch, pa.binary()),
                list_array(values, lengths, pa.int64()),
            ]

        return work

    return annotate(df, [text], kernel, "n_shingles long, node binary, sketch binary, bands array<long>", keep)


def shingle_sets(df: DataFrame, text: str, size: int) -> DataFrame:
    """``node`` and ``shingles`` (sorted little-endian 64-bit numbers) of each text."""

    def kernel():
        def work(array):
            found = [shingles(t, size) for t in texts_of(array)]
            return [
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()),
                pa.array([s.tobytes() for s in found], pa.binary()),
            ]

        return work

    return annotate(df, [text], kernel, "node binary, shingles binary", df.columns)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets' intersection is at least ``percent`` hundredths of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _likely(a: str, b: str, percent: int) -> F.Column:
    """Signatures agree about as often as the sets' similarity says, less five standard deviations."""

    n = math.prod(banding(percent))
    p = percent / 100
    least = int(n * p - 5 * (n * p * (1 - p)) ** 0.5)

    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(left.to_pylist()), np.uint8).reshape(-1, n)
        y = np.frombuffer(b"".join(right.to_pylist()), np.uint8).reshape(-1, n)
        return pa.array((x == y).sum(axis=1) >= least)

    return F.arrow_udf(count, "boolean")(F.col(a), F.col(b))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = [
                linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent)
                for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a binary, b binary")


def _cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """In each cell, links between classes of different components, where one of the two stands outside the main one.

    A link joins two components, so a cell emits fewer links than it has classes.
    """

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        root = table.column("root").to_pylist()
        outside = np.flatnonzero(table.column("outside").to_numpy())
        inside = table.column("member").to_numpy()
        known = {r: r for r in root}

        def find(x):
            while known[x] != x:
                known[x] = known[known[x]]
                x = known[x]
            return x

        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        links = []
        for i in outside:
            held = np.zeros(len(values), bool)
            held[numbers[starts[i] : starts[i] + sizes[i]]] = True
            both = np.add.reduceat(held[numbers].astype(np.int64), starts)
            near = inside & (100 * both >= percent * (sizes + sizes[i] - both))
            for j in np.flatnonzero(near):
                x, y = find(root[i]), find(root[j])
                if x != y:
                    links.append((root[i], root[j]))
                    known[x] = y
        return pa.table(
            {"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())}
        )

    return cells.groupBy("key", "cell", "block").applyInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, its smallest connected node, for every node of ``links`` (a, b).

    Large-star: every larger neighbour of a node is linked to the node's smallest neighbour. Small-star: the smaller
    neighbours and the node itself are. Each step takes the smallest by a partial aggregate and joins it back, so a
    node with very many neighbours is split over tasks; it ends when neither step changes the links.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = materialise(edges, "links")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # written first, so that the join below can split a node with very many neighbours over tasks
        least = materialise(least, "large-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large.where("u > v"), "large-star")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small-least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        edges = materialise(small.where("u > v").distinct(), "small-star")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of links does."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)
    ).first()
    return tuple(row)


OUTPUTS = ["n_shingles", "node", "root", "component_id"]


def _classified(
    df: DataFrame, key: str, text: str, size: int, percent: int, kept: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Every row as ``row`` (the kept columns, so that no name clashes), ``id``, ``n_shingles`` and ``node``; and every
    class as ``node``, ``first`` (its smallest key), ``root`` and ``component`` (the smallest key reached)."""
    plain = df.select(F.struct(*map(name, kept)).alias("row"), name(key).alias("id"), name(text).alias("text"))
    rows = materialise(signatures(plain, "text", size, percent, ["row", "id"]), "signatures")
    with_id = rows.where(F.col("id").isNotNull() & F.col("node").isNotNull())
    classes = with_id.groupBy("node").agg(
        F.min("id").alias("first"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    classes = materialise(classes, "classes")

    # buckets with more than one class
    banded = classes.select("node", F.explode("bands").alias("key"))
    # such sums are written before they are joined: only then can a join split a hot key over tasks
    several = materialise(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = materialise(banded.join(several, "key"), "members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighted = members.select("key", "node").join(weights, "node")
    centres = weighted.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"))
    centres = materialise(centres.select("key", F.col("top.node").alias("a")), "centres")
    pairs = members.select("key", F.col("node").alias("b")).join(centres, "key").where("a != b")
    pairs = pairs.select("a", "b").distinct()

    # the full sets of the classes in such buckets, from the texts
    wanted = weights.select("node").join(classes.select("node", "first"), "node").select("first", "node")
    chosen = df.select(name(key).alias("first"), name(text).alias("_text")).join(
        wanted.select("first").distinct(), "first"
    )
    sets = shingle_sets(chosen, "_text", size).select("first", "node", "shingles")
    # a repeated key may bring other texts along
    sets = materialise(sets.join(wanted, ["first", "node"], "left_semi").select("node", "shingles"), "sets")

    sketches = classes.select("node", "sketch")
    likely = (
        pairs.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("_b")), "b")
        .join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("_a")), "a")
        .where(_likely("_a", "_b", percent))
        .select("a", "b")
    )
    first = materialise(_verified(likely, sets, percent), "first-links")
    roots = materialise(components(first), "first-components")

    # what the centres left open
    placed = members.join(roots, "node", "left").select(
        "key", "node", "size", F.coalesce("root", "node").alias("root")
    )
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("size")
    )
    main = main.where("parts > 1").select(
        "key",
        F.col("top.root").alias("main"),
        F.ceil(F.col("size") / CELL).cast("int").alias("cells"),
        F.ceil((F.col("size") - F.col("top.n")) / CELL).cast("int").alias("blocks"),
    )
    main = materialise(main, "open-buckets")
    unsure = placed.select("key", "node", "root").join(main, "key")
    dealt = F.pmod(F.xxhash64("node", "key"), F.lit(2**31))
    cell, block = (dealt % F.col("cells")).cast("int"), (dealt % F.col("blocks")).cast("int")
    as_member = unsure.select(
        "key", "node", "root", cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    as_outside = unsure.where("root != main").select(
        "key", "node", "root", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), block.alias("block")
    )
    cells = (
        as_member.withColumns({"member": F.lit(True), "outside": F.lit(False)})
        .unionByName(as_outside.withColumns({"member": F.lit(False), "outside": F.lit(True)}))
        .groupBy("key", "cell", "block", "node", "root")
        .agg(F.max("member").alias("member"), F.max("outside").alias("outside"))
        .join(sets, "node")
        .select("key", "cell", "block", "root", "member", "outside", "shingles")
    )
    second = materialise(_cell_links(cells, percent), "second-links")
    if second.isEmpty():
        final = roots
    else:
        merged = components(second)
        merged = merged.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
        old = roots.union(second.select(F.col("a").alias("node"), F.col("a").alias("root"))).union(
            second.select(F.col("b").alias("node"), F.col("b").alias("root"))
        )
        final = old.distinct().join(merged, F.col("root") == F.col("_old"), "left")
        # a single class of the first step may be the root of a second component
        final = final.select("node", F.coalesce("_new", "root").alias("root")).distinct()

    named = final.join(classes.select("node", "first"), "node")
    named = materialise(named, "named")
    smallest = materialise(named.groupBy("root").agg(F.min("first").alias("_least")), "smallest")
    reached = named.join(smallest, "root").select("node", "root", "_least")
    by_class = classes.select("node", "first").join(reached, "node", "left")
    by_class = by_class.select("node", "first", "root", F.coalesce("_least", "first").alias("component"))
    return rows.select("row", "id", "n_shingles", "node"), materialise(by_class, "reached")


def near_duplicates(
    df: DataFrame, key: str, text: str, size: int = 5, percent: int = 80, keep: list[str] | None = None
) -> DataFrame:
    """Add ``n_shingles``, ``node`` (the class), ``root`` (the component, null where a document has no links) and
    ``component_id``, the smallest key that can be reached over links between documents."""
    kept = [key] if keep is None else list(dict.fromkeys([key, *keep]))
    rows, reached = _classified(df, key, text, size, percent, kept)
    out = rows.join(reached.drop("first"), "node", "left")
    component = F.when(F.col("id").isNotNull() & F.col("node").isNull(), F.col("id")).when(
        F.col("id").isNotNull(), F.col("component")
    )
    carried = [F.col("row").getField(c).alias(c) for c in kept if c.lower() not in OUTPUTS]
    return out.select(*carried, "n_shingles", "node", "root", component.alias("component_id"))


def distinct_documents(df: DataFrame, key: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of near copies, that of the smallest key; rows without a key or a shingle stay.

    Which classes lead a component is known before rows are joined, so each row travels once, under its key and
    class: copies of one text do not meet in one task, and repeats of a row are thinned out before they travel.
    """
    rows, reached = _classified(df, key, text, size, percent, df.columns)
    leaders = reached.where(F.col("first") == F.col("component"))
    # a repeated key may lead several classes of one component
    best = leaders.groupBy(F.col("first").alias("id"), F.coalesce("root", "node").alias("_of")).agg(
        F.min("node").alias("node")
    )
    whole = F.col("id").isNotNull() & F.col("node").isNotNull()
    same = Window.partitionBy("id", "node").orderBy("n_shingles")
    once = rows.where(whole).withColumn("_turn", F.row_number().over(same)).where("_turn = 1")
    kept = once.join(best.select("id", "node"), ["id", "node"], "left_semi")
    return kept.select("row").union(rows.where(~whole).select("row")).select("row.*")


def one_of_each(df: DataFrame, key: str) -> DataFrame:
    """Of the result of ``near_duplicates``, one row of each component: that of the smallest key."""
    whole = F.col("node").isNotNull() & name(key).isNotNull()
    rest = df.where(whole & (name(key) == F.col("component_id")))
    # a repeated key whose texts are near copies of each other, or the same row twice
    by_root = Window.partitionBy(name(key), F.coalesce("root", "node")).orderBy("node", "n_shingles")
    turn = "_turn"
    while turn in df.columns:
        turn += "_"
    first = rest.withColumn(turn, F.row_number().over(by_root)).where(F.col(turn) == 1).drop(turn)
    return first.unionByName(df.where(~whole))
