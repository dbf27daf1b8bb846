"""How the sources of a language differ in their terms: exact divergences over the matrix of counts.

Terms are runs of letters and of characters beyond ASCII; only A to Z are lower-cased. A language keeps the terms that
at least ``least`` of its documents hold. For each language there is a matrix of counts: a row for each source, a
column for each kept term. It is cut into tiles of ``ROWS`` sources and some ``TILE`` terms, and each tile is held as
quadtrees (K = 2) over squares of ``ROWS`` by ``ROWS``: a node exists where its quadrant holds a count. To compare the
sources of two tiles their trees are walked together: a quadrant in which neither holds a count is left at once, and
all its terms have the same price for a pair of sources, which is known from the sources' totals alone. So the work
grows with the counts, not with the matrix; tiles without counts never exist.

All numbers are whole: p = 1 + floor(SCALE * (count + 1) / (N + V)), with N the sum of the source's counts over the V
kept terms, and a term adds floor((p - q)^2 / q).

Defined cases: null texts, languages and sources are empty strings; each row is a document of its own, repeated or not;
a language without kept terms has divergence 0 between all its sources; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import bound_batches, name, texts_of
from maskloom.session import broadcast_if_small, materialise

SCALE = 1_000_000_000
ROWS = 64
LEVELS = 6
TILE, CELLS = 1024, 2**18
LANGUAGES = 10_000
HELD = 400_000
# every byte that is not of a term becomes a blank; bytes of characters beyond ASCII are of terms
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in their order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def count_terms(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), summed up for each task and then for all."""
    bound_batches(df.sparkSession)
    columns = [F.coalesce(name(c).cast("string"), F.lit("")) for c in (lang, source, text)]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        counts: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}

        def give():
            for group, held in counts.items():
                terms, seen = list(held), docs[group]
                columns = [[group[0]] * len(terms), [group[1]] * len(terms), terms, list(held.values())]
                columns.append([seen[t] for t in terms])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            counts.clear()
            docs.clear()

        for batch in batches:
            for at_lang, at_source, at in zip(*(texts_of(batch.column(i)) for i in range(3))):
                group, terms = (at_lang, at_source), terms_of(at)
                if group not in counts:
                    counts[group], docs[group] = Counter(), Counter()
                counts[group].update(terms)
                docs[group].update(set(terms))
            if sum(map(len, counts.values())) > HELD:
                yield from give()
        yield from give()

    partial = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, exact for every count a long can hold."""
    above = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, (total + kept).cast("decimal(19,0)"))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The counts that the reports are made from.

    ``groups``: lang, source, place (0.. in its language), sources (of the language), total, kept (terms of the
    language). ``entries``: lang, source, term, n, and of the language's term: all (occurrences), tile, column.
    """

    def __init__(self, df: DataFrame, text: str, lang: str, source: str, least: int = 3):
        counts = count_terms(df, text, lang, source)
        # rows of a term: one for each source of the language
        term = Window.partitionBy("lang", "term")
        kept = counts.select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("n").over(term).alias("all"),
            F.sum("docs").over(term).alias("docs"),
            (F.row_number().over(term.orderBy("source")) == 1).cast("long").alias("first"),
        ).where(F.col("docs") >= least)
        kept = materialise(kept.drop("docs"), "kept-terms")
        of_lang = materialise(
            kept.groupBy("lang").agg(
                F.sum("first").alias("kept"), F.sum("n").alias("lang_total"), F.count("*").alias("cells")
            ),
            "languages",
        )
        # a tile takes the terms of one hash; inside it frequent terms come first, so that what is rare lies together
        tiles = F.ceil(F.greatest(F.col("kept") / TILE, F.col("cells") / CELLS))
        inside = Window.partitionBy("lang", "tile").orderBy(F.col("all").desc(), "term")
        of_each = of_lang.select("lang", "kept", "lang_total", tiles.alias("tiles"))
        placed = kept.drop("first").join(broadcast_if_small(of_each, LANGUAGES), "lang")
        placed = placed.withColumn("tile", F.pmod(F.xxhash64("term"), "tiles").cast("int")).drop("tiles")
        self.entries = materialise(placed.withColumn("column", F.dense_rank().over(inside) - 1), "matrix")
        totals = self.entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        pairs = df.select(*[F.coalesce(name(c).cast("string"), F.lit("")) for c in (lang, source)])
        order = Window.partitionBy("lang").orderBy("source")
        numbered = (
            pairs.toDF("lang", "source")
            .distinct()
            .withColumn("place", (F.row_number().over(order) - 1).cast("int"))
            .join(totals, ["lang", "source"], "left")
            .join(of_lang.select("lang", "kept"), "lang", "left")
        )
        number = numbered.groupBy("lang").agg(F.count("*").cast("int").alias("sources"))
        self.groups = materialise(
            numbered.fillna(0, ["total", "kept"]).join(number, "lang"),
            "groups",
        )

    def top_terms(self, most: int) -> DataFrame:
        """lang, source, item (term), value, rank: terms that a source holds more often than its language does."""
        p = share(F.col("n"), F.col("total"), F.col("kept"))
        q = share(F.col("all"), F.col("lang_total"), F.col("kept"))
        both = self.entries.join(self.groups.select("lang", "source", "total"), ["lang", "source"])
        both = both.withColumn("p", p).withColumn("q", q).where("p > q")
        rows = both.select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= most)

    def between_sources(self) -> DataFrame:
        """lang, source, item (each other source of the language), value, rank."""
        met = self._met()
        one = self.groups.select("lang", "source", "place", "total", "kept", "sources")
        other = self.groups.select(
            "lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("total").alias("other_total")
        )
        # a row for each pair is what is asked for
        pairs = one.where("sources > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sources") - 1)))
        pairs = pairs.where("other != place").join(other, ["lang", "other"]).join(met, ["lang", "place", "other"], "left")
        p = share(F.lit(0), F.col("total"), F.col("kept"))
        q = share(F.lit(0), F.col("other_total"), F.col("kept"))
        rest = price(F.col("p"), F.col("q")) * (F.col("kept") - F.coalesce("met", F.lit(0)))
        # a language without kept terms has no shares
        pairs = pairs.withColumn("p", F.when(F.col("kept") > 0, p)).withColumn("q", F.when(F.col("kept") > 0, q))
        rows = pairs.select(
            "lang", "source", "item", (F.coalesce("value", F.lit(0)) + F.coalesce(rest, F.lit(0))).alias("value")
        )
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
        return rows.withColumn("rank", rank)

    def _met(self) -> DataFrame:
        """lang, place, other, value and met: the sum and number over terms that at least one of the two holds."""
        block = F.floor(F.col("place") / ROWS).cast("int").alias("block")
        row = (F.col("place") % ROWS).alias("row")
        # ROWS totals for each block of sources
        listed = F.array_sort(F.collect_list(F.struct(row, "total")))
        totals = self.groups.groupBy("lang", block, "sources", "kept").agg(listed.alias("totals"))
        totals = totals.withColumn("totals", F.col("totals.total"))
        cells = self.entries.join(self.groups.select("lang", "source", block, row), ["lang", "source"])
        # at most ROWS sources by the terms of a tile
        tiles = cells.groupBy("lang", "tile", "block").agg(F.collect_list(F.struct("row", "column", "n")).alias("cells"))
        own = tiles.select("lang", "tile", "block", "cells.row", "cells.column", "cells.n").join(totals, ["lang", "block"])
        partner = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / ROWS).cast("int")))
        theirs = totals.select("lang", F.col("block").alias("partner"), F.col("totals").alias("partner_totals"))
        dealt = own.withColumn("partner", partner).join(theirs, ["lang", "partner"])
        dealt = dealt.withColumn("low", F.least("block", "partner")).withColumn("high", F.greatest("block", "partner"))
        found = dealt.groupBy("lang", "tile", "low", "high").applyInArrow(
            compare_tile, "lang string, place int, other int, value long, met long"
        )
        return found.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))


class QuadTree:
    """A square matrix of counts, of side 2^LEVELS, as levels of existing quadrants.

    ``children[l]`` has for each node of level ``l``, in the order of the quadrants (upper left, upper right, lower left,
    lower right), the number of its child in the next level, or -1 where the quadrant is all zero. The nodes of the last
    level are the counts.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, counts: np.ndarray):
        codes = np.zeros(len(rows), np.int64)
        for bit in range(LEVELS):
            codes |= ((columns >> bit) & 1) << (2 * bit) | ((rows >> bit) & 1) << (2 * bit + 1)
        order = np.argsort(codes)
        codes = codes[order]
        self.counts = counts[order]
        self.children = []
        for level in range(LEVELS):
            below = np.unique(codes >> (2 * (LEVELS - level - 1)))
            nodes, at = np.unique(below >> 2, return_inverse=True)
            children = np.full((len(nodes), 4), -1, np.int64)
            children[at, below & 3] = np.arange(len(below))
            self.children.append(children)

    def step(self, level: int, nodes: np.ndarray, quadrants: np.ndarray) -> np.ndarray:
        """The child of each node in a quadrant; a missing node has none."""
        if not len(self.counts):
            return np.full(len(nodes), -1, np.int64)
        return np.where(nodes < 0, -1, self.children[level][np.maximum(nodes, 0), quadrants])

    def values(self, nodes: np.ndarray) -> np.ndarray:
        if not len(self.counts):
            return np.zeros(len(nodes), np.int64)
        return np.where(nodes < 0, 0, self.counts[np.maximum(nodes, 0)])


def walk_together(one: QuadTree, two: QuadTree, same: bool) -> tuple[np.ndarray, ...]:
    """Row of the first, row of the second, their counts, for all columns and pairs where either holds a count.

    With ``same`` both are the same rows, and only pairs of a smaller with a larger row come back.
    """
    a = np.zeros(1, np.int64) - (len(one.counts) == 0)
    b = np.zeros(1, np.int64) - (len(two.counts) == 0)
    row, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    down, below, right = (x.ravel() for x in np.indices((2, 2, 2)))
    for level in range(LEVELS):
        a, b, row, other = (np.repeat(x, 8) for x in (a, b, row, other))
        times = len(a) // 8
        half, half_other, half_column = (np.tile(x, times) for x in (down, below, right))
        row, other = 2 * row + half, 2 * other + half_other
        a = one.step(level, a, 2 * half + half_column)
        b = two.step(level, b, 2 * half_other + half_column)
        stays = (a >= 0) | (b >= 0)
        if same:
            stays &= row < other if level == LEVELS - 1 else row <= other
        a, b, row, other = a[stays], b[stays], row[stays], other[stays]
    return row, other, one.values(a), two.values(b)


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """p of each count, in three steps of long division so that nothing overflows."""
    rest, whole, out = counts + 1, totals + kept, np.ones(len(counts), np.int64)
    scaled = np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        scaled = scaled * 1000 + rest // whole
        rest = rest % whole
    return out + scaled


def compare_tile(key: tuple, table: pa.Table) -> pa.Table:
    """The pairs of sources of two blocks, over the terms of one tile: sums of prices where either holds a count.

    The table has a row for each block that holds a count there, one or two.
    """
    lang, _, low, high = (k.as_py() for k in key)
    kept = table.column("kept")[0].as_py()
    totals, cells = {}, {b: (np.zeros(0, np.int64),) * 3 for b in (low, high)}
    for one in table.to_batches():
        read = {
            c: [x.values.to_numpy().astype(np.int64) for x in one.column(c)]
            for c in ("row", "column", "n", "totals", "partner_totals")
        }
        for i, (block, partner) in enumerate(zip(one.column("block").to_pylist(), one.column("partner").to_pylist())):
            totals[block], totals[partner] = read["totals"][i], read["partner_totals"][i]
            cells[block] = read["row"][i], read["column"][i], read["n"][i]
    sides = [low] if low == high else [low, high]
    values, met = np.zeros((2, ROWS * ROWS), np.int64), np.zeros(ROWS * ROWS, np.int64)
    for square in np.unique(np.concatenate([cells[b][1] // ROWS for b in sides])):
        trees = []
        for block in sides:
            row, column, n = (x[cells[block][1] // ROWS == square] for x in cells[block])
            trees.append(QuadTree(row, column % ROWS, n))
        row, other, counts, counts_other = walk_together(trees[0], trees[-1], low == high)
        # the last block may have fewer sources than rows
        stays = (row < len(totals[low])) & (other < len(totals[high]))
        row, other, counts, counts_other = (x[stays] for x in (row, other, counts, counts_other))
        p, q = shares(counts, totals[low][row], kept), shares(counts_other, totals[high][other], kept)
        pair, apart = ROWS * row + other, (p - q) * (p - q)
        np.add.at(values[0], pair, apart // q)
        np.add.at(values[1], pair, apart // p)
        met += np.bincount(pair, minlength=ROWS * ROWS)
    some = np.flatnonzero(met)
    first, second = (low * ROWS + some // ROWS).astype(np.int32), (high * ROWS + some % ROWS).astype(np.int32)
    return pa.table(
        {
            "lang": pa.array([lang] * (2 * len(some)), pa.string()),
            "place": np.concatenate([first, second]),
            "other": np.concatenate([second, first]),
            "value": np.concatenate([values[0, some], values[1, some]]),
            "met": np.concatenate([met[some], met[some]]),
        }
    )
