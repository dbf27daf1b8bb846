"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 4 letters, words bounded by blanks) of a language by rank. A
document is compared by its own list: for each of its n-grams, how far out of place it is in the profile; one that
the profile lacks counts as far as can be. The language with the smallest sum wins.

Defined cases: null text, and text without a letter, has the language ``und`` and the score 0; equal sums go to the
language first in the alphabet; with no language to learn from every text is ``und``; repeated rows stay; columns of
the input that have the name of an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import annotate, name, texts_of

SIZES = (1, 2, 3, 4)
UNKNOWN = "und"


def _letters(text: str) -> np.ndarray:
    """Code points in lower case with one blank around each word; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = codes < 0x250
    keep = np.zeros(len(codes), bool)
    keep[known] = _LATIN[codes[known]]
    other = np.flatnonzero(~known)
    if len(other):
        keep[other] = [chr(c).isalpha() for c in codes[other]]
    if not keep.any():
        return np.zeros(0, np.uint64)
    codes = np.where(keep, codes, 32).astype(np.uint64)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    blank = codes == 32
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))] & np.uint64(0xFFFF)


_LATIN = np.array([chr(c).isalpha() for c in range(0x250)])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers of 16 bits a letter, and how often each occurs."""
    codes = _letters(text)
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    parts, grown = [codes[codes != 32]], codes
    for size in SIZES[1:]:
        if len(codes) < size:
            break
        grown = grown[: len(codes) - size + 1] << np.uint64(16) | codes[size - 1 :]
        # an n-gram lies within one word and its two blanks
        inner = np.ones(len(grown), bool)
        for i in range(1, size - 1):
            inner &= codes[i : i + len(grown)] != 32
        if size == 2:
            inner = (codes[:-1] != 32) | (codes[1:] != 32)
        parts.append(grown[inner])
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, ties in the order of their numbers."""
    return grams[np.lexsort((grams, -counts))[:length]]


def learn_profiles(
    df: DataFrame, key: str, text: str, lang: str, length: int = 400, rows: int = 20_000
) -> dict[str, list[int]]:
    """Profiles of at most ``length`` n-grams for each language in ``df``.

    ``rows`` bounds the documents learnt from for each language; beyond it the documents with the smallest hashes of
    their keys are taken. The profiles (languages x length numbers) are all that reaches the driver.
    """
    labelled = df.where(name(lang).isNotNull()).select(
        name(key).alias("key"), name(text).alias("text"), name(lang).alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    steps = 1 << 30
    share = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(steps, rows * steps // n))])
    drawn = F.pmod(F.xxhash64("key"), F.lit(steps)) < share[F.col("lang")]

    def count(batches):
        totals: dict[str, dict[int, int]] = {}
        for batch in batches:
            for t, l in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                table = totals.setdefault(l, {})
                grams, counts = ngrams(t)
                for gram, n in zip(grams.tolist(), counts.tolist()):
                    table[gram] = table.get(gram, 0) + n
            if sum(map(len, totals.values())) > 300_000:
                yield from give(totals)
                totals = {}
        yield from give(totals)

    def give(totals):
        for l, table in totals.items():
            grams = np.fromiter(table, np.uint64, len(table)).view(np.int64)
            counts = np.fromiter(table.values(), np.int64, len(table))
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"]
            )

    counted = labelled.where(drawn).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # numbers of 64 bits are unsigned; four letters of the basic plane may set the top bit
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    best = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    profiles: dict[str, list[int]] = {l: [] for l in sorted(sizes)}
    for row in best.orderBy("lang", "rank").collect():  # languages x length rows
        profiles[row["lang"]].append(row["gram"] % 2**64)
    return {l: p for l, p in profiles.items() if p}


def identify(
    df: DataFrame, text: str, profiles: dict[str, list[int]], length: int = 400, keep: list[str] | None = None
) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the share by which the best language is nearer than the next, from 0 to 1.

    With one language the score is how near it is, from 0 (all n-grams out of the profile) to 1.
    """

    def kernel():
        langs = sorted(profiles)
        every = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        places = np.full((len(langs), len(every) + 1), -1, np.int64)
        for row, lang in zip(places, langs):
            row[np.searchsorted(every, np.array(profiles[lang], np.uint64))] = np.arange(len(profiles[lang]))

        def one(t: str) -> tuple[str, float]:
            grams, counts = ngrams(t)
            if not len(grams) or not langs:
                return UNKNOWN, 0.0
            own = ranked(grams, counts, length)
            at = np.searchsorted(every, own)
            at[at == len(every)] = 0
            at[every[at] != own] = len(every)
            found = places[:, at]
            sums = np.where(found >= 0, np.abs(found - np.arange(len(own))), length).sum(axis=1)
            best = int(np.argmin(sums))
            if len(langs) == 1:
                return langs[0], 1.0 - float(sums[0]) / (length * len(own))
            rest = int(np.min(np.delete(sums, best)))
            return langs[best], (rest - int(sums[best])) / rest if rest else 0.0

        def work(array):
            found = [one(t) for t in texts_of(array)]
            return [pa.array([l for l, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

        return work

    return annotate(df, [text], kernel, "lang_pred string, score double", keep)

