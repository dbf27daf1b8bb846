"""A trigram scorer: interpolated Kneser-Ney smoothing, as tables and joins.

The share of a token after two others is its discounted count there; what the discounts free goes to the share after
one token, where a count is the number of different tokens seen before the pair, and from there to the share without
context and to all tokens alike. Discounts follow from how many n-grams were seen once to four times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.operators.lookup import lookup
from maskloom.session import broadcast_if_small, materialise

BEFORE_START = -1
# Discounts for one, two, and more occurrences, where a corpus is too small or too even to give its own.
DEFAULT_DISCOUNTS = (0.5, 1.0, 1.5)


def trigrams(windows: DataFrame, keys: list[str], ids: str = "input_ids", with_size: bool = False) -> DataFrame:
    """One row per position but the first and last: the token and the two before it.

    Before the first token stands ``BEFORE_START``. ``with_size`` adds ``n``, the number of such positions.
    """
    tokens, size = F.col(ids), F.size(ids)

    def at(i: Column) -> Column:
        two_before = F.when(i > 1, F.get(tokens, i - 2)).otherwise(F.lit(BEFORE_START))
        return F.struct(two_before.alias("a"), F.get(tokens, i - 1).alias("b"), F.get(tokens, i).alias("c"))

    places = F.when(size > 2, F.transform(F.sequence(F.lit(1), size - 2), at))
    count = [(size - 2).alias("n")] if with_size else []
    rows = windows.select(*keys, *count, F.posexplode(places).alias("_at", "_gram"))
    return rows.select(*keys, (F.col("_at") + 1).alias("pos"), "_gram.a", "_gram.b", "_gram.c", *["n" for _ in count])


def trigram_counts(windows: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Occurrences of each trigram; counting starts before the shuffle."""
    return trigrams(windows, [], ids).groupBy("a", "b", "c").agg(F.count("*").alias("cnt"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What to take off counts of one, two, and more, from the counts of counts."""
    seen = counts.agg(*[F.count_if(F.col("cnt") == k).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = seen
    if not (n1 and n2 and n3 and n4):
        return DEFAULT_DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    fits = all(0 <= d <= k for k, d in enumerate(found, start=1))
    return found if fits else DEFAULT_DISCOUNTS


@dataclass(frozen=True)
class Order:
    """The kept n-grams of one order with their counts, and per context their total and the mass that is freed."""

    grams: DataFrame
    contexts: DataFrame
    off: tuple[float, float, float]

    def taken(self, cnt: Column) -> Column:
        """A count less its discount; 0 for an n-gram that is not kept."""
        one, two, more = [F.lit(d) for d in self.off]
        left = cnt - F.when(cnt == 1, one).when(cnt == 2, two).otherwise(more)
        return F.coalesce(F.greatest(left, F.lit(0.0)), F.lit(0.0))


def _order(counts: DataFrame, context: list[str], name: str, least: int = 1) -> Order:
    """``cnt`` of the kept n-grams and, per context, ``total`` and ``free``; sums are of whole numbers until the end."""
    one, two, more = off = discounts(counts)
    kept = F.col("cnt") >= least
    per_context = counts.groupBy(*context).agg(
        F.sum("cnt").alias("total"),
        F.coalesce(F.sum(F.when(~kept, F.col("cnt"))), F.lit(0)).alias("dropped"),
        *[F.count_if(kept & (F.col("cnt") == k)).alias(f"n{k}") for k in (1, 2)],
        F.count_if(kept & (F.col("cnt") > 2)).alias("n3"),
    )
    free = F.col("dropped") + F.lit(one) * F.col("n1") + F.lit(two) * F.col("n2") + F.lit(more) * F.col("n3")
    contexts = per_context.select(*context, "total", free.alias("free"))
    return Order(counts.where(kept), materialise(contexts, f"contexts-{name}"), off)


@dataclass(frozen=True)
class TrigramModel:
    """Three orders, the third perhaps pruned, over a vocabulary."""

    three: Order
    two: Order
    one: Order
    vocab_size: int


def train(counts: DataFrame, vocab_size: int, least: int = 1) -> TrigramModel:
    """A model from a table of trigram counts. Trigrams seen less than ``least`` times are left out of its table;
    their mass goes to the shorter context."""
    pairs = materialise(counts.groupBy("b", "c").agg(F.count("*").alias("cnt")), "pairs")
    tokens = materialise(pairs.groupBy("c").agg(F.count("*").alias("cnt")), "tokens")
    return TrigramModel(
        _order(counts, ["a", "b"], "three", least), _order(pairs, ["b"], "two"), _order(tokens, [], "one"), vocab_size
    )


def _share(order: Order, shorter: Column) -> Column:
    """Discounted count and freed mass over the context's total; the shorter context's share where it is unknown."""
    return F.coalesce((order.taken(F.col("cnt")) + F.col("free") * shorter) / F.col("total"), shorter)


def gram_losses(grams: DataFrame, model: TrigramModel, small: int = 1_000_000) -> DataFrame:
    """Negative log share of each distinct trigram.

    One row per trigram meets one row per n-gram or context. Tables by a single token, which have an entry for each
    token at most, are broadcast up to ``small`` rows.
    """
    every = F.lit(1.0) / F.lit(float(model.vocab_size))
    alone = model.one.contexts.first()  # one row: how many pairs there are, and what the discounts free of them
    total, free = F.lit(alone["total"]).cast("long"), F.lit(alone["free"]).cast("double")
    one = F.coalesce((model.one.taken(F.col("cnt")) + free * every) / total, every)
    found = grams.join(broadcast_if_small(model.one.grams, small), "c", "left").select("a", "b", "c", one.alias("one"))
    found = found.join(model.two.grams, ["b", "c"], "left")
    found = found.join(broadcast_if_small(model.two.contexts, small), "b", "left")
    found = found.select("a", "b", "c", _share(model.two, F.col("one")).alias("two"))
    found = found.join(model.three.grams, ["a", "b", "c"], "left").join(model.three.contexts, ["a", "b"], "left")
    return found.select("a", "b", "c", (-F.log(_share(model.three, F.col("two")))).alias("loss"))


def losses(positions: DataFrame, model: TrigramModel, **options: float) -> DataFrame:
    """Loss of every position of ``trigrams``. ``positions`` should be a table; ``options`` go to ``lookup``."""
    distinct = positions.select("a", "b", "c").distinct()
    return lookup(positions, materialise(gram_losses(distinct, model), "gram-losses"), ["a", "b", "c"], **options)
