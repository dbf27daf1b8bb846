"""Token losses and the perplexities made from them.

The built-in scorer is a bigram model counted on the train split. Other scorers take the expanded rows of
``masking.expand_masks`` batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from maskloom.operators.lookup import lookup
from maskloom.operators.vocabulary import adjacent_pairs
from maskloom.session import materialise


def bigrams(windows: DataFrame, keys: list[str], ids: str = "input_ids", with_size: bool = False) -> DataFrame:
    """One row per position but the first and last: the token and the one before it.

    ``with_size`` adds ``n``, the number of such positions of the window.
    """
    pairs = adjacent_pairs(F.slice(F.col(ids), F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))))
    size = [(F.size(ids) - 2).alias("n")] if with_size else []
    rows = windows.select(*keys, *size, F.posexplode(pairs).alias("_at", "pair"))
    return rows.select(
        *keys,
        (F.col("_at") + 1).alias("pos"),
        F.col("pair.left").alias("prev"),
        F.col("pair.right").alias("cur"),
        *["n" for _ in size],
    )


def bigram_counts(windows: DataFrame, by: list[str] | None = None, ids: str = "input_ids") -> DataFrame:
    """Occurrences of each pair of neighbours, per group; counting starts before the shuffle."""
    by = by or []
    return bigrams(windows, by, ids).groupBy(*by, "prev", "cur").agg(F.count("*").alias("cnt"))


def _context_counts(counts: DataFrame) -> DataFrame:
    """Occurrences of each token as the first of a pair: at most one row per vocabulary entry."""
    return counts.groupBy("prev").agg(F.sum("cnt").alias("context_cnt"))


def _loss(cnt: Column, context: Column, alpha: float, vocab_size: int) -> Column:
    """Negative log probability with ``alpha`` added to every count."""
    zero = F.lit(0)
    share = (F.coalesce(cnt, zero) + F.lit(alpha)) / (F.coalesce(context, zero) + F.lit(alpha * vocab_size))
    return -F.log(share)


def _pair_losses(pairs: DataFrame, counts: DataFrame, models: dict[str, float], vocab_size: int) -> DataFrame:
    """A column with the loss of each distinct pair per model, which is a name and its ``alpha``.

    Both sides have one row per pair, so no key is heavy.
    """
    context = F.broadcast(_context_counts(counts))  # bounded by the vocabulary size
    found = pairs.join(counts, ["prev", "cur"], "left").join(context, "prev", "left")
    losses = [_loss(F.col("cnt"), F.col("context_cnt"), a, vocab_size).alias(name) for name, a in models.items()]
    return found.select(*pairs.columns, *losses)


def _position_losses(
    positions: DataFrame, counts: DataFrame, vocab_size: int, models: dict[str, float], **options: float
) -> DataFrame:
    pairs = positions.select("prev", "cur").distinct()
    losses = materialise(_pair_losses(pairs, counts, models, vocab_size), "pair-losses")
    return lookup(positions, losses, ["prev", "cur"], **options)


def bigram_losses(
    positions: DataFrame, counts: DataFrame, vocab_size: int, alpha: float = 1.0, **options: float
) -> DataFrame:
    """Loss of every position of ``bigrams``. ``positions`` should be a table; ``options`` go to ``lookup``."""
    return _position_losses(positions, counts, vocab_size, {"loss": alpha}, **options)


def model_losses(
    positions: DataFrame, counts: DataFrame, vocab_size: int, models: dict[str, float], **options: float
) -> DataFrame:
    """Loss of every position under every model, from one lookup."""
    wide = _position_losses(positions, counts, vocab_size, models, **options)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("loss")) for m in models]))
    return wide.select(*positions.columns, each.alias("_m")).select("_m.model", *positions.columns, "_m.loss")


def pseudo_perplexity(losses: DataFrame, keys: list[str], weighting: str = "batch", batch_size: int = 4) -> DataFrame:
    """exp of the mean loss per text.

    ``weighting="batch"`` first takes the mean over each run of ``batch_size`` positions and then the plain mean
    of those, so the tokens of a short last run weigh more; ``"token"`` weighs all tokens alike. Where ``losses`` has
    the number of positions ``n`` of its text, and one loss for each, the size of every run is known beforehand, and
    sums are taken before the shuffle.
    """
    if weighting == "token":
        means = losses.groupBy(*keys).agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("n_tokens"))
    elif weighting == "batch" and "n" in losses.columns:
        run = F.expr(f"(pos - 1) div {int(batch_size)}")
        size = F.least(F.lit(batch_size), F.col("n") - run * batch_size)
        runs = F.ceil(F.max("n") / F.lit(batch_size))
        means = losses.groupBy(*keys).agg(
            (F.sum(F.col("loss") / size) / runs).alias("mean_loss"), F.count("*").alias("n_tokens")
        )
    elif weighting == "batch":
        run = F.expr(f"(pos - 1) div {int(batch_size)}")
        # one shuffle serves both aggregates
        placed = losses.select(*keys, run.alias("_run"), "loss").repartition(*keys)
        runs = placed.groupBy(*keys, "_run").agg(F.avg("loss").alias("_mean"), F.count("*").alias("_n"))
        means = runs.groupBy(*keys).agg(F.avg("_mean").alias("mean_loss"), F.sum("_n").alias("n_tokens"))
    else:
        raise ValueError("weighting must be 'batch' or 'token'")
    return means.withColumn("ppl", F.exp("mean_loss"))


def score_all(texts: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Every text with its perplexity, null where it has no token to mask."""
    return texts.select(*keys).join(scored, keys, "left")


def corpus_perplexity(
    pairs: DataFrame, counts: DataFrame, vocab_size: int, alpha: float = 1.0, by: str = "split"
) -> DataFrame:
    """Mean loss and its exp per group, from the counted pairs of each group: positions are never joined."""
    scored = _pair_losses(pairs.withColumnRenamed("cnt", "n"), counts, {"loss": alpha}, vocab_size)
    total = scored.groupBy(by).agg(
        F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("loss")).alias("_sum")
    )
    mean = F.try_divide(F.col("_sum"), F.col("n_tokens"))
    return total.select(by, "n_tokens", mean.alias("eval_loss"), F.exp(mean).alias("perplexity"))


def score_with(
    expanded: DataFrame, keys: list[str], make_scorer: Callable[[], Callable[[pd.DataFrame], pd.Series]]
) -> DataFrame:
    """Losses from a scorer of your own, made once per task and called per Arrow batch.

    The scorer gets ``pos``, ``label`` and ``masked_ids`` and returns one loss per row.
    """
    kept = [*keys, "pos"]
    schema = ST.StructType([*[expanded.schema[c] for c in kept], ST.StructField("loss", ST.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            yield batch[kept].assign(loss=scorer(batch[["pos", "label", "masked_ids"]]).to_numpy())

    return expanded.mapInPandas(run, schema)
