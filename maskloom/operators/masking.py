"""Masks for training, and the one-token-at-a-time expansion for pseudo-perplexity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from maskloom.functions import tokens as K
from maskloom.functions.draws import draws_at, threshold
from maskloom.session import bound_batches

# Shares of the chosen tokens that become the mask and that become a random token.
MASKED, RANDOM = 0.8, 0.1
ACTIONS = ["mask", "random", "keep"]
PLANNED = ["_prefix", "_ids", "_special"]


def _special(windows: DataFrame, ids: str, special: str | None) -> Column:
    """Which places hold no token of the text: by the mask that padding keeps up, or the first and last place.

    Without a name the column ``special_tokens_mask`` is taken if there is one.
    """
    special = special or ("special_tokens_mask" if "special_tokens_mask" in windows.columns else None)
    return F.col(special) if special else K.special_tokens_mask(F.col(ids))


def _prefix(seed: int | str, epoch: int, keys: list[str]) -> Column:
    """What stands before the position in the text that a token's draw is made of (``draws.draw``)."""
    parts = [x for key in keys for x in (F.lit(":"), F.col(key).cast("string"))]
    return F.concat(F.lit(f"{seed}:{epoch}"), *parts, F.lit(":"))


def _draws(prefixes: pa.Array, lengths: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, in all arrays one after another, where a token of the text stands, and the draw of each.

    Rows without a prefix have none.
    """
    starts = np.cumsum(lengths) - lengths
    has = np.repeat(prefixes.is_valid().to_numpy(zero_copy_only=False), lengths)
    places = np.flatnonzero(has & (special == 0))
    rows = np.searchsorted(starts + lengths, places, "right")
    return places, draws_at([(p or "").encode() for p in prefixes.to_pylist()], rows, places - starts[rows])


def _below(numbers: np.ndarray, probability: float) -> np.ndarray:
    return numbers < int(threshold(probability, 8), 16)


def _plan(prefixes: pa.Array, ids: pa.Array, special: pa.Array, probability: float) -> tuple:
    """How many tokens of the text there are; place, draw and number of the action of the chosen ones; the lengths."""
    lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    places, draws = _draws(prefixes, lengths, special.flatten().to_numpy(zero_copy_only=False))
    chosen = _below(draws[:, 0], probability)
    drawn = draws[chosen]
    action = np.where(_below(drawn[:, 1], MASKED), 0, np.where(_below(drawn[:, 1], MASKED + RANDOM), 1, 2))
    return len(places), places[chosen], drawn, action, lengths


def _new_ids(tokens: pa.Array, drawn: np.ndarray, action: np.ndarray, vocab_size: int, mask: int) -> pa.Array:
    """What stands in the place of the chosen tokens."""
    new = pa.array(np.where(action == 0, mask, drawn[:, 2] % vocab_size)).cast(tokens.type)
    return pc.if_else(pa.array(action == 2), tokens, new)


def _prepared(windows: DataFrame, keys: list[str], seed, epoch: int, ids: str, special: str | None, *more: Column):
    bound_batches(windows.sparkSession)
    return windows.select(
        *more,
        _prefix(seed, epoch, keys).alias("_prefix"),
        F.col(ids).alias("_ids"),
        _special(windows, ids, special).alias("_special"),
    )


def mask_for_training(
    windows: DataFrame,
    keys: list[str],
    vocab_size: int,
    probability: float = 0.15,
    seed: int | str = 42,
    epoch: int = 0,
    ids: str = "input_ids",
    special: str | None = None,
    specials: K.Specials = K.SPECIALS,
) -> DataFrame:
    """Add ``labels`` and mask ``ids``: array by array, without a shuffle or one row per token.

    Opening, closing and padding places are never chosen; special tokens written out in a text may be. For padded
    windows ``special`` names their special-tokens mask. ``epoch`` gives each pass its own masks.
    """
    bound_batches(windows.sparkSession)
    rest = [c for c in windows.columns if c != ids]
    kind = windows.schema[ids].dataType
    masked = ST.StructType([ST.StructField("ids", kind), ST.StructField("labels", kind)])

    def both(prefixes: pa.Array, arrays: pa.Array, special: pa.Array) -> pa.Array:
        _, places, drawn, action, lengths = _plan(prefixes, arrays, special, probability)
        flat = arrays.flatten()
        chosen = np.zeros(len(flat), bool)
        chosen[places] = True
        new = _new_ids(flat.take(pa.array(places)), drawn, action, vocab_size, specials.mask)
        inputs = pc.replace_with_mask(flat, pa.array(chosen), new)
        labels = pc.if_else(pa.array(chosen), flat, pa.scalar(K.IGNORE, flat.type))
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x, mask=arrays.is_null()) for x in (inputs, labels)]
        return pa.StructArray.from_arrays(lists, names=["ids", "labels"])

    made = F.arrow_udf(both, masked)(_prefix(seed, epoch, keys), F.col(ids), _special(windows, ids, special))
    return windows.select(*rest, made.alias("_made")).select(*rest, F.col("_made.ids").alias(ids), "_made.labels")


def mask_plan(
    windows: DataFrame,
    keys: list[str],
    vocab_size: int,
    probability: float = 0.15,
    seed: int | str = 42,
    epoch: int = 0,
    ids: str = "input_ids",
    special: str | None = None,
    specials: K.Specials = K.SPECIALS,
) -> DataFrame:
    """One row per chosen token: its position from 0, its label, the action and the id put in its place."""
    source = _prepared(windows, keys, seed, epoch, ids, special, F.struct(*keys).alias("_row"))
    token = windows.schema[ids].dataType.elementType
    fields = [("pos", ST.IntegerType()), ("label", token), ("action", ST.StringType()), ("new_id", token)]
    schema = ST.StructType([source.schema["_row"], *[ST.StructField(*f) for f in fields]])
    names = pa.array(ACTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, places, drawn, action, lengths = _plan(*map(batch.column, PLANNED), probability)
            starts = np.cumsum(lengths) - lengths
            row = np.searchsorted(starts + lengths, places, "right")
            tokens = batch.column("_ids").flatten().take(pa.array(places))
            new = _new_ids(tokens, drawn, action, vocab_size, specials.mask)
            pos = pa.array(places - starts[row], pa.int32())
            columns = [batch.column("_row").take(pa.array(row)), pos, tokens, names.take(pa.array(action)), new]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    planned = source.mapInArrow(run, schema)
    kept = [F.col("_row").getField(c).alias(c) for c in keys]
    return planned.select(*kept, "pos", "label", "action", "new_id")


def mask_rates(
    windows: DataFrame,
    keys: list[str],
    probability: float = 0.15,
    seed: int | str = 42,
    epoch: int = 0,
    ids: str = "input_ids",
    special: str | None = None,
) -> DataFrame:
    """Maskable tokens, chosen tokens and how many of each action, in one pass over the windows."""
    source = _prepared(windows, keys, seed, epoch, ids, special)
    names = ["n_maskable", "n_chosen", "n_mask", "n_random", "n_keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maskable, places, _, action, _ = _plan(*map(batch.column, PLANNED), probability)
            counts = [maskable, len(places), *np.bincount(action, minlength=3).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in counts], names=names)

    tallied = source.mapInArrow(run, ", ".join(f"{name} long" for name in names))
    return tallied.agg(*[F.sum(name).alias(name) for name in names])


def expand_masks(
    windows: DataFrame, keys: list[str], ids: str = "input_ids", specials: K.Specials = K.SPECIALS
) -> DataFrame:
    """One row per position but the first and last, with that position masked.

    A window of n ids gives n - 2 rows of n ids, which an outside scorer needs. The built-in scorer does not.
    """
    inner = F.slice(F.col(ids), F.lit(2), F.greatest(F.size(ids) - 2, F.lit(0)))
    rows = windows.select(*keys, F.col(ids), F.posexplode(inner).alias("_at", "label"))
    pos = F.col("_at") + 1
    behind = F.slice(F.col(ids), pos + 2, F.size(ids) - pos - 1)
    masked = F.concat(F.slice(F.col(ids), F.lit(1), pos), F.array(F.lit(specials.mask)), behind)
    return rows.select(*keys, pos.alias("pos"), "label", masked.alias("masked_ids"))
