"""Column functions on arrays of token ids. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label that a loss ignores.
IGNORE = -100


@dataclass(frozen=True)
class Specials:
    """Ids of the special tokens. The defaults are those of the vocabularies trained here."""

    pad: int = 0
    unk: int = 1
    cls: int = 2
    sep: int = 3
    mask: int = 4

    @classmethod
    def of(cls, tokens: Mapping[str, int]) -> Specials:
        """The ids that a vocabulary gives them."""
        return cls(*[tokens[t] for t in ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")])


SPECIALS = Specials()


def with_specials(ids: Column, specials: Specials = SPECIALS) -> Column:
    """Ids between the opening and the closing token."""
    return F.concat(F.array(F.lit(specials.cls)), ids, F.array(F.lit(specials.sep)))


def attention_mask(ids: Column) -> Column:
    """One per token of a window that is not padded yet. What stands there does not matter, only that it does."""
    return F.transform(ids, lambda _: F.lit(1).cast("tinyint"))


def special_tokens_mask(ids: Column) -> Column:
    """One for the first and the last token of a window that is not padded yet, whatever ids the text has."""
    ends = F.size(ids) - 1
    return F.transform(ids, lambda _, i: F.when((i == 0) | (i == ends), 1).otherwise(0).cast("tinyint"))


def window_count(n: Column, max_length: int = 512, overlap: int = 256) -> Column:
    """Windows that ``n`` content tokens fill."""
    content, step = _sizes(max_length, overlap)
    return F.when(n <= content, F.lit(1)).otherwise(F.ceil((n - content) / F.lit(step)) + 1).cast("int")


def windows(ids: Column, max_length: int = 512, overlap: int = 256, specials: Specials = SPECIALS) -> Column:
    """Array of windows, each between opening and closing token, sharing ``overlap`` tokens with the next."""
    content, step = _sizes(max_length, overlap)
    starts = F.sequence(F.lit(0), window_count(F.size(ids), max_length, overlap) - 1)
    return F.transform(starts, lambda i: with_specials(F.slice(ids, i * step + 1, F.lit(content)), specials))


def first_window(ids: Column, max_length: int = 512, specials: Specials = SPECIALS) -> Column:
    """The first window alone."""
    return with_specials(F.slice(ids, 1, max_length - 2), specials)


def pad_to(values: Column, length: Column, fill: Column) -> Column:
    """Fill up to ``length``."""
    return F.concat(values, F.array_repeat(fill, F.greatest(length - F.size(values), F.lit(0))))


def _sizes(max_length: int, overlap: int) -> tuple[int, int]:
    content = max_length - 2
    if not 0 <= overlap < content:
        raise ValueError("the overlap must be smaller than the content of a window")
    return content, content - overlap
