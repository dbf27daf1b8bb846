"""Quality rules: a decision list learnt from labelled statistics of texts.

Sequential covering: a rule, a conjunction of thresholds on statistics, is grown condition by condition on one part of
the labelled rows, pruned from its end on the rest, and kept while it is right more often than not; then the rows it
covers are set aside and the next rule is learnt. The rules become one ordered Spark conditional expression, which can
be read, changed, and run on any table of statistics.

Defined cases: null text has no words and all statistics 0; a text without words fails the base rule; with no labels,
or labels of one kind, there are no rules and the base rule alone decides; equal rows get equal verdicts; repeated
rows stay; columns of the input that have the name of a statistic are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import annotate, bounded_sample, name, texts_of, window_hashes, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
    "n_digits",
    "n_distinct_words",
]


def _statistics(text: str) -> tuple[int, ...]:
    words = words_of(text)
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    seen, dup_lines, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    hashes = word_hashes(words)
    repeat = 0
    if n >= 4:
        _, inverse, counts = np.unique(window_hashes(hashes, 3), return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : i + n - 2] |= twice
        repeat = int(covered.sum())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_upper = int(((codes >= 65) & (codes <= 90)).sum())
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    ascii_lower = int(((codes >= 97) & (codes <= 122)).sum())
    wide = [chr(c) for c in codes[codes > 127].tolist()]
    upper = ascii_upper + sum(c.isupper() for c in wide)
    letters = ascii_upper + ascii_lower + sum(c.isalpha() for c in wide)
    return (
        n,
        len(text) - blanks,
        sum(map(text.count, SYMBOLS)),
        dup_lines,
        repeat,
        lines,
        upper,
        letters,
        digits,
        len(np.unique(hashes)),
    )


def text_statistics(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """Add the counts named in ``COUNTS``, over each whole text."""

    def kernel():
        def work(array):
            rows = np.array([_statistics(t) for t in texts_of(array)], np.int64).reshape(-1, len(COUNTS))
            return [pa.array(rows[:, i]) for i in range(len(COUNTS))]

        return work

    return annotate(df, [text], kernel, ", ".join(f"{c} long" for c in COUNTS), keep)


def features() -> dict[str, Column]:
    """What rules may ask for: ratios of the counts, so that they mean the same at every length."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "chars_per_word": F.col("word_chars") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct_words") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "words_per_line": F.col("n_words") / lines,
        "upper_share": F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        "letter_share": F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1)),
        "digits_per_word": F.col("n_digits") / words,
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, '<=' or '>', threshold) must hold; then the text is of low quality."""

    conditions: tuple[tuple[str, str, float], ...]
    right: int
    wrong: int

    def __str__(self) -> str:
        return " and ".join(f"{f} {o} {t:.6g}" for f, o, t in self.conditions)


def _holds(x: np.ndarray, names: list[str], conditions) -> np.ndarray:
    held = np.ones(len(x), bool)
    for feature, sign, at in conditions:
        value = x[:, names.index(feature)]
        held &= value <= at if sign == "<=" else value > at
    return held


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, tuple[str, str, float] | None]:
    """The condition with the largest information gain, over every place between two different values."""
    total, found = y.sum(), (0.0, None)
    if not total or total == len(y):
        return found
    base = np.log2(total / len(y))
    for i, feature in enumerate(names):
        order = np.argsort(x[:, i], kind="stable")
        value, positive = x[order, i], np.cumsum(y[order])
        edge = np.flatnonzero(np.diff(value) > 0)
        if not len(edge):
            continue
        below, n_below = positive[edge], edge + 1
        for sign, p, n in (("<=", below, n_below), (">", total - below, len(y) - n_below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > found[0] + 1e-12:
                found = (float(gain[k]), (feature, sign, float((value[edge[k]] + value[edge[k] + 1]) / 2)))
    return found


def learn_rules(
    x: np.ndarray, low: np.ndarray, names: list[str], most: int = 20, precision: float = 0.9, least: int = 5
) -> list[Rule]:
    """Rules for ``low`` rows. A third of the rows, every third one, is kept for pruning.

    A rule is kept if at least ``precision`` of all rows that it covers are low, and at least ``least`` of them.
    """
    x, low = np.asarray(x, float), np.asarray(low, bool)
    prune = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < most and (low & left).sum() >= least:
        grow_x, grow_y = x[left & ~prune], low[left & ~prune]
        held, conditions = np.ones(len(grow_x), bool), []
        while len(conditions) < 6 and not grow_y[held].all():
            gain, condition = _best_condition(grow_x[held], grow_y[held], names)
            if condition is None:
                break
            conditions.append(condition)
            held &= _holds(grow_x, names, [condition])
        if not conditions:
            break
        prune_x, prune_y = x[left & prune], low[left & prune]

        def worth(some) -> float:
            covered = _holds(prune_x, names, some)
            p, n = int(prune_y[covered].sum()), int((~prune_y[covered]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        ranked = [(worth(conditions[:k]), -k) for k in range(1, len(conditions) + 1)]
        conditions = conditions[: -max(ranked)[1]]
        covered = left & _holds(x, names, conditions)
        right, wrong = int(low[covered].sum()), int((~low[covered]).sum())
        if right < least or right < precision * (right + wrong):
            break
        rules.append(Rule(tuple(conditions), right, wrong))
        left &= ~covered
    return rules


def learn_from(df: DataFrame, label: str, rows: int = 20_000, key: str = "key") -> list[Rule]:
    """Rules from a table of ``COUNTS`` with ``label`` (1: good, 0: low). ``rows`` bounds what the driver learns from:
    the rows whose keys have the smallest hashes."""
    columns = features()
    labelled = bounded_sample(df.where(name(label).isin(0, 1)), key, rows)
    table = labelled.select(*[c.alias(f) for f, c in columns.items()], name(label).alias("_label")).toPandas()
    return learn_rules(table[list(columns)].to_numpy(float), (table["_label"] == 0).to_numpy(), list(columns))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that holds, else 0."""
    columns, out = features(), None
    for number, rule in enumerate(rules, 1):
        held = F.lit(True)
        for feature, sign, at in rule.conditions:
            held &= columns[feature] <= at if sign == "<=" else columns[feature] > at
        out = F.when(held, number) if out is None else out.when(held, number)
    return F.lit(0) if out is None else out.otherwise(0)
