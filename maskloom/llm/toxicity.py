"""Toxicity by maximum-scoring segments.

Each word has a log-odds score: how much likelier it is in toxic than in other texts. The estimate of a word leans on
that of its beginnings: the share of its first letters is the Dirichlet prior of the share of the next longer
beginning, up to the whole word, so an unseen word is scored by the longest beginning that is known. One linear scan
finds every maximal segment of a document, the runs of words whose score cannot be raised by making them longer or
shorter. Scores of chance segments follow an extreme-value distribution, whose scale is solved from the scores in
clean texts and whose place from their best segments; it turns the segments of a document of any length into evidence,
to which segments of the same words add once, and a logistic curve fitted on documents kept apart turns the evidence into a score.

Defined cases: null and empty texts, and texts without a letter, have no segments and the score of no evidence; with
no labels, or labels of one kind, no text has evidence; repeated rows stay; columns of the input that have the name
of an output are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import Memo, annotate, bounded_sample, name, texts_of
from maskloom.session import materialise

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 6
END = "\n"
EULER = 0.5772156649015329


def nodes(word: str) -> list[str]:
    """The beginnings of a word, short to long, then the word itself."""
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + END]


@dataclass
class Model:
    """Log-odds by node, and the calibration. ``scores`` holds at most the number of nodes asked for."""

    scores: dict[str, float]
    drift: float = 0.5
    scale: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = -20.0

    def word_score(self, word: str) -> float:
        found = 0.0
        for node in nodes(word):
            value = self.scores.get(node)
            if value is not None:
                found = value
        return found - self.drift

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.intercept))))


def word_scores(words: list[str], memo: Memo) -> np.ndarray:
    """Scores in order, of every occurrence alike."""
    return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass over the positive scores."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.cumsum(scores)
    # candidates: [start, end, sum before it, sum at its end]; linked to the last one that starts lower
    start, end, low, high, link = [], [], [], [], []
    for i in at.tolist():
        a, b, left, right = i, i + 1, sums[i] - scores[i], sums[i]
        j = len(start) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or high[j] >= right:
                break
            # the earlier candidate takes in everything up to here
            a, left = start[j], low[j]
            del start[j:], end[j:], low[j:], high[j:]
            j = link[j]
            del link[len(start) :]
        start.append(a)
        end.append(b)
        low.append(left)
        high.append(right)
        link.append(j)
    return [(a, b, float(h - l)) for a, b, l, h in zip(start, end, low, high)]


def normalised(found: list[tuple[int, int, float]], n: int, scale: float, log_k: float) -> list[float]:
    """Scores as natural logarithms of one over the expected number of chance segments as good."""
    return [scale * s - log_k - math.log(max(n, 2)) for _, _, s in found]


def told_once(words: list[str], found: list[tuple[int, int, float]], values: list[float]) -> list[float]:
    """The values above zero; segments of the same words tell something new once in a text."""
    new: dict[tuple, float] = {}
    for (a, b, _), value in zip(found, values):
        if value > 0:
            passage = tuple(words[a:b])
            new[passage] = max(value, new.get(passage, 0.0))
    return list(new.values())


def evidence(values: list[float]) -> float:
    """Minus the logarithm of the chance of the best r segments together, for the most telling r."""
    best, total = 0.0, 0.0
    for r, value in enumerate(sorted(values, reverse=True), 1):
        if value <= 0:
            break
        total += value
        chance = -total + (r - 1) * math.log(max(total, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
        best = max(best, -chance)
    return best


def _counted(fit: DataFrame) -> DataFrame:
    """In how many toxic and how many other texts each node occurs; ``END`` alone stands for all texts."""

    def run(batches):
        totals: dict[str, list[int]] = {}

        def give():
            names = list(totals)
            toxic, other = zip(*totals.values()) if totals else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(toxic, pa.int64()), pa.array(other, pa.int64())],
                names=["node", "toxic", "other"],
            )

        for batch in batches:
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                seen = {END}
                for word in set(WORD.findall(text.lower())):
                    seen.update(nodes(word))
                for node in seen:
                    if node not in totals:
                        totals[node] = [0, 0]
                    totals[node][0 if label else 1] += 1
                if len(totals) > 300_000:
                    yield give()
                    totals.clear()
        yield give()

    counts = fit.select("text", "label").mapInArrow(run, "node string, toxic long, other long")
    return counts.groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _log_odds(rows: list, total: tuple[int, int], strength: float) -> dict[str, float]:
    base = math.log(total[0] / total[1])
    known = {r["node"]: (r["toxic"], r["other"]) for r in rows}
    share: dict[str, float] = {}
    everywhere = total[0] / (total[0] + total[1])

    def parent(node: str) -> str:
        word = node.rstrip(END)
        return word[:LONGEST] if node.endswith(END) and len(word) > LONGEST else word if node != word else word[:-1]

    def prior(node: str) -> float:
        while node:
            if node in share:
                return share[node]
            node = node[:-1]
        return everywhere

    out = {}
    # short beginnings first: they are the priors of the longer ones
    for node in sorted(known, key=lambda x: (x.endswith(END), len(x))):
        toxic, other = known[node]
        p = prior(parent(node))
        share[node] = (toxic + strength * p) / (toxic + other + strength)
        out[node] = math.log((toxic + strength * p) / (other + strength * (1 - p))) - base
    return out


def _scored(df: DataFrame, inputs: list[str], model: Model, keep: list[str]) -> DataFrame:
    """Add ``_best``, ``_n`` and ``_segments`` for each text."""

    def kernel():
        memo = Memo(model.word_score, 300_000)

        def work(array):
            n, found = [], []
            for text in texts_of(array):
                words = WORD.findall(text.lower())
                scores = word_scores(words, memo)
                n.append(len(words))
                found.append([{"start": a, "end": b, "score": s} for a, b, s in segments(scores)])
            kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
            return [pa.array(n, pa.int64()), pa.array(found, pa.list_(kind))]

        return work

    return annotate(
        df, inputs, kernel, "n_words long, segments array<struct<start: int, end: int, score: double>>", keep
    )


def _moments(model: Model, clean: DataFrame) -> Model:
    """Scale from the word scores in clean texts, place from their best segments."""

    def run(batches):
        memo = Memo(model.word_score, 300_000)
        totals: dict[int, int] = {}
        for batch in batches:
            for text in texts_of(batch.column(0)):
                for word in WORD.findall(text.lower()):
                    cell = round(memo[word] * 50)
                    totals[cell] = totals.get(cell, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["cell", "n"]
        )

    cells = clean.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = cells.collect()  # scores lie within some tens, in fiftieths
    score = np.array([r["cell"] / 50 for r in rows])
    weight = np.array([float(r["n"]) for r in rows])
    if len(score) and (score > 0).any() and (score * weight).sum() < 0:
        weight /= weight.sum()
        low, high = 1e-3, 1.0
        while (weight * np.exp(high * score)).sum() < 1 and high < 64:
            high *= 2
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if (weight * np.exp(middle * score)).sum() < 1 else (low, middle)
        model.scale = low
    best = F.array_max(F.transform("segments", lambda s: s["score"]))
    placed = _scored(clean, ["text"], model, ["label"]).where(F.col("n_words") > 1)
    value = F.lit(model.scale) * F.coalesce(best, F.lit(0.0)) - F.log("n_words")
    mean = placed.agg(F.avg(value).alias("m")).first()["m"]
    model.log_k = (mean if mean is not None else 0.0) - EULER
    return model


def _logistic(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept for (value, positives, negatives), by Newton's method with a small ridge."""
    x = np.array([c[0] for c in cells])
    y, n = np.array([float(c[1]) for c in cells]), np.array([float(c[1] + c[2]) for c in cells])
    design = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (y - n * p) - 1e-3 * theta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    rows: int = 40_000,
    max_nodes: int = 100_000,
    strength: float = 5.0,
) -> Model:
    """Fit on the documents that have a label 0 or 1.

    ``rows`` bounds the labelled documents that are used (those whose keys have the smallest hashes), ``max_nodes`` the
    nodes kept, those most telling; both bound what reaches the driver. Three quarters give the log-odds, a quarter the
    calibration.
    """
    wanted = labels.where(name(label).isin(0, 1)).groupBy(name(key).alias("_key")).agg(F.max(name(label)).alias("label"))
    chosen = bounded_sample(wanted.where(F.col("_key").isNotNull()), "_key", rows)
    # at most ``rows`` pairs of numbers, so a broadcast is safe
    fit = docs.select(name(key).alias("_key"), name(text).alias("text")).join(F.broadcast(chosen), "_key")
    fit = materialise(fit, "toxicity-fit")
    apart = F.pmod(F.xxhash64(F.lit("calibrate"), "_key"), F.lit(4)) == 0
    size = F.col("toxic") + F.col("other")
    counts = materialise(_counted(fit.where(~apart)).where((size >= 3) | (F.col("node") == END)), "toxicity-counts")
    total = counts.where(F.col("node") == END).first()
    if total is None or not total["toxic"] or not total["other"]:
        return Model({})
    share = F.lit(total["toxic"] / (total["toxic"] + total["other"]))
    telling = F.abs(F.col("toxic") - share * size) / F.sqrt(size * share * (1 - share) + 1)
    kept = counts.where(F.col("node") != END).withColumn("z", telling).where("z >= 2")
    kept = kept.orderBy(F.desc("z"), "node").limit(max_nodes)
    model = Model(_log_odds(kept.collect(), (total["toxic"], total["other"]), strength))
    held = fit.where(apart)
    model = _moments(model, held.where("label = 0"))
    cells = (
        score(held, "text", model, ["label"])
        .groupBy(F.round(F.least("evidence", F.lit(200.0)), 1).alias("x"))
        .agg(F.sum("label").alias("y"), F.sum(1 - F.col("label")).alias("n"))
        .collect()  # at most 2,001 rows
    )
    if sum(r["y"] for r in cells) and sum(r["n"] for r in cells):
        model.slope, model.intercept = _logistic([(r["x"], r["y"], r["n"]) for r in cells])
    return model


def score(df: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add ``segments`` (word positions and score of every toxic passage that is more than chance), ``evidence`` and
    ``score`` (0 to 1)."""

    def kernel():
        memo = Memo(model.word_score, 300_000)

        def one(t: str):
            words = WORD.findall(t.lower())
            found = segments(word_scores(words, memo))
            values = normalised(found, len(words), model.scale, model.log_k)
            told = evidence(told_once(words, found, values))
            kept = [{"start": a, "end": b, "score": v} for (a, b, _), v in zip(found, values) if v > 0]
            return kept, told, model.probability(min(told, 200.0))

        def work(array):
            rows = [one(t) for t in texts_of(array)]
            kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
            return [
                pa.array([r[0] for r in rows], pa.list_(kind)),
                pa.array([r[1] for r in rows], pa.float64()),
                pa.array([r[2] for r in rows], pa.float64()),
            ]

        return work

    fields = "segments array<struct<start: int, end: int, score: double>>, evidence double, score double"
    return annotate(df, [text], kernel, fields, keep)
