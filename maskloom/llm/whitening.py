"""Whitening of embedding vectors: principal components by spectral divide and conquer, then a broadcast projection.

Entries become whole numbers, x = floor(64 c) + OFFSET. One pass sums them by dimension, a second sums the products of
x less the whole number nearest to its mean. Both sums are of whole numbers and exact (up to 2^53), so the covariance
is that of a centred table, whatever the order in which tasks end. It has as many rows as a vector has entries,
so the components are found on the driver: the polar factor of the covariance less a shift, by dynamically weighted
Halley steps (QDWH), gives the projector on all components above the shift; its range and the complement split the
covariance into two smaller ones, and so on. A third pass projects every row.

Defined cases: vectors that are null or hold null or non-finite entries take no part, nor do those of another length
than most have (ties: the longer), nor empty ones. Repeated rows count as often as they stand there. Entries beyond
2^62 / 64 are held at that bound. Components of no variance (at most RANK of the largest) are left out. Other columns
are carried along, but for those named like a result. Without rows there is nothing to learn, and no row comes out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import annotate, bound_batches, list_array, name
from maskloom.session import materialise

STEPS, OFFSET = 64, 1_000_000
FAR = float(2**62)
RANK = 1e-13
COMPONENTS = 32


# Spectral divide and conquer


def polar(a: np.ndarray, tries: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, which is its sign function, by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = np.finfo(float).eps  # no singular value that matters lies below
    eye = np.eye(n)
    for _ in range(tries):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        u = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root))) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        q = np.linalg.qr(np.vstack([np.sqrt(w) * x, eye]))[0]
        new = (v / w) * x + (u - v / w) / np.sqrt(w) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (u + v * low**2) / (1 + w * low**2))
        if moved < 1e-13 * np.sqrt(n) and low > 1 - 1e-9:
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces; none where all eigenvalues are alike."""
    n = len(a)
    mean = np.trace(a) / n
    width = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if width <= 4 * np.finfo(float).eps * scale:
        return None
    draw = np.random.default_rng(n).standard_normal((n, n))
    # the median splits evenly; at the mean both sides hold something; the others avoid an eigenvalue
    for shift in (np.median(np.diag(a)), mean, *(mean + width * s for s in (0.05, -0.05, 0.1, -0.1, 0.2, -0.2))):
        sign = polar(a - shift * np.eye(n))
        above = round((np.trace(sign) + n) / 2)
        if not 0 < above < n or np.linalg.norm(sign @ sign - np.eye(n)) > 1e-10 * n:
            continue
        projector = (sign + np.eye(n)) / 2
        basis = np.linalg.qr(projector @ draw[:, :above])[0]
        basis = np.linalg.qr(projector @ basis)[0]
        whole = np.linalg.qr(basis, mode="complete")[0]
        one, two = whole[:, :above], whole[:, above:]
        if np.linalg.norm(two.T @ a @ one) <= 1e-11 * scale * n:
            return one, two
    return None


def components(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    scale = np.linalg.norm(a) if scale is None else scale
    n = len(a)
    if n < 2:
        return np.diag(a).copy(), np.eye(n)
    halves = _halves(a, scale)
    if halves is None:
        # all alike, but for rounding: any basis is one of eigenvectors
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(n)[:, order]
    values, vectors = [], []
    for basis in halves:
        part = basis.T @ a @ basis
        of, inner = components((part + part.T) / 2, scale)
        values.append(of)
        vectors.append(basis @ inner)
    values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# On Spark


@dataclass
class Whitening:
    """What the rows are projected with. ``matrix`` has a column for each component, over the root of its eigenvalue."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    matrix: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def middle(self) -> np.ndarray:
        """The whole number nearest to the mean of each dimension."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s - self.n * m for s, m in zip(self.sums, self.middle.tolist())]


def _valid(vector: str, length: int | None = None) -> Column:
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    values = name(vector).cast("array<double>")
    sized = F.size(values) > 0 if length is None else F.size(values) == length
    return values.isNotNull() & sized & F.coalesce(F.forall(values, entry), F.lit(False))


def _vectors(df: DataFrame, vector: str, length: int | None = None) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.where(_valid(vector, length)).select(name(vector).cast("array<double>").alias("vector"))


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(STEPS * values), -FAR, FAR).astype(np.int64) + OFFSET


def _matrix(array: pa.Array, length: int) -> np.ndarray:
    return whole_numbers(array.flatten().to_numpy(zero_copy_only=False)).reshape(-1, length)


def _sums(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Rows and sums by dimension, for the length that most vectors have."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for length in np.unique(sizes).tolist():
                x = _matrix(batch.column(0).filter(pa.array(sizes == length)), length)
                # in two parts, so that no sum overflows
                high, low = (x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0)
                n, *before = held.get(length, (0, 0, 0))
                held[length] = n + len(x), before[0] + high, before[1] + low
        for length, (n, high, low) in held.items():
            columns = [np.full(length, length, np.int32), np.arange(length, dtype=np.int32), np.full(length, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["length", "dim", "n", "high", "low"])

    parts = _vectors(df, vector).mapInArrow(run, "length int, dim int, n long, high long, low long")
    summed = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    totals = materialise(parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), *summed), "sums")
    most = totals.where("dim = 0").orderBy(F.col("n").desc(), F.col("length").desc()).first()
    if most is None:
        return 0, []
    # a number for each dimension
    rows = totals.where(F.col("length") == most["length"]).orderBy("dim").collect()
    return most["n"], [(int(r["high"]) << 31) + int(r["low"]) for r in rows]


def _products(vectors: DataFrame, rows_of, width: int) -> np.ndarray:
    """Sum over all rows of the products of each two numbers of ``rows_of`` (a matrix for an Arrow array)."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = rows_of(batch.column(0))
            total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(width, dtype=np.int32), width)),
                    pa.array(np.tile(np.arange(width, dtype=np.int32), width)),
                    pa.array(total.ravel()),
                ],
                names=["i", "j", "x"],
            )

    parts = vectors.mapInArrow(run, "i int, j int, x double").where("i <= j")
    out = np.zeros((width, width))
    # a number for each two dimensions
    for i, j, x in parts.groupBy("i", "j").agg(F.sum("x")).collect():
        out[i, j] = out[j, i] = x
    return out


def covariance(model: Whitening, products: np.ndarray) -> np.ndarray:
    """Of the rows, from the products about the model's ``middle``; worked out in whole numbers, then divided."""
    n = model.n
    exact = np.array([[int(v) for v in row] for row in products.tolist()], object)
    rest = np.array(model.rest, object)
    return ((n * exact - np.outer(rest, rest)) / n**2).astype(float)


def learn(df: DataFrame, vector: str, most: int = COMPONENTS) -> Whitening:
    """The first ``most`` components of all valid vectors."""
    n, sums = _sums(df, vector)
    model = Whitening(n, sums)
    if not n:
        return model
    length, middle = len(sums), model.middle
    products = _products(
        _vectors(df, vector, length), lambda array: (_matrix(array, length) - middle).astype(float), length
    )
    table = covariance(model, products)
    values, vectors = components(table)
    stays = np.flatnonzero(values > RANK * max(values[0], 0))[:most]
    values, vectors = values[stays], vectors[:, stays]
    largest = np.abs(vectors).argmax(axis=0) if len(stays) else []
    signs = np.sign(vectors[largest, np.arange(len(stays))])
    model.eigenvalues = values
    model.matrix = vectors * signs / np.sqrt(values)
    model.explained = values / np.trace(table)
    return model


def _deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """For each row the sum of (n x - S)^2 over the dimensions; null beyond 38 digits. ``x`` is less the middle."""
    rest = model.rest
    bound = model.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, rest)) if x.size else 0
    if len(rest) * bound**2 < 2**63:
        y = model.n * x - np.array(rest, np.int64)
        return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
    y = model.n * x.astype(object) - np.array(rest, object)
    from decimal import Decimal

    return pa.array([Decimal(v) if v < 10**38 else None for v in (y * y).sum(axis=1)], pa.decimal128(38, 0))


def whiten(df: DataFrame, vector: str, model: Whitening, keep: list[str] | None = None) -> DataFrame:
    """Add ``deviation`` (decimal) and ``whitened`` (one number a component) to the rows that take part."""
    length, k = len(model.sums), len(model.eigenvalues)
    keep = df.columns if keep is None else keep
    valid = df.where(_valid(vector, length)) if length else df.where(F.lit(False))

    def kernel():
        middle = model.middle if model.n else None

        def work(array):
            # as doubles, whatever the entries' type
            x = _matrix(array.cast(pa.list_(pa.float64())), length) - middle
            rows = (x - np.array(model.rest, float) / model.n) @ model.matrix
            return [_deviations(x, model), list_array(rows.ravel(), np.full(len(x), k), pa.float64())]

        return work

    return annotate(valid, [vector], kernel, "deviation decimal(38,0), whitened array<double>", keep)


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, by absolute value."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    rows = whitened.select("whitened")

    def with_ones(array):
        x = array.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        # whitened rows are centred already; the ones give what is left of their mean
        return np.hstack([x, np.ones((len(x), 1))])

    total = _products(rows, with_ones, k + 1) / model.n
    mean = total[k, :k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
