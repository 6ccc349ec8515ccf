"""Embedding whitening from an incremental eigendecomposition.

1. Every partition keeps the spectrum of the rows it has seen (count, exact sums, eigenvalues and eigenvectors of the centred scatter
   matrix) and takes in more rows by centred rank-one updates: each solves the secular equation of diagonal plus rank one, after
   deflating what the update leaves alone. Of a block of more rows than dimensions, the triangular factor is taken in, which has the
   same scatter in as many rows as there are dimensions; a row counts in it like in the block, copies included.
2. Spectra are combined in a tree of small groups, each by successive rank-one updates with the scaled eigenvectors of the other.
3. A Rayleigh-Ritz step over all rows refines the result: the covariance in the merged basis is summed in one pass and diagonalised.
4. One more pass measures how far the whitened rows' covariance is from the identity.

State, messages and what reaches the driver or a closure have d * d numbers for vectors of d entries, whatever the number of rows.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import combined

#: An entry c becomes the integer floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more don't fit the integers exactly; their vectors take no part, like those with an infinite entry.
ENTRY_LIMIT = 2.0**40
#: Rows that a block takes in at once.
BLOCK_ROWS = 4096
_EPS = float(np.finfo(float).eps)


# --- one rank-one update -------------------------------------------------------------------------------------------


def _roots(d: np.ndarray, u2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(u2 / (d - x)) for rising, separate poles d and sum(u2) = 1.

    Returns (nearest pole's number, distance from it) of each root, so that differences to poles keep their relative accuracy.
    """
    k = len(d)
    j = np.arange(k)
    above = np.append(d[1:], d[-1] + rho)
    half = (above - d) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at_middle = 1 + rho * (u2 / (d - (d + half)[:, None])).sum(1)
        left = (at_middle >= 0) | (j == k - 1)
        origin = np.where(left, j, np.minimum(j + 1, k - 1))
        delta = d[None, :] - d[origin][:, None]
        low = np.where(left, 0.0, -half)
        high = np.where(left, half, 0.0)
        high[-1] = rho
        x = (low + high) / 2
        lower = j[None, :] <= j[:, None]
        nxt = np.minimum(j + 1, k - 1)
        for _ in range(120):
            gap = delta - x[:, None]
            w = rho * u2 / gap
            f = 1 + w.sum(1)
            low, high = np.where(f <= 0, x, low), np.where(f > 0, x, high)
            slope = w / gap
            below, over = (slope * lower).sum(1), (slope * ~lower).sum(1)
            p, q = gap[j, j], gap[j, nxt]
            s, t = below * p * p, over * q * q
            c = f - s / p - np.where(j < k - 1, t / q, 0)
            a, b = c * (p + q) + s + t, p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = p[-1] + s[-1] / c[-1]  # one pole only
            moved = x + step
            fits = np.isfinite(moved) & (moved > low) & (moved < high)
            moved = np.where(fits, moved, (low + high) / 2)
            done = (np.abs(f) <= 4 * _EPS * (1 + np.abs(w).sum(1))) | (np.abs(moved - x) <= 2 * _EPS * np.abs(x))
            x = np.where(done, x, moved)
            if done.all():
                break
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of vectors * diag(values) * vectors' + y y'."""
    z = vectors.T @ y
    norm = float(np.sqrt(z @ z))
    if norm == 0:
        return values, vectors
    u, rho = z / norm, norm * norm
    tolerance = 8 * _EPS * max(float(np.abs(values).max()), rho)
    active = np.flatnonzero(rho * np.abs(u) > tolerance)
    if len(active) == 0:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    a, b = active[:-1], active[1:]
    if ((values[b] - values[a]) * np.abs(u[a] * u[b]) <= tolerance * (u[a] ** 2 + u[b] ** 2)).any():
        kept, i = [], int(active[0])  # equal poles: turn the pair until one of them is left alone
        for j in map(int, active[1:]):
            r = float(np.hypot(u[i], u[j]))
            c, s = u[j] / r, u[i] / r
            if (values[j] - values[i]) * abs(c * s) <= tolerance:
                u[j], u[i] = r, 0.0
                vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
                values[i], values[j] = c * c * values[i] + s * s * values[j], s * s * values[i] + c * c * values[j]
            else:
                kept.append(i)
            i = j
        active = np.array([*kept, i])
    order = active[np.argsort(values[active], kind="stable")]
    d, k = values[order], len(order)
    u2 = u[order] ** 2
    rho *= float(u2.sum())
    origin, x = _roots(d, u2 / u2.sum(), rho)
    gap = d[None, :] - d[origin][:, None] - x[:, None]  # pole i less root j, in row j
    # The update whose exact eigenvalues are these roots; its eigenvectors are orthogonal whatever the roots' rounding.
    i, j = np.arange(k)[None, :], np.arange(k - 1)[:, None]
    ratio = gap[:-1] / (d[None, :] - np.where(j < i, d[:-1, None], d[1:, None]))
    exact = np.sqrt(np.abs(ratio.prod(0) * gap[-1])) * np.sign(u[order])
    turn = exact[:, None] / gap.T
    turn /= np.sqrt((turn * turn).sum(0))
    vectors[:, order] = vectors[:, order] @ turn
    values[order] = np.maximum(d[origin] + x, 0)
    rising = np.argsort(values, kind="stable")
    return values[rising], vectors[:, rising]


@dataclass
class Spectrum:
    """What is known of some rows: how many, their exact sums, and the eigenvalues and eigenvectors of their centred scatter."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, [0] * d, np.zeros(d), np.eye(d))

    def take(self, n: int, sums: list[int], rows: np.ndarray) -> None:
        """Add ``n`` vectors with these sums, whose centred scatter is rows' rows."""
        if n == 0:
            return
        if self.n:
            apart = self.n * n
            shift = np.array([(self.n * s - n * mine) / apart for s, mine in zip(sums, self.sums, strict=True)])
            rows = np.vstack([rows, shift * np.sqrt(apart / (self.n + n))])
        for y in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, y)
        self.n, self.sums = self.n + n, [s + mine for s, mine in zip(sums, self.sums, strict=True)]

    def take_block(self, x: np.ndarray) -> None:
        n, sums = len(x), [int(s) for s in x.sum(0)]
        rows = centred(x, n, sums)
        self.take(n, sums, np.linalg.qr(rows, mode="r") if n > x.shape[1] else rows)

    def take_spectrum(self, other: Spectrum) -> None:
        self.take(other.n, other.sums, (other.vectors * np.sqrt(other.values)).T[other.values > 0])

    def packed(self) -> bytes:
        sums = " ".join(map(str, [self.n, *self.sums])).encode()
        return len(sums).to_bytes(8, "little") + sums + self.values.tobytes() + self.vectors.tobytes()

    @classmethod
    def unpacked(cls, state: bytes) -> Spectrum:
        end = 8 + int.from_bytes(state[:8], "little")
        n, *sums = map(int, state[8:end].split())
        numbers, d = np.frombuffer(state[end:], np.float64), len(sums)
        return cls(n, sums, numbers[:d].copy(), numbers[d:].reshape(d, d).copy())


# --- exact helpers -------------------------------------------------------------------------------------------------


def whole(x: np.ndarray) -> np.ndarray:
    """Entries (doubles) as the integers of the contract."""
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where they are enough, else in Python's integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, rounded once."""
    return np.asarray(_apart(x, n, sums) / n, dtype=float)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the entries of (n * x - sums) ** 2, exactly."""
    apart = _apart(x, n, sums)
    if apart.dtype == object or x.shape[1] * int(np.abs(apart).max(initial=0)) ** 2 >= 2**62:
        apart = apart.astype(object)
    return [int(v) for v in (apart * apart).sum(1)]


# --- the distributed passes ----------------------------------------------------------------------------------------


def _blocks(batch: pa.RecordBatch, d: int, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    entries = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for at in range(0, len(entries), rows):
        yield at, whole(entries[at : at + rows])


def _summed(vectors: DataFrame, empty: Callable, take: Callable, combine: Callable, pack: Callable, unpack: Callable, d: int, name: str):
    """The state that every partition's rows make, combined in a tree."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = empty(), False
        for b in batches:
            for _, x in _blocks(b, d, BLOCK_ROWS):
                take(state, x)
                seen = True
        if seen:
            yield pa.record_batch([pa.array([pack(state)], pa.binary())], ["state"])

    def merged(states: list[bytes]) -> bytes:
        return pack(functools.reduce(combine, map(unpack, states)))

    states = vectors.select("vector").mapInArrow(partition, "state binary").select(F.spark_partition_id().cast("long").alias("part"), "state")
    last = combined(states, merged, name)
    return None if last is None else unpack(last)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, without null, infinite, NaN or over-large entries."""
    entries = vector.cast("array<double>")
    fine = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(ENTRY_LIMIT)))
    return F.coalesce(entries.isNotNull() & (F.size(entries) > 0) & fine, F.lit(False))


@dataclass
class Whitening:
    """A fitted transform: components are rows of ``components``, by falling eigenvalue; ``spread`` is the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.values)[:, None]).T


def _prepared(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    rows = vectors.filter(usable(F.col(vector))).select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    common = sizes.agg(F.max(F.struct("rows", "d")).alias("most")).first()["most"]
    return (rows.limit(0), 0) if common is None else (rows.filter(F.size("vector") == common["d"]), common["d"])


def _fitted(rows: DataFrame, d: int, most: int) -> Whitening | None:
    if d == 0:
        return None

    def joined(a: Spectrum, b: Spectrum) -> Spectrum:
        a.take_spectrum(b)
        return a

    seen = _summed(rows, functools.partial(Spectrum.empty, d), Spectrum.take_block, joined, Spectrum.packed, Spectrum.unpacked, d, "white-spectra")
    basis, _ = np.linalg.qr(seen.vectors)
    n, sums = seen.n, seen.sums

    def add(state: np.ndarray, x: np.ndarray) -> None:
        turned = centred(x, n, sums) @ basis
        state += turned.T @ turned

    matrix = _summed(rows, lambda: np.zeros((d, d)), add, operator.add, np.ndarray.tobytes, lambda b: np.frombuffer(b).reshape(d, d).copy(), d, "white-ritz")
    values, turn = np.linalg.eigh((matrix + matrix.T) / (2 * n))
    values, components = values[::-1], (basis @ turn).T[::-1]
    stay = int((values > d * _EPS * max(values[0], 0)).sum()) if values[0] > 0 else 0
    stay = min(stay, most)
    return Whitening(n, sums, components[:stay].copy(), values[:stay].copy(), float(matrix.trace() / n))


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> Whitening | None:
    """The leading ``most`` components of the vectors that take part (see :func:`whiten`); None where there are none."""
    return _fitted(*_prepared(vectors, key, vector), most)


def _identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    k = len(model.values)

    def add(state: np.ndarray, x: np.ndarray) -> None:
        scores = model.scores(x)
        state[:k] += scores.T @ scores
        state[k] += scores.sum(0)

    total = _summed(rows, lambda: np.zeros((k + 1, k)), add, operator.add, np.ndarray.tobytes, lambda b: np.frombuffer(b).reshape(k + 1, k).copy(), d, "white-identity")
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """One row per vector that takes part and component (from 1, by falling eigenvalue, ``most`` at most): vec_id, component, n,
    deviation, whitened, explained, identity_error, and deviation_exact.

    Vectors that are null, empty or hold null, infinite, NaN or entries of 2**40 and more take no part; nor do those of another length
    than the commonest one (the longer of equally common ones). Repeated rows and ids, and null ids, count as rows of their own.
    Components whose eigenvalue is zero up to rounding can't be scaled to variance one and are left out, so equal vectors, one vector
    or an empty table give no rows. ``deviation`` is null where the exact number, in ``deviation_exact`` (38 digits), doesn't fit a
    long. Other columns are not read.
    """
    rows, d = _prepared(vectors, key, vector)
    model = _fitted(rows, d, most)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if model is None or len(model.values) == 0:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    error = _identity_error(rows, d, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _blocks(b, d, BLOCK_ROWS):
                scores = model.scores(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32)), pa.array(scores.ravel()))
                exact = pa.array([str(v) for v in deviations(x, model.n, model.sums)])
                yield pa.record_batch([b.column("vec_id").slice(at, len(x)), exact, lists], ["vec_id", "exact", "scores"])

    out = rows.mapInArrow(scored, f"vec_id {kind}, exact string, scores array<double>")
    shares = F.array(*[F.lit(float(v / model.spread)) for v in model.values])
    out = out.select("vec_id", F.col("exact").cast("decimal(38,0)").alias("exact"), F.posexplode("scores").alias("place", "whitened"))
    fits = F.col("exact") <= F.lit(2**63 - 1).cast("decimal(38,0)")
    return out.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.when(fits, F.col("exact").cast("long")).alias("deviation"),
        "whitened", F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"), F.col("exact").alias("deviation_exact"),
    )
