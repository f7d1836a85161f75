"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

The vectors, as whole numbers, are read three times and written once: exact sums by dimension, the
scatter of what is left after the mean is taken off, the whitened rows (stored), and their covariance,
which says how far from the identity it is.  A task adds up its own batches; Spark adds up
the tasks; the driver sees d rows of d numbers, whatever the number of vectors.

With V the covariance, the Cholesky factorisation takes the largest remaining diagonal entry as its next
pivot and ends where nothing but rounding is left: V = G G' with G the (row-permuted back) triangular
factor.  Jacobi rotations from the right make the columns of G orthogonal without ever
forming V again, so small eigenvalues keep their relative precision: the squared norms of the rotated
columns are the eigenvalues, the normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, stored, table

#: Components of a row, and the contract's whole numbers: floor(SCALE * entry) + SHIFT.
COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Remaining diagonal, as a share of the first pivot, below which the rank is reached.
RANK = 1e-13
#: Sweeps of rotations at most; cosine below which two columns count as orthogonal.
SWEEPS, ORTHOGONAL = 60, 1e-15
#: Vectors in an Arrow batch; entries are held to this size.
BATCH, BOUND = 4096, float(1 << 30)


def pivoted_cholesky(v: np.ndarray, rank: float = RANK) -> np.ndarray:
    """``g`` (d x r) with v = g g', for a positive semidefinite ``v``; r is the numerical rank.

    Its rows, taken in the order of the pivots, are lower triangular.
    """
    d = len(v)
    rest, g = np.diag(v).astype(float).copy(), np.zeros((d, d))
    open_ = np.ones(d, bool)
    top = rest.max(initial=0.0)
    for k in range(d):
        p = int(np.where(open_, rest, -np.inf).argmax())
        if not rest[p] > rank * top:
            return g[:, :k]
        column = (v[:, p] - g[:, :k] @ g[p, :k]) / np.sqrt(rest[p])
        column[~open_] = 0.0
        column[p] = np.sqrt(rest[p])
        g[:, k] = column
        open_[p] = False
        rest = rest - column * column
    return g


def one_sided_jacobi(g: np.ndarray) -> np.ndarray:
    """``g`` times a rotation, with orthogonal columns in falling order of their norms.

    Columns are paired as in a round-robin tournament: each round rotates disjoint pairs at once.
    """
    g = g.copy()
    r = g.shape[1]
    players = list(range(r + r % 2))  # an odd one out pauses
    for _ in range(SWEEPS if r > 1 else 0):
        worst = 0.0
        for _ in range(len(players) - 1):
            pairs = [(a, b) for a, b in zip(players[: len(players) // 2], players[: len(players) // 2 - 1 : -1], strict=True) if a < r and b < r]
            players = [players[0], players[-1], *players[1:-1]]
            a, b = np.array(pairs).T
            x, y = g[:, a], g[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(xy) / np.sqrt(np.maximum(xx * yy, 1e-300))
            worst = max(worst, float(cosine.max()))
            turn = cosine > ORTHOGONAL
            tau = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            tan = np.where(turn, np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau)), 0.0)
            cos = 1 / np.hypot(1.0, tan)
            sin = tan * cos
            g[:, a], g[:, b] = cos * x - sin * y, sin * x + cos * y
        if worst <= 4 * ORTHOGONAL:
            break
    return g[:, np.argsort(-(g * g).sum(0), kind="stable")]


@dataclass
class Whitener:
    """n and sums of the fit list, eigenvalues in falling order, components as columns, trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean in double, from whole numbers that are exact."""
        return (self.n * x - self.sums).astype(np.float64) / self.n

    def whiten(self, x: np.ndarray, most: int) -> np.ndarray:
        return self.centred(x) @ (self.components[:, :most] / np.sqrt(self.values[:most]))


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns; the largest entry positive) of ``v``, up to its rank."""
    g = one_sided_jacobi(pivoted_cholesky(v))
    norms = np.sqrt((g * g).sum(0))
    unit = g / norms if g.size else g
    if unit.size:
        unit = unit * np.where(unit[np.abs(unit).argmax(0), np.arange(unit.shape[1])] < 0, -1.0, 1.0)
    return norms**2, unit


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array<long>) of rows whose vector has entries, none of them null or not finite.

    Vectors of another length than the longest one take no part either, as they have no place in the space.
    Entries beyond BOUND count as that, so that sums stay within 64 bits.
    """
    e = F.col("embedding")
    bad = lambda c: c.isNull() | F.isnan(c) | F.abs(c).isin(float("inf"))
    held = lambda c: F.greatest(F.least(c.cast("double"), F.lit(BOUND)), F.lit(-BOUND))
    whole = F.transform(e, lambda c: F.floor(held(c) * SCALE) + SHIFT)
    return embeddings.where(e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(F.exists(e, bad), F.lit(True))).select("vec_id", whole.alias("x"))


def _matrix(b: pa.RecordBatch, column: str, d: int, kind) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, d)


def _added(task):
    """The sum of what ``task`` makes of a task's batches, one row for each of its rows: (at, t0, t1, ...)."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            if b.num_rows:
                own = task(b)
                total = own if total is None else total + own
        if total is not None:
            rows = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(c) for c in total.T)], ["at", *(f"t{j}" for j in range(total.shape[1]))])

    return add


def _total(rows: DataFrame, task, width: int, kind: str = "double") -> np.ndarray:
    """Sum over all tasks of the matrices that ``task`` makes of their batches; no rows without a batch."""
    names = [f"t{j}" for j in range(width)]
    made = rows.mapInArrow(_added(task), "at int, " + ", ".join(f"{x} {kind}" for x in names))
    found = made.groupBy("at").agg(*(F.sum(x).alias(x) for x in names)).orderBy("at").toArrow()
    return np.stack([found[x].to_numpy() for x in names], 1)


def fit(vectors: DataFrame, d: int) -> Whitener | None:
    """Mean and components of ``vectors`` (vec_id, x; all of length ``d``); None without a vector.

    The covariance is over all rows, with divisor n, and centred before anything is multiplied.
    """

    def counted(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b, "x", d, np.int64)
        return np.stack([x.sum(0), np.full(d, len(x))], 1)

    found = _total(vectors.select("x"), counted, 2, "long")
    if not len(found):
        return None
    s, n = found[:, 0], int(found[0, 1])

    def scatter(b: pa.RecordBatch) -> np.ndarray:
        y = (n * _matrix(b, "x", d, np.int64) - s).astype(np.float64) / n
        return y.T @ y

    v = _total(vectors.select("x"), scatter, d) / n
    values, components = components_of((v + v.T) / 2)
    return Whitener(n, s, values, components, float(np.trace(v)))


_ROWS = "vec_id long, deviation long, white array<double>"


def _whitened(held, most: int):
    def whiten(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitener = held.value
        d = len(w.sums)
        for b in it:
            x = _matrix(b, "x", d, np.int64)
            apart = w.n * x - w.sums
            largest = int(np.abs(apart).max(initial=0))
            if largest * largest * d < 1 << 62:
                deviation = pa.array((apart * apart).sum(1))
            else:  # whole numbers beyond 64 bits on the way; null where the sum itself is beyond them
                exact = [sum(c * c for c in row) for row in apart.tolist()]
                deviation = pa.array([t if t < 1 << 63 else None for t in exact], pa.int64())
            white = w.whiten(x, most)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, flat], ["vec_id", "deviation", "white"])

    return whiten


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``most`` whitened components, or as many as the rank has, of every usable row of ``embeddings`` (vec_id, embedding).

    One row per row and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error.  Rows with a null or empty vector, or with a null or non-finite entry, take no part, nor do
    vectors that are shorter than the longest.  A null vec_id stays null; repeated rows each count and are each
    returned.  Directions without variance have no component, so equal vectors only, or a single one, give no
    rows; so does an empty table.  deviation is null where it does not fit 64 bits.  Other columns are not read.
    """
    spark = embeddings.sparkSession
    short_batches(spark, BATCH)
    vectors = usable(embeddings)
    longest = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    vectors = vectors.where(F.size("x") == longest)
    w = fit(vectors, longest)
    most = min(most, len(w.values)) if w else 0
    if not most:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    held = spark.sparkContext.broadcast(w)
    rows = stored(vectors.mapInArrow(_whitened(held, most), _ROWS), "whitened")

    mean = np.array(rows.select(*(F.avg(F.col("white")[j]) for j in range(most))).first())

    def scatter(b: pa.RecordBatch) -> np.ndarray:
        y = _matrix(b, "white", most, np.float64) - mean
        return y.T @ y

    error = float(np.abs(_total(rows.select("white"), scatter, most) / w.n - np.eye(most)).max())
    explained = F.array(*(F.lit(float(e / w.trace)) for e in w.values[:most]))
    return rows.select("vec_id", F.posexplode("white").alias("at", "whitened"), "deviation").select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
