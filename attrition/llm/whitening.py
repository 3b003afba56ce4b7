"""Embedding whitening with a polarisation covariance.

Entries become integers x = floor(64 c) + 1000000. Covariances come from variances
alone: cov(i, j) = (var(x_i + x_j) - var(x_i) - var(x_j)) / 2. So what is aggregated
is the square of the centred value for every dimension and for every sum of two
dimensions, all in integers:

1. one pass sums the x of each dimension (S) and counts the vectors (n);
2. one pass squares x less the integer below its mean, for dimensions and pair sums.
   A task keeps d (d + 1) / 2 running integers whatever the number of its rows; Spark
   adds the tasks' rows up. What the integer centre leaves (r = S mod n) is taken off
   exactly: sum (n y - r)^2 = n^2 sum y^2 - n r^2, as the y sum up to r;
3. the differences, exact until the last division, make the covariance for ``eigh``;
   it and the components are d^2 numbers, the only thing on the driver;
4. one pass projects x - S/n and divides by the root of the eigenvalue; another one
   measures the covariance of what came out.

Left out are rows whose vector is null or holds null, NaN or infinite entries, and
those whose length is not the most frequent one (of equally frequent ones the
longest). Entries beyond 2^30 count as 2^30. Rows that repeat an id, or have none, are
rows like any other; other columns are ignored; an empty table gives no rows. A
component without variance (an eigenvalue below 1e-12 of the largest) has null for
``whitened`` and counts in no ``identity_error``; its ``explained`` is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000           # Fixed values of the contract: x = floor(64 c) + 1000000
LIMIT = float(1 << 30)
FLAT = 1e-12                           # of the largest eigenvalue: no variance below


@dataclass(frozen=True)
class Fit:
    """What the whole table gives: S and n exactly, components of the covariance."""
    n: int
    sums: tuple[int, ...]              # S
    vectors: np.ndarray                # d x k, a unit eigenvector a column
    values: np.ndarray                 # k eigenvalues, falling
    trace: float

    @property
    def lows(self) -> np.ndarray:
        """The integer below each mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rests(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the rows that remain."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(vec_col).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c, F.lit(-LIMIT)), F.lit(LIMIT)) * SCALE) + SHIFT)
    rows = df.where(fine).select(F.col(id_col).alias("vec_id"), v.alias("v")).select("vec_id", x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0)).where(F.size("x") > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame, keys: list[str], run: Callable[[Iterator[np.ndarray]], dict]) -> list:
    """Rows (keys, total) of what ``run`` makes of the matrices of each task, added up."""
    def task(batches):
        found = run(_matrix(b.column("x")) for b in batches if b.num_rows)
        if found:
            at = list(zip(*found))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(k, pa.int32()) for k in at),
                 pa.array([Decimal(int(v)) for v in found.values()], pa.decimal128(38, 0))], names=[*keys, "part"])
    schema = ", ".join(f"{k} int" for k in keys) + ", part decimal(38,0)"
    return rows.select("x").mapInArrow(task, schema).groupBy(*keys).agg(F.sum("part").alias("total")).collect()


def _sums(matrices: Iterator[np.ndarray]) -> dict:
    """{(dimension,): sum}; under -1 the number of rows."""
    total: dict[tuple, int] = {}
    for x in matrices:
        for i, s in enumerate(x.sum(axis=0)):
            total[(i,)] = total.get((i,), 0) + int(s)
        total[(-1,)] = total.get((-1,), 0) + len(x)
    return total


def _squares(y: np.ndarray) -> np.ndarray:
    """For each i the sums over rows of (y_i + y_j)^2 for j > i, with y_i^2 in front;
    as one array. Exact: int64 as far as it reaches, Python's integers beyond."""
    d, most = y.shape[1], 2 * int(np.abs(y).max(initial=0)) + 1
    portion = (1 << 62) // most ** 2
    total = np.zeros(d * (d + 1) // 2, object)
    if not portion:
        y, portion = y.astype(object), len(y)
    for at in range(0, len(y), portion):
        z, parts = y[at:at + portion], []
        for i in range(d):
            sums = z[:, i:] + z[:, i:i + 1]
            sums[:, 0] = z[:, i]
            parts.append((sums * sums).sum(axis=0))
        total = total + np.concatenate(parts).astype(object)
    return total


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The whitening of rows (x array<long>) of one length; none of an empty table."""
    found = {r["i"]: int(r["total"]) for r in _summed(rows, ["i"], _sums)}
    n = found.pop(-1, 0)
    if not n:
        return None
    d = len(found)
    sums = tuple(found[i] for i in range(d))
    low = np.array([s // n for s in sums], np.int64)

    def squares(matrices: Iterator[np.ndarray]) -> dict:
        total = None
        for x in matrices:
            own = _squares(x - low)
            total = own if total is None else total + own
        if total is None:
            return {}
        return dict(zip(((i, j) for i in range(d) for j in range(i, d)), total))

    square = {(r["i"], r["j"]): int(r["total"]) for r in _summed(rows, ["i", "j"], squares)}
    rest = [s % n for s in sums]
    # n^2 times the variance of a dimension or of a sum of two
    alone = [n * square[i, i] - rest[i] ** 2 for i in range(d)]
    cov = np.zeros((d, d))
    for i in range(d):
        cov[i, i] = alone[i] / n ** 2
        for j in range(i + 1, d):
            both = n * square[i, j] - (rest[i] + rest[j]) ** 2
            cov[i, j] = cov[j, i] = (both - alone[i] - alone[j]) / (2 * n ** 2)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return Fit(n, sums, vectors * np.where(lead < 0, -1.0, 1.0), values, float(np.trace(cov)))


def _projected(x: np.ndarray, f: Fit) -> np.ndarray:
    """Whitened rows; NaN for components without variance."""
    centred = (x - f.lows) - f.rests / f.n
    flat = f.values <= FLAT * max(f.values[0], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(flat, np.nan, (centred @ f.vectors) / np.sqrt(np.where(flat, 1.0, f.values)))


def _deviations(x: np.ndarray, f: Fit) -> pa.Array:
    """Sums over dimensions of (n x - S)^2, exact."""
    y = x - f.lows
    if (int(np.abs(y).max(initial=0)) + 1) ** 2 * f.n ** 2 * y.shape[1] < 1 << 62:
        z = y * f.n - f.rests
        return pa.array((z * z).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    z = y.astype(object) * f.n - f.rests.astype(object)
    sums = [int(s) for s in (z * z).sum(axis=1)]
    return pa.array([Decimal(s) if s < 10 ** 38 else None for s in sums], pa.decimal128(38, 0))


def whitened(rows: DataFrame, f: Fit) -> DataFrame:
    """(vec_id, deviation decimal, whitened array<double>) of rows (vec_id, x)."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                w = _projected(x, f)
                values = pa.array(w.ravel(), from_pandas=True)
                offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), _deviations(x, f), pa.ListArray.from_arrays(offsets, values)],
                    names=["vec_id", "deviation", "whitened"])
    return rows.select("vec_id", "x").mapInArrow(
        run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity,
    measured on all rows."""
    k = len(f.values)

    def run(batches):
        gram, sums, seen = np.zeros((k, k)), np.zeros(k), False
        for b in batches:
            if b.num_rows:
                w, seen = _projected(_matrix(b.column("x")), f), True
                gram, sums = gram + w.T @ w, sums + w.sum(axis=0)
        if seen:
            table = np.vstack([gram, sums])
            i, j = np.indices(table.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(table.ravel())],
                names=["i", "j", "part"])
    total = np.zeros((k + 1, k))
    for r in rows.select("x").mapInArrow(run, "i int, j int, part double").groupBy("i", "j").agg(
            F.sum("part").alias("total")).collect():
        total[r["i"], r["j"]] = r["total"]
    mean = total[k] / f.n
    off = total[:k] / f.n - np.outer(mean, mean) - np.eye(k)
    return float(np.nanmax(np.abs(off))) if not np.isnan(off).all() else 0.0


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error:
    a row per remaining row and component. Runs jobs when called."""
    rows = integers(df, id_col, vec_col)
    f = fit(rows, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if f is None:
        return df.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
                "identity_error double")
    explained = F.array(*[F.lit(float(max(v, 0.0) / f.trace) if f.trace > 0 else 0.0) for v in f.values])
    error = identity_error(rows, f)
    return whitened(rows, f).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as long; null in a table so large that it has no room there."""
    return whiten(read_table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.expr("try_cast(deviation AS long)"))
