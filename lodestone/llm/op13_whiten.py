"""Embedding whitening by cyclic Jacobi.

The scatter of the centred vectors is summed in Spark, a matrix in each task. The driver has that one matrix, of a size that
depends on the dimension alone, and turns it by symmetric rotations until nothing is left off the diagonal, measured against
the two entries on it, so that small eigenvalues are as accurate as large ones. The whitening matrix is broadcast.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table

#: Entries are floor(GRID * c); so many components are given at most.
GRID, COMPONENTS = 256, 4
#: A component is of the covariance, and not of its rounding, if its eigenvalue is so much of the largest.
LEAST = 1e-13


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, as columns, of a symmetric matrix."""
    a, n = np.array(a, np.float64), len(a)
    vectors = np.eye(n)
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if off == 0 or abs(off) <= 1e-17 * math.sqrt(abs(a[p, p])) * math.sqrt(abs(a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = math.copysign(1 / (abs(theta) + math.hypot(1, theta)), theta)
                c = 1 / math.hypot(1, t)
                s, pp, qq = t * c, a[p, p] - t * off, a[q, q] + t * off
                for m in (a.T, vectors.T):  # columns of a and of the vectors
                    x, y = m[p].copy(), m[q].copy()
                    m[p], m[q] = c * x - s * y, s * x + c * y
                a[p, :], a[q, :] = a[:, p], a[:, q]
                a[p, p], a[q, q], a[p, q], a[q, p] = pp, qq, 0.0, 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _sums(d: int, batches):
    """Exact sums of each dimension, and the number of vectors in each row."""
    for b in batches:
        x = _matrix(b.column(0), d)
        if len(x):
            small = int(np.abs(x.astype(np.float64)).max()) < 2**62 // len(x)
            total = [int(v) for v in (x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total, pa.decimal128(38, 0)), pa.array([len(x)] * d, pa.int64())], ["i", "s", "n"])


def _scatter(d: int, shift: np.ndarray, project: np.ndarray | None, batches):
    """Sums over a task's vectors of the products of each two dimensions, centred, after a projection if there is one."""
    k = d if project is None else project.shape[1]
    held, first = np.zeros((k, k)), np.zeros(k)
    for b in batches:
        x = _matrix(b.column(0), d) - shift
        if project is not None:
            x = x @ project
        first += x.sum(axis=0)
        held += x.T @ x
    i, j = np.triu_indices(k)
    # The row -1 has the sums of the projected vectors.
    rows = [np.r_[i, np.full(k, -1)], np.r_[j, np.arange(k)]]
    yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in rows), pa.array(np.r_[held[i, j], first])], ["i", "j", "v"])


def scatter(points: DataFrame, d: int, shift: np.ndarray, project: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The scatter matrix and the sums of points - shift, projected."""
    got = points.mapInArrow(partial(_scatter, d, shift, project), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    k = d if project is None else project.shape[1]
    out, first = np.zeros((k, k)), np.zeros(k)
    for i, j, v in got.itertuples(index=False):
        if i < 0:
            first[j] = v
        else:
            out[i, j] = out[j, i] = v
    return out, first


def _rows(shared, batches):
    """The rows of each vector, one for each component."""
    n, total, mean, project, explained, error = shared.value
    k, d = len(explained), len(total)
    for b in batches:
        x = _matrix(b.column("x"), d)
        z = (x - mean) @ project
        # |n * x - total| is twice this bound at most.
        bound = max([n * float(np.abs(x.astype(np.float64)).max(initial=0)), *(float(abs(s)) for s in total)])
        if bound < 2**30 / math.sqrt(d):
            deviation = ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
        else:
            exact = [sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
            deviation = [v if v < 2**63 else None for v in exact]
        take = pa.array(np.repeat(np.arange(len(x), dtype=np.int32), k))
        yield pa.RecordBatch.from_arrays(
            [
                b.column("id").take(take),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array([n] * (k * len(x)), pa.int64()),
                pa.array(deviation, pa.int64()).take(take),
                pa.array(z.ravel(), from_pandas=True),
                pa.array(np.tile(explained, len(x)), from_pandas=True),
                pa.array([error] * (k * len(x)), pa.float64()),
            ],
            ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, grid: int = GRID) -> DataFrame:
    """One row per usable row and component: the id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained and identity_error.

    A row is dropped if its vector is null or empty, holds a null, NaN or infinite entry, or hasn't the commonest length (of
    equally common ones the longest). Entries become floor(grid * c), saturated at the ends of a long. The fit counts each distinct
    vector once, so copies, however many, weigh as one, and all rows of equal vectors get equal results. A dimension below
    `components` gives as many components. Where an eigenvalue is zero (below 1e-13 of the largest: one distinct vector, fewer
    than components, constant dimensions) whitened is null, and identity_error is over the other components; without any it is
    null. explained is null if the trace is zero. deviation is exact, and null where it is beyond a long. Null ids and repeated
    rows keep their rows. Only the named columns are read. No usable row gives no rows. The driver holds dimension squared
    numbers, and no vector.
    """
    spark, v = rows.sparkSession, F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    got = rows.select(F.col(id_col).alias("id"), F.when(F.size(v) > 0, F.transform(v, lambda c: F.floor(c.cast("double") * grid))).alias("x"), F.coalesce(finite, F.lit(False)).alias("ok"))
    got = cut(got.where("ok and x is not null").select("id", "x"))
    lengths = got.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    schema = f"id {got.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d = lengths["d"]
    got = got.where(F.size("x") == d)
    points = cut(got.select("x").distinct())
    sums = points.mapInArrow(partial(_sums, d), "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    mean = np.array([float(Fraction(s, n)) for s in total])
    covariance = scatter(points, d, mean)[0] / n
    values, vectors = jacobi(covariance)
    k = min(components, d)
    real = (values[:k] > LEAST * values[0]) & (values[:k] > 0)
    project = vectors[:, :k] / np.sqrt(np.where(real, values[:k], np.nan))
    trace = float(np.trace(covariance))
    explained, error = values[:k] / trace if trace > 0 else np.full(k, np.nan), None
    if real.any():
        # The covariance of the whitened fit list, centred by its own mean before multiplying.
        own = project[:, real]
        middle = scatter(points, d, mean, own)[1] / n
        back = np.linalg.lstsq(own.T, middle, rcond=None)[0]
        error = float(np.abs(scatter(points, d, mean + back, own)[0] / n - np.eye(int(real.sum()))).max())
    shared = spark.sparkContext.broadcast((n, total, mean, project, explained, error))
    return got.mapInArrow(partial(_rows, shared), schema).withColumnRenamed("id", id_col)


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whiten": op13_whiten}
#: Eigenvectors are beyond SQL; the test compares all columns with exact integers and numpy.linalg.eigh.
ORACLES: dict[str, str] = {}
