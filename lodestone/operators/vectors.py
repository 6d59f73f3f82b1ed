"""Nearest vectors by lists: coarse centroids, each vector in the list of its nearest one, and a query that looks through the lists
that lie nearest to it. search.cosines() is the exact scan beside it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.store import cut

#: Centroids are fitted on so many vectors at most, those with the least hashes of their ids, in so many rounds; every vector is in
#: a list. So many lists at most; vectors, and queries, that meet in one task.
SAMPLE, ROUNDS, LISTS, ROWS = 20_000, 8, 4096, 8192


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-9)


def centroids(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n unit vectors: means of the sample's unit vectors that lie nearest to them, from every (size / n)-th one on. A centroid
    without a vector stays where it is."""
    x = _unit(sample.astype(float))
    own = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(x @ own.T, axis=1)
        for j in np.unique(nearest).tolist():
            own[j] = x[nearest == j].mean(axis=0)
        own = _unit(own)
    return own


def _vectors(b: pa.RecordBatch, column: int, d: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vector has the length, and no null in it, with the vectors."""
    v = b.column(column)
    b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(v), d), False))
    x = pc.list_flatten(b.column(column)).to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    ok = np.isfinite(x).all(axis=1)
    return b.filter(pa.array(ok)), x[ok]


def _dealt(shared, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: id, vector. Each row for its nearest `probes` lists."""
    own = shared.value
    for b in batches:
        b, x = _vectors(b, 1, own.shape[1])
        near = np.argsort(-(x @ own.T), axis=1, kind="stable")[:, :probes]
        take = pa.array(np.repeat(np.arange(b.num_rows, dtype=np.int32), near.shape[1]))
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(near.ravel().astype(np.int32))], ["id", "v", "list"])


def _best(k: int, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """The k best rows of one block for each query that came to it, others than the query's own id."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
    if not rows.num_rows or not asked.num_rows:
        return empty
    whole = lambda t: np.stack(t.column("v").to_numpy()).astype(float)
    x, q = whole(rows), whole(asked)
    ids, names = rows.column("id").to_numpy(), asked.column("id").to_numpy()
    size = lambda m: np.sqrt((m * m).sum(axis=1)) + 1e-9
    cos = q @ x.T / (size(q)[:, None] * size(x))
    order = np.round(cos, 6)
    order[names[:, None] == ids] = -2.0
    ranked = np.stack([np.lexsort((ids, -o))[:k] for o in order])
    i = np.repeat(np.arange(len(q)), ranked.shape[1])
    j = ranked.ravel()
    ok = order[i, j] > 0
    return pa.table({"query_id": names[i[ok]], "id": ids[j[ok]], "cosine": cos[i[ok], j[ok]]})


class VectorLists:
    """vectors: (id, embedding), ids being longs. Vectors of another length than the commonest, and those with a null, NaN or infinite
    entry, are in no list and are never found; null ids aren't either. An empty table makes an index that finds nothing."""

    def __init__(self, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE):
        spark = vectors.sparkSession
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
        rows = cut(rows)
        length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
        self.rows = self.shared = None
        if length is None:
            return
        d = length["d"]
        drawn = rows.where((F.size("v") == d) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
        if not drawn:
            return
        n = min(lists or max(1, round(length["count"] ** 0.5)), LISTS, len(drawn))
        self.shared = spark.sparkContext.broadcast(centroids(np.array([r.v for r in drawn]), n))
        self.rows = cut(rows.mapInArrow(partial(_dealt, self.shared, 1), "id long, v array<double>, list int"))
        self.sizes = cut(self.rows.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks")))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """queries: (query_id, q). (query_id, id, rank, cosine): the k best other ids by cosine, to six places, equal ones by id, of
        those in the query's `probes` nearest lists; only positive ones. A list of any size is dealt to tasks in blocks, and so are
        the queries that look through it."""
        schema = "query_id long, id long, cosine double"
        if self.rows is None:
            return queries.sparkSession.createDataFrame([], "query_id long, id long, rank int, cosine double")
        asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("q").cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
        asked = cut(asked.mapInArrow(partial(_dealt, self.shared, probes), "id long, v array<double>, list int"))
        turns = asked.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("turns"))
        sizes = cut(self.sizes.join(turns, "list"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        key = ["list", "block", "turn"]
        left = self.rows.join(sizes, "list").select("id", "v", "list", own("blocks").alias("block"), every("turns").alias("turn"))
        right = asked.join(sizes, "list").select("id", "v", "list", own("turns").alias("turn"), every("blocks").alias("block"))
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(partial(_best, k), schema).withColumn("cosine", F.round("cosine", 6))
        w = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank", "cosine")
