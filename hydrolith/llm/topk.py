"""Exact top-k inner products by a pivot table with elimination in order of bounds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import ensure_checkpoint_dir

#: Queries that are sent to the tasks at once, bytes of them, and rows that a task looks at together: they bound memory only.
QUERIES, BYTES, ROWS = 4096, 1 << 26, 8192
#: Bounds are real numbers; scores within this, and this part of the two squared lengths, of a bound are evaluated.
SLACK, PART = 1e-3, 1e-6
#: Sums of products below this are exact as real numbers; beyond, scores are summed as whole numbers of any size.
EXACT = 2.0**53
LONG, LOW = 2**63 - 1, 2**50 - 1


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as a long, or null if the vector is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, away = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


class Search:
    """The best k of the rows seen so far for each query of a block. ``floors`` are scores that k rows are known to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int, floors: np.ndarray | None = None, wide: np.ndarray | None = None) -> None:
        self.ids, self.vectors, self.pivots, self.k, self.wide = ids, vectors, pivots, k, wide
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors
        self.norms = (vectors**2).sum(axis=1)
        self.table = self.distances(vectors)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, object if wide is not None else float), np.empty(0, np.int64))] * len(ids)
        self.evaluated = 0

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """The pivot table: distances of rows to the pivots, a row a pivot."""
        square = (self.pivots**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1) - 2 * self.pivots @ rows.T
        return np.sqrt(np.maximum(square, 0))

    def add(self, ids: np.ndarray, rows: np.ndarray, wide: np.ndarray | None = None) -> None:
        table, norms = self.distances(rows), (rows**2).sum(axis=1)
        for at in range(0, len(self.ids), 32):
            part = slice(at, at + 32)
            apart = np.zeros((len(self.ids[part]), len(ids)))
            for p in range(len(self.pivots)):
                np.maximum(apart, np.abs(self.table[p, part, None] - table[p]), out=apart)
            # |q - x| is at least what any pivot tells, so q.x is at most this
            square = self.norms[part, None] + norms
            bounds = (square - apart**2) / 2 + PART * square + SLACK
            for i, bound in enumerate(bounds, at):
                self.search(i, bound, ids, rows, wide)

    def scores(self, i: int, now: np.ndarray, rows: np.ndarray, wide: np.ndarray | None) -> np.ndarray:
        return rows[now] @ self.vectors[i] if self.wide is None else np.array([sum(a * b for a, b in zip(x, self.wide[i])) for x in wide[now]], object)

    def search(self, i: int, bound: np.ndarray, ids: np.ndarray, rows: np.ndarray, wide: np.ndarray | None) -> None:
        scores, found = self.best[i]
        floor = max(float(scores[-1]) if len(scores) == self.k else -np.inf, self.floors[i])
        left = np.flatnonzero((bound >= floor) & (ids != self.ids[i]))
        step = 256
        while len(left):
            if len(left) > step:  # the candidates of the highest bounds come next
                order = np.argpartition(-bound[left], step)
                now, left = left[order[:step]], left[order[step:]]
            else:
                now, left = left, left[:0]
            self.evaluated += len(now)
            value = self.scores(i, now, rows, wide)
            near = value >= self.floors[i]
            scores, found = np.concatenate([scores, value[near]]), np.concatenate([found, ids[now][near]])
            order = np.array(sorted(range(len(found)), key=lambda j: (-scores[j], found[j]))[: self.k], np.int64) if self.wide is not None else np.lexsort((found, -scores))[: self.k]
            scores, found = scores[order], found[order]
            if len(scores) == self.k:
                left = left[bound[left] >= float(scores[-1])]
            step *= 2
        self.best[i] = scores, found


def _floors(ids: np.ndarray, vectors: np.ndarray, known: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k rows of the sample reach, or minus infinity."""
    scores = np.where(ids[:, None] != known, vectors @ sample.T, -np.inf)
    return np.partition(scores, -k, axis=1)[:, -k] if len(known) >= k else np.full(len(ids), -np.inf)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, pivots: int = 24, sample: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of highest inner product, ties to the smaller vec_id.

    Both tables have vec_id (long) and v (array of integers as longs, null where a row takes no part). A query's own
    row, that of its vec_id, is no candidate; other equal vectors are. Vectors of unlike length are compared as if
    zeros followed. Rows repeated in the table are candidates each, and repeated queries are answered once. Queries
    with fewer than k candidates get all. Rows with a null vec_id take no part. An empty table gives no rows. Scores
    are exact whatever the size of components, and ordered so; one that no long can hold is shown as the nearest long.

    Pivots are far-apart rows of a sample of ``sample`` rows, the only thing that is sampled: they decide how soon
    candidates fall, not which. Every row's distances to the pivots bound its inner product with a query from
    above; candidates are evaluated from the highest bound on until the k-th best score is above all bounds left.
    The k-th best of the sample is known before, so a task returns only rows that reach it, k at most a query.

    Queries are dealt with in blocks, each against all rows: the driver and a task hold one block of QUERIES queries
    or BYTES, and results of a block are written before the next one begins.
    """
    own = rows.where("vec_id is not null and v is not null").select("vec_id", "v")
    asked = queries.where("vec_id is not null and v is not null").select("vec_id", "v").dropDuplicates(["vec_id"])
    size = F.coalesce(F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))), F.lit(0.0))
    n, dim, most = own.agg(F.count("*"), F.max(F.size("v")), size).first()
    n_asked, dim_asked, most_asked = asked.agg(F.count("*"), F.max(F.size("v")), size).first()
    spark = rows.sparkSession
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, dim_asked, 1)
    wide = max(most, most_asked) ** 2 * dim >= EXACT
    few = own.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).collect()
    known, seen = np.array([r[0] for r in few], np.int64), _matrix([r[1] for r in few], dim)
    chosen = _far_apart(seen, pivots)
    blocks = -(-n_asked // max(1, min(QUERIES, BYTES // (8 * dim))))
    best = Window.partitionBy("query_id").orderBy(F.col("key").desc(), "vec_id")
    path = f"{ensure_checkpoint_dir(spark)}/top-{uuid.uuid4().hex}"
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        ids, vectors = np.array([r[0] for r in part], np.int64), _matrix([r[1] for r in part], dim)
        floors = None if wide else _floors(ids, vectors, known, seen, k)
        sent = spark.sparkContext.broadcast((ids, vectors, chosen, floors, _whole([r[1] for r in part], dim) if wide else None))
        found = own.mapInArrow(_searcher(sent, k, dim), "query_id long, vec_id long, score long, key array<long>")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = found.select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return found
        found.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.parquet(path)


def _whole(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), object)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = [int(x) for x in v]
    return out


def _searcher(sent, k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, chosen, floors, whole = sent.value
        search = Search(ids, vectors, chosen, k, floors, whole)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column("v")
                sizes = np.diff(lists.offsets.to_numpy())
                if (sizes == dim).all():
                    matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                else:
                    matrix = _matrix(lists.to_pylist(), dim)
                search.add(part.column("vec_id").to_numpy(zero_copy_only=False), matrix, None if whole is None else _whole(lists.to_pylist(), dim))
        for i, (scores, found) in enumerate(search.best):
            if len(found):
                values = [int(x) for x in scores]
                keys = [[x] for x in values] if whole is None else [[x >> 100, x >> 50 & LOW, x & LOW] for x in values]
                columns = [pa.array(np.full(len(found), ids[i])), pa.array(found), pa.array([min(max(x, -LONG - 1), LONG) for x in values], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "key"])

    return run
