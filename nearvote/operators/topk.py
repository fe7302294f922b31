"""The k nearest of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearvote.schema import NO_DISTANCE, TOP

#: Queries of one block, the least; the blocks, not the whole set, go to the executors.
QUERY_BLOCK = 8192
#: Distances that a task holds at once.
DISTANCES = 1 << 22
#: Numbers of the vectors that a task holds at once, of rows and of a block's queries each.
NUMBERS = 1 << 22
#: Queries and rows of one group; groups are compared whole or not at all.
QUERY_GROUP, REF_GROUP = 64, 512


def top_k(candidates: DataFrame, *order: str | Column, k: int = TOP, by: str = "q_id") -> DataFrame:
    """The first k rows of each query by `order`, with their rank. First-scanned wins ties if the order ends in
    the scan order, last-scanned if in its descent. Spark keeps k rows a task before it shuffles."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def votes(nearest: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(q_id, frauds, worst): the sum of labels, and the k-th distance, which is NO_DISTANCE if there are fewer."""
    found = nearest.groupBy("q_id").agg(F.sum("label").cast("int").alias("frauds"), F.max(F.when(F.col("rank") == k, F.col("dist"))).alias("worst"))
    return queries.select("q_id").join(found, "q_id", "left").select("q_id", F.coalesce("frauds", F.lit(0)).alias("frauds"), F.coalesce("worst", F.lit(NO_DISTANCE)).alias("worst"))


def sorted_neighbours(nearest: DataFrame) -> DataFrame:
    """(q_id, neighbours): by query an array of (rank, dist, ref_id, label), sorted; k at the most."""
    return nearest.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "ref_id", "label"))).alias("neighbours"))


def whole_rows(batch: pa.RecordBatch, column: str, dims: int) -> pa.RecordBatch:
    """The rows whose vector has `dims` numbers, none of them null; found here, as a filter before the kernel would
    have Spark compute the vectors twice."""
    vectors = batch.column(column)
    ok = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False)
    empty = pc.list_flatten(vectors).is_null()
    if pc.any(empty).as_py():
        ok = ok.copy()
        ok[pc.list_parent_indices(vectors).filter(empty).to_numpy()] = False
    return batch if ok.all() else batch.filter(pa.array(ok))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b; exact for int16 values, as all terms are below 2 ** 53."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def query_blocks(queries: DataFrame, dims: int, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of blocks of queries (q_id, v), streamed from the cluster; without those of null or ragged vectors."""
    ids, vectors, held = [], [], []
    block = lambda: tuple(np.concatenate(x) for x in zip(*held, strict=True))
    for row in queries.select("q_id", "v").toLocalIterator():
        if row.v is None or len(row.v) != dims or None in row.v:
            continue
        ids.append(row.q_id)
        vectors.append(row.v)
        if len(ids) == min(size, 4096):
            held.append((np.array(ids), np.array(vectors, np.float64).reshape(-1, dims)))
            ids, vectors = [], []
            if len(held) * min(size, 4096) >= size:
                yield block()
                held = []
    if ids:
        held.append((np.array(ids), np.array(vectors, np.float64).reshape(-1, dims)))
    if held:
        yield block()


def split(v: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows of v in groups of at most `most`, cut at the median of the dimension that spreads most, again and again."""
    done, todo = [], [np.arange(len(v))] if len(v) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        part = v[rows]
        half = len(rows) // 2
        order = np.argpartition(part[:, np.argmax(part.std(axis=0))], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return done


def _boxes(v: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([v[g].min(axis=0) for g in groups]), np.array([v[g].max(axis=0) for g in groups])


class Nearest:
    """The k nearest of each query of a block among the rows that `add` has got, ties by ref_id. Queries and rows are
    cut into groups; rows whose box is farther from a group's box than its worst k-th distance are not looked at, as
    none of them can be among the nearest of any of its queries: the search stays exhaustive."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors, self.k = vectors, k
        self.groups = split(self.vectors, QUERY_GROUP)
        self.low, self.high = _boxes(self.vectors, self.groups)
        self.dist = np.full((len(vectors), k), np.inf)
        self.ref, self.label = (np.full((len(vectors), k), x, np.int64) for x in (np.iinfo(np.int64).max, 0))

    def add(self, ref: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        leaves = split(v, REF_GROUP)
        if not leaves:
            return
        low, high = _boxes(v, leaves)
        parts = [(ref[x], label[x], v[x]) for x in leaves]
        for g, rows in enumerate(self.groups):
            bound = (np.maximum(np.maximum(low - self.high[g], self.low[g] - high), 0.0) ** 2).sum(axis=1)
            for i in np.argsort(bound, kind="stable"):
                if bound[i] > self.dist[rows, -1].max():
                    break
                self._meet(rows, *parts[i])

    def _meet(self, rows: np.ndarray, ref: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        d = distances(self.vectors[rows], v)
        worst = self.dist[rows, -1]
        near = d <= worst[:, None]
        found = np.count_nonzero(near)
        if not found:
            return
        if found > self.k * len(rows) and d.shape[1] > self.k:
            near &= (d < worst[:, None]) | (ref < self.ref[rows, -1, None])
            near &= d <= np.partition(d, self.k - 1, axis=1)[:, self.k - 1, None]
        q, r = np.nonzero(near)
        some = np.unique(q)
        at = rows[some]
        q = np.concatenate((np.repeat(some, self.k), q))
        all_d, all_ref, all_label = (np.concatenate((old[at].ravel(), new)) for old, new in ((self.dist, d[near]), (self.ref, ref[r]), (self.label, label[r])))
        order = np.lexsort((all_ref, all_d, q))
        counts = np.bincount(q, minlength=len(rows))[some]
        take = order[(np.cumsum(counts) - counts)[:, None] + np.arange(self.k)]
        self.dist[at], self.ref[at], self.label[at] = all_d[take], all_ref[take], all_label[take]


def _near(refs: DataFrame, queries: DataFrame, dims: int, k: int | None) -> DataFrame:
    """(q_id, ref_id, dist, label) of the k nearest of each query in each task, or, without k, of all pairs. Pairs
    are made DISTANCES at a time; null and ragged vectors, of queries and refs, take no part."""
    parts = None
    for ids, vectors in query_blocks(queries, dims, QUERY_BLOCK if k is None else max(QUERY_BLOCK, NUMBERS // dims)):

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in (whole_rows(b, "v", dims) for b in batches):
                yield b.column("ref_id").to_numpy(), b.column("label").to_numpy(zero_copy_only=False), _matrix(b.column("v"), dims)

        def nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
            best, held, n = Nearest(vectors, k), [], 0
            for part in arrays(batches):
                held.append(part)
                n += part[2].size
                if n >= NUMBERS:
                    best.add(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
            if n:
                best.add(*map(np.concatenate, zip(*held, strict=True)))
            for at in range(0, len(ids), QUERY_BLOCK):
                q, place = np.nonzero(best.dist[at : at + QUERY_BLOCK] < np.inf)
                q += at
                yield _pairs(ids[q], best.ref[q, place], best.dist[q, place], best.label[q, place])

        def pairs(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
            step = max(1, DISTANCES // len(ids))
            for ref, label, v in arrays(batches):
                for at in range(0, len(ref), step):
                    d = distances(vectors, v[at : at + step])
                    yield _pairs(np.repeat(ids, d.shape[1]), np.tile(ref[at : at + step], len(ids)), d.ravel(), np.tile(label[at : at + step], len(ids)))

        found = refs.select("ref_id", "v", "label").mapInArrow(pairs if k is None else nearest, "q_id long, ref_id long, dist long, label int")
        parts = found if parts is None else parts.unionAll(found)
    return refs.sparkSession.createDataFrame([], "q_id long, ref_id long, dist long, label int") if parts is None else parts


def _pairs(q: np.ndarray, ref: np.ndarray, dist: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ref, pa.int64()), pa.array(dist.astype(np.int64)), pa.array(label.astype(np.int32))], ["q_id", "ref_id", "dist", "label"])


def exact_top_k(refs: DataFrame, queries: DataFrame, dims: int, k: int = TOP) -> DataFrame:
    """(q_id, rank, ref_id, dist, label): exhaustive search of queries (q_id, v) in refs (ref_id, v, label), ties
    by ref_id. Each task keeps its k nearest for each query of the block, so the shuffle has k rows for each
    query and task, whatever the number of pairs. Rows whose vector is null, has null numbers or not `dims` of them
    are found by no query, and such queries find nothing."""
    return top_k(_near(refs, queries, dims, k), "dist", "ref_id", k=k)


def all_distances(refs: DataFrame, queries: DataFrame, dims: int) -> DataFrame:
    """(q_id, ref_id, dist, label) of all pairs of whole vectors, made block by block."""
    return _near(refs, queries, dims, None)
