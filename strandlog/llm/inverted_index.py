"""Approximate nearest neighbours through an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids, so a vector lies in the cell of a pair of centroids. A
query visits the pairs in order of the sum of the distances of its halves, taken from a heap, until the cells visited hold
``reach`` rows; the entries of those cells are ranked by their exact inner product. As nearness is the inner product, a
half's distance to a centroid is how much its inner product lacks of the best one among the centroids.

What is fitted on bounded samples: centroids on ``SAMPLE`` vectors; ``reach`` on ``ASKED`` of the queries, whose exact
neighbours among all vectors show how far the traversal must go to meet ``recall`` of them. So the index reads little where
vectors cluster and much where they are random directions, which no index can tell apart.

Cells are packed into shards of about ``SHARD`` entries, and larger cells are split over several, so that no task holds a
hot cell. A query is sent once to each shard that has one of its cells, and leaves it with its best k there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import rounds, save

K = 20
SAMPLE = 10_000
ASKED = 200
RECALL = 0.95
SHARD = 8192
CENTROIDS = 256
EVERY = 20
_NEAR = 1e-9
_PAIRS = 1 << 15

_FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def centroids(points: np.ndarray, k: int, rounds_: int = 12, seed: int = 7) -> np.ndarray:
    """k-means of points (n, d), by Lloyd's rounds from k different points; as many as there are different ones, at most k."""
    different = np.unique(points, axis=0)
    at = different[np.random.default_rng(seed).permutation(len(different))[:k]]
    for _ in range(rounds_):
        own = _nearest(points, at)
        n = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, points)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def _nearest(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((at**2).sum(axis=1) - 2 * points @ at.T).argmin(axis=1)


class MultiIndex:
    """The centroids of both halves, the number of entries in each cell, the shards of each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.cut = first, second, first.shape[1]
        self.n_cells = len(first) * len(second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.cut], self.first) * len(self.second) + _nearest(x[:, self.cut :], self.second)

    def fill(self, sizes: np.ndarray, shard: int) -> None:
        """Small cells one after another into shards, a large one into as many of its own as it needs."""
        self.sizes, self.base, self.parts = sizes, np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // shard))
        at, held = 0, 0
        for c, n in enumerate(sizes.tolist()):
            if held and held + n > shard:
                at, held = at + 1, 0
            self.base[c] = at
            held += n
            if self.parts[c] > 1:
                at, held = at + int(self.parts[c]), 0

    def lacks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each centroid lacks of the best one, for the halves of each row."""
        out = [x[:, : self.cut] @ self.first.T, x[:, self.cut :] @ self.second.T]
        return tuple(y.max(axis=1, keepdims=True) - y for y in out)

    def visited(self, lack1: np.ndarray, lack2: np.ndarray, reach: int) -> list[int]:
        """The cells with entries, in order of the summed lacks, until they hold ``reach`` entries."""
        order1, order2 = np.argsort(lack1, kind="stable").tolist(), np.argsort(lack2, kind="stable").tolist()
        d1, d2 = lack1[order1].tolist(), lack2[order2].tolist()
        sizes, width, out, met = self.sizes, len(self.second), [], 0
        heap = [(d1[0] + d2[0], 0, 0)]
        while heap and met < reach:
            _, i, j = heapq.heappop(heap)
            cell = order1[i] * width + order2[j]
            if sizes[cell]:
                met += int(sizes[cell])
                out.append(cell)
            if j + 1 < len(d2):
                heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(d1):
                heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
        return out

    def needed(self, x: np.ndarray, cell: int) -> int:
        """How many entries a query must have met, so that it has visited a cell."""
        lack1, lack2 = self.lacks(x[None])
        order = np.argsort((lack1[0][:, None] + lack2[0]).ravel(), kind="stable")
        return int(self.sizes[order[: int(np.flatnonzero(order == cell)[0])]].sum()) + 1


def best_rows(queries: np.ndarray, query_ids: np.ndarray, entries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of queries, ids, scores) of the k largest inner products of each query, ties to smaller ids. ``scores`` are the
    products as a matrix, -inf where an entry doesn't count; those near the k-th are computed again, each by itself, so that
    equal vectors have equal scores wherever they stand."""
    scores[query_ids[:, None] == ids] = -np.inf
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    slack = _NEAR * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0)))
    rows, cols = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
    exact = np.concatenate([np.zeros(0), *((queries[rows[i : i + _PAIRS]] * entries[cols[i : i + _PAIRS]]).sum(axis=1) for i in range(0, len(rows), _PAIRS))])
    order = np.lexsort((ids[cols], -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    start = np.searchsorted(rows, np.arange(len(queries)))
    keep = np.arange(len(rows)) - start[rows] < k
    rows, cols, exact = rows[keep], cols[keep], exact[keep]
    yield rows, ids[cols], exact


def _dimensions(vectors: DataFrame, col: str) -> int | None:
    """The length that most vectors have, the smaller of equally frequent ones."""
    most = vectors.filter(F.size(col) > 0).groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return most.d if most else None


def _usable(vectors: DataFrame, col: str, id_col: str, d: int) -> DataFrame:
    v = F.col(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) == d) & finite & F.exists(v, lambda x: x != 0))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _exact(vectors: DataFrame, asked: np.ndarray, asked_ids: np.ndarray, k: int) -> DataFrame:
    """query_id, cell of the k nearest of each of some (bounded) queries among all vectors."""
    d = asked.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column("v"), d), batch.column("vec_id").to_numpy()
            cell = batch.column("cell").to_numpy()
            for at in range(0, len(x), SHARD):
                part = slice(at, at + SHARD)
                scores = asked @ x[part].T
                scores[asked_ids[:, None] == ids[part]] = -np.inf
                n = min(k, scores.shape[1])
                cols = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                rows = np.repeat(np.arange(len(asked)), n)
                cols = cols.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(cell[part][cols]), pa.array(scores[rows, cols])], names=["q", "cell", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    return vectors.mapInArrow(best, "q int, cell int, score double").withColumn("r", F.row_number().over(order)).filter((F.col("r") <= k) & (F.col("score") > float("-inf")))


def build(vectors: DataFrame, queries: DataFrame, d: int, n: int, k: int, recall: float, shard: int) -> tuple[MultiIndex, DataFrame, int]:
    """The index, its entries (vec_id, v, cell, nth) and the number of entries that a query has to meet."""
    some = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).toPandas()
    sample = np.stack(some["v"].to_numpy())
    per_half = int(min(CENTROIDS, max(2, round(2 * n**0.25))))
    index = MultiIndex(centroids(sample[:, : d // 2], per_half), centroids(sample[:, d // 2 :], per_half))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() * 7919  # parts of a hot cell don't all start at its first shard
        for batch in batches:
            cell = index.cells(_matrix(batch.column("v"), d)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.arange(nth, nth + len(cell)))], names=["vec_id", "v", "cell", "nth"])
            nth += len(cell)

    entries = save(vectors.mapInArrow(assign, "vec_id long, v array<double>, cell int, nth long"), "multi-index")
    sizes = np.zeros(index.n_cells, np.int64)
    for r in entries.groupBy("cell").count().toLocalIterator():  # at most CENTROIDS squared
        sizes[r.cell] = r["count"]
    index.fill(sizes, shard)
    asked = queries.orderBy(F.xxhash64("vec_id")).limit(ASKED).toPandas()
    reach = n
    if len(asked):
        x = np.stack(asked["v"].to_numpy())
        found = _exact(entries, x, asked["vec_id"].to_numpy(), k).select("q", "cell").collect()  # at most ASKED * k
        needed = sorted(index.needed(x[r.q], r.cell) for r in found)
        reach = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else n
    return index, entries, reach


def search(vectors: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL, shard: int = SHARD, col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector whose id is divisible by ``every``.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    those without an id. Of queries that share an id the one with the smallest vector asks; rows that share the query's id are
    no candidates. Other repeated rows are candidates each by itself. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    with rounds(spark):
        d = _dimensions(vectors, col)
        usable = _usable(vectors, col, id_col, d or 0)
        n = usable.count() if d else 0
        if not n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        queries = save(usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "multi-index-queries")
        index, entries, reach = build(usable, queries, d, n, k, recall, shard)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, nth = batch.column("cell").to_numpy(), batch.column("nth").to_numpy()
                at = index.base[cell] + nth % index.parts[cell]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32)), batch.column("cell"))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(cell), np.int32)), batch.column("vec_id"), batch.column("v"), cells], names=["shard", "kind", "vec_id", "v", "cells"])

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, rows, shards, cells = _matrix(batch.column("v"), d), [], [], []
                lack1, lack2 = index.lacks(x)
                for q in range(len(x)):
                    by: dict[int, list[int]] = {}
                    for c in index.visited(lack1[q], lack2[q], reach):
                        for s in range(int(index.base[c]), int(index.base[c] + index.parts[c])):
                            by.setdefault(s, []).append(c)
                    rows += [q] * len(by)
                    shards += by
                    cells += by.values()
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int64()), pa.array(np.ones(len(rows), np.int32)), batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(cells, pa.list_(pa.int32()))],
                    names=["shard", "kind", "vec_id", "v", "cells"],
                )

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at, block = [], None, None

            def answer(rows: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
                q, q_ids = _matrix(rows.column("v"), d), rows.column("vec_id").to_numpy()
                lists = rows.column("cells")
                asker, asks = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
                scores = np.full((len(q), len(x)), -np.inf)
                by = np.argsort(asks, kind="stable")
                edges = np.flatnonzero(np.diff(asks[by], prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(by)]):
                    lo, hi = np.searchsorted(cell, asks[by[a]]), np.searchsorted(cell, asks[by[a]], side="right")
                    if lo < hi:
                        who = asker[by[a:b]]
                        scores[who, lo:hi] = q[who] @ x[lo:hi].T
                for row, near, score in best_rows(q, q_ids, x, ids, scores, k):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

            for batch in batches:
                shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
                edges = np.flatnonzero((np.diff(shards, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0))
                for a, b in zip(edges, [*edges[1:], len(shards)]):
                    rows = batch.slice(a, b - a)
                    if shards[a] != at:
                        held, at, block = [], shards[a], None
                    if kinds[a] == 0:
                        held.append((_matrix(rows.column("v"), d), rows.column("vec_id").to_numpy(), rows.column("cells").flatten().to_numpy()))
                        continue
                    if block is None and held:
                        x, ids, cell = (np.concatenate(y) for y in zip(*held))
                        order = np.argsort(cell, kind="stable")
                        held, block = [], (x[order], ids[order], cell[order])
                    if block is not None:
                        for part in range(0, rows.num_rows, 256):
                            yield from answer(rows.slice(part, 256), *block)

        rows = "shard long, kind int, vec_id long, v array<double>, cells array<int>"
        together = entries.mapInArrow(placed, rows).unionByName(queries.mapInArrow(sent, rows))
        found = together.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(ranked, _FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return save(out, "neighbours", lasting=True)
