"""Nearest neighbours by cosine as a block matrix join.

Query and candidate rows are dealt by a hash of their id into a grid of tiles
(queries x candidates) of bounded size; a query row goes to each tile of its
grid row, a candidate to each of its grid column. A task reads a tile's
queries, then streams its candidates block by block:

1. Unit vectors are quantised to int8 with a scale for each row; the residual
   norms bound the error: |cos - s_x s_y <q_x, q_y>| <= e_x + (1 + e_x) e_y.
2. The int8 products of a block are one matrix product (in float32, which is
   exact for sums below 2^24). A pair survives if its upper bound reaches the
   k-th best score that its query is sure of.
3. Survivors are recomputed in double precision on the original vectors and
   pushed onto the query's heap of k.

Tiles' heaps meet in a top-k of each query. Nothing is approximate in the
result: the bounds discard only pairs that cannot be among the nearest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.llm.common import parallelism

K = 5
QUERY_TILE = 32_768
CANDIDATE_TILE = 262_144
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: Above the rounding of float32 products of int8 sums and their scales.
SLACK = 1e-5


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    return F.expr(f"coalesce(size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) "
                  f"AND abs(x) < double('Infinity')) AND exists({vector}, x -> x <> 0), false)")


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales and the norms of what they miss."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1))


def levelled(rows: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to
    0.5..1: norms neither under- nor overflow, and cosines stay as they are."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed component by component in double."""
    dot, xx, yy = (np.zeros(len(x)) for _ in range(3))
    for d in range(x.shape[1]):
        a, b = x[:, d], y[:, d]
        dot += a * b
        xx += a * a
        yy += b * b
    return np.clip(dot / np.sqrt(xx * yy), -1.0, 1.0)


class Tile:
    """The queries of one tile and their heaps."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        rows = levelled(rows)
        self.ids, self.rows, self.k = ids, rows, k
        unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
        self.q, self.scale, self.miss = quantised(unit)
        self.sure = np.full(len(ids), -np.inf)  # the k-th best score so far
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        rows = levelled(rows)
        unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
        c, scale, miss = quantised(unit)
        c = c.astype(np.float32).T
        for a in range(0, len(self.ids), QUERY_BLOCK):
            b = min(a + QUERY_BLOCK, len(self.ids))
            near = (self.q[a:b].astype(np.float32) @ c) * (self.scale[a:b, None] * scale[None, :])
            bound = self.miss[a:b, None] + (1 + self.miss[a:b, None]) * miss[None, :] + SLACK
            own = self.ids[a:b, None] == ids[None, :]
            low = np.where(own, -np.inf, near - bound)
            sure = self.sure[a:b]
            open_heaps = np.flatnonzero(np.isinf(sure))
            if len(open_heaps) and len(ids) > self.k:
                sure = sure.copy()
                sure[open_heaps] = np.partition(low[open_heaps], -self.k, axis=1)[:, -self.k]
            i, j = np.nonzero((near + bound >= sure[:, None]) & ~own)
            for p in range(0, len(i), 1 << 16):
                self._push(i[p:p + (1 << 16)] + a, j[p:p + (1 << 16)], ids, rows)

    def _push(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for q, s, v in zip(i.tolist(), cosines(self.rows[i], rows[j]).tolist(), ids[j].tolist(), strict=True):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -v))
            elif (s, -v) > heap[0]:
                heapq.heapreplace(heap, (s, -v))
        for q in np.unique(i).tolist():
            if len(self.heaps[q]) == self.k:
                self.sure[q] = self.heaps[q][0][0]

    def found(self) -> pa.RecordBatch:
        rows = [(q, -v, s) for q, heap in zip(self.ids.tolist(), self.heaps, strict=True) for s, v in heap]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                           pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _tiles(k: int):
    def run(batches):
        cell, tile, queries = None, None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("dim", "qb", "cb")], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if cell != (now := tuple(key[a])):
                    if tile is not None:
                        yield tile.found()
                    cell, tile, queries = now, None, []
                part = batch.slice(a, b - a)
                ids = part.column("vec_id").to_numpy()
                rows = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                asks = ~part.column("candidate").to_numpy(zero_copy_only=False)  # queries come first
                if asks.any():
                    queries.append((ids[asks], rows[asks]))
                if asks.all():
                    continue
                if tile is None and queries:
                    tile = Tile(*map(np.concatenate, zip(*queries, strict=True)), k)
                for p in range(0, b - a if tile else 0, CANDIDATE_BLOCK):
                    take = ~asks[p:p + CANDIDATE_BLOCK]
                    if take.any():
                        tile.meet(ids[p:p + CANDIDATE_BLOCK][take], rows[p:p + CANDIDATE_BLOCK][take])
        if tile is not None:
            yield tile.found()
    return run


def nearest(spark: SparkSession, candidates: DataFrame, queries: DataFrame, k: int = K,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest
    cosine for each query, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without id; vectors meet those of their own length; a
    candidate with the query's id is its own row. Of rows that repeat a query's
    id the least vector asks; candidates that repeat an id each count. Fewer
    candidates than k give fewer rows, empty tables none."""
    rows = lambda df: (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
                       .filter(F.col("vec_id").isNotNull() & usable("vector")).withColumn("dim", F.size("vector")))
    asked = rows(queries).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    there = rows(candidates)
    n_queries, n_rows = asked.count(), there.count()
    across, down = max(1, -(-n_queries // QUERY_TILE)), max(1, -(-n_rows // CANDIDATE_TILE))
    down = max(down, -(-parallelism(spark) // across))  # at least a tile for each task
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["dim", "qb", "cb", "candidate", "vec_id", "vector"]
    tiles = (asked.withColumns({"qb": dealt(across, 1), "candidate": F.lit(False)}).withColumn("cb", every(down)).select(cols)
             .unionByName(there.withColumns({"cb": dealt(down, 2), "candidate": F.lit(True)})
                          .withColumn("qb", every(across)).select(cols)))
    found = (tiles.repartition(across * down, "dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb", "candidate")
             .mapInArrow(_tiles(k), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
