"""Hard negatives by a secondary-sort shuffle.

Pair scores travel as packed keys (anchor, score falling, kind, id) whose byte
order is the order of reading. One shuffle deals them by anchor and sorts them
inside each partition; an iterator then reads the sorted stream once. A
positive opens a window of negative scores, a negative is emitted for every
open window that it falls into, and a window closes when it has its number.
The state is one anchor's few windows, never the anchor's pairs.

What goes into the shuffle is combined on the map side first. Anchors and
rows meet in tiles of bounded size (a row goes to each tile of its grid
column, an anchor to each of its grid row), where scores are blocked integer
matrix products:

1. a tile sends each anchor's first positives; the first of all tiles are the
   anchor's positives;
2. a tile, knowing these, sends for each window its first negatives.

A pair that is not among a tile's first cannot be among the first of all, so
nothing is lost, and an anchor's part of the shuffle does not grow with the
rows of its label. Work is anchors x rows in products, as asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.llm.common import parallelism, written

POSITIVES, NEGATIVES = 5, 3
#: Components become floor(SCALE * x).
SCALE = 256
#: A negative's score lies within these hundredths of the positive's.
LEAST, MOST = 50, 95
ANCHOR_TILE, ROW_TILE = 8_192, 262_144
ANCHOR_BLOCK, ROW_BLOCK = 512, 4096
_LONG = 2**63 - 1
_FOUND = "anchor_id long, id long, score long"
_POSITIVE, _NEGATIVE = 0, 1


def usable(vector: str) -> Column:
    """Not null, every component there and finite."""
    return F.expr(f"coalesce(forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')), false)")


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner product of every row of x with every row of y, exact;
    what leaves a long stays at its end."""
    largest = lambda a: max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))
    bound = largest(x) * largest(y) * max(1, x.shape[1])
    if bound < 2**24:
        return (x.astype(np.float32) @ y.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if bound <= _LONG:
        return x @ y.T
    return np.clip(x.astype(object) @ y.astype(object).T, -_LONG, _LONG).astype(np.int64)


def bounds(score: int) -> tuple[int, int]:
    """Least and largest score of a negative for a positive's score."""
    return -(-LEAST * score // 100), MOST * score // 100


class First:
    """The first few (score falling, id rising) of many groups, fed in blocks."""

    def __init__(self, groups: int, few: int):
        self.few = few
        self.last = np.full(groups, -_LONG - 1)  # the score that a group's next must reach
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def reach(self, group: np.ndarray, score: np.ndarray) -> None:
        """Each group is known to have its number of rows with this score or more."""
        self.last[group] = np.maximum(self.last[group], score)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((group, score, ids))
        self.size += len(group)
        if self.size > 1 << 18:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        group, score, ids = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        begin = np.searchsorted(group, group, "left")
        place = np.arange(len(group)) - begin
        full = place == self.few - 1
        self.reach(group[full], score[full])
        keep = place < self.few
        self.held = [(group[keep], score[keep], ids[keep])]
        self.size = int(keep.sum())
        return self.held[0]


class PositiveTile:
    """Each anchor's first rows of its own label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, _: list):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.first = First(len(ids), POSITIVES)

    def meet(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        for label in np.unique(self.labels):
            there = np.flatnonzero(labels == label)
            mine = np.flatnonzero(self.labels == label)
            for a in range(0, len(mine) if len(there) else 0, ANCHOR_BLOCK):
                part = mine[a:a + ANCHOR_BLOCK]
                score = products(self.rows[part], rows[there])
                own = self.ids[part][:, None] == ids[there][None, :]
                if len(there) > POSITIVES:
                    self.first.reach(part, np.partition(np.where(own, -_LONG - 1, score), -POSITIVES, axis=1)[:, -POSITIVES])
                i, j = np.nonzero((score >= self.first.last[part][:, None]) & ~own)
                self.first.add(part[i], score[i, j], ids[there][j])

    def found(self) -> pa.RecordBatch:
        group, score, ids = self.first.cut()
        return _batch(self.ids[group], ids, score)


class NegativeTile:
    """For each positive of an anchor, the first rows of other labels whose
    scores lie in its window."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, scores: list[list[int]]):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.low, self.high = np.full((len(ids), POSITIVES), 1), np.zeros((len(ids), POSITIVES), np.int64)
        for i, of in enumerate(scores):
            for w, score in enumerate(sorted(set(of), reverse=True)):
                self.low[i, w], self.high[i, w] = bounds(score)
        self.first = First(len(ids) * POSITIVES, NEGATIVES)

    def meet(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        for a in range(0, len(self.ids), ANCHOR_BLOCK):
            part = np.arange(a, min(a + ANCHOR_BLOCK, len(self.ids)))
            score = products(self.rows[part], rows)
            other = self.labels[part][:, None] != labels[None, :]
            other &= self.ids[part][:, None] != ids[None, :]
            for w in range(POSITIVES):
                low, high = self.low[part, w], self.high[part, w]
                if (low > high).all():
                    continue
                group = part * POSITIVES + w
                fit = other & (score <= high[:, None])
                fit &= score >= np.maximum(low, self.first.last[group])[:, None]
                i, j = np.nonzero(fit)
                if len(i) > len(part) * NEGATIVES:
                    # the best of this block alone may already be enough
                    best = np.full(len(part), -_LONG - 1)
                    order = np.lexsort((-score[i, j], i))
                    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
                    best[i[order][place == NEGATIVES - 1]] = score[i, j][order][place == NEGATIVES - 1]
                    self.first.reach(group, best)
                    near = score[i, j] >= best[i]
                    i, j = i[near], j[near]
                self.first.add(group[i], score[i, j], ids[j])

    def found(self) -> pa.RecordBatch:
        group, score, ids = self.first.cut()
        # one key for a negative that several windows want
        kept = np.unique(np.stack([group // POSITIVES, score, ids, _nth(group, score, ids)], axis=1), axis=0)
        return _batch(self.ids[kept[:, 0]], kept[:, 2], kept[:, 1])


def _nth(group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For sorted rows: the how manieth this is of equal (group, score, id),
    so that repeated rows stay as many as they are."""
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
    at = np.arange(len(group))
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at


def _batch(anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchor, ids, score)], names=["anchor_id", "id", "score"])


def _tiles(kind: type):
    """Read cells sorted by (dim, ab, rb, row): a cell's anchors, then its
    rows as a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tile, anchors = None, None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("dim", "ab", "rb")], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if cell != (now := tuple(key[a])):
                    if tile is not None:
                        yield tile.found()
                    cell, tile, anchors = now, None, []
                part = batch.slice(a, b - a)
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                rows = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), now[0])
                is_row = part.column("row").to_numpy(zero_copy_only=False)
                asks = np.flatnonzero(~is_row)
                if len(asks):
                    anchors.append((ids[asks], labels[asks], rows[asks], part.column("scores").take(pa.array(asks)).to_pylist()))
                if tile is None and anchors and is_row.any():
                    i, l, r, s = zip(*anchors, strict=True)
                    tile = kind(np.concatenate(i), np.concatenate(l), np.concatenate(r), sum(s, []))
                for p in range(len(asks), b - a if tile else 0, ROW_BLOCK):
                    tile.meet(ids[p:p + ROW_BLOCK], labels[p:p + ROW_BLOCK], rows[p:p + ROW_BLOCK])
        if tile is not None:
            yield tile.found()
    return run


def _met(spark: SparkSession, anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], kind: type) -> DataFrame:
    across, down = max(1, -(-sizes[0] // ANCHOR_TILE)), max(1, -(-sizes[1] // ROW_TILE))
    down = max(down, -(-parallelism(spark) // across))  # at least a tile for each task
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["dim", "ab", "rb", "row", "id", "label", "vector", "scores"]
    tiles = (anchors.withColumns({"ab": dealt(across, 1), "row": F.lit(False)}).withColumn("rb", every(down)).select(cols)
             .unionByName(rows.withColumns({"rb": dealt(down, 2), "row": F.lit(True), "scores": F.lit(None).cast("array<long>")})
                          .withColumn("ab", every(across)).select(cols)))
    return (tiles.repartition(across * down, "dim", "ab", "rb").sortWithinPartitions("dim", "ab", "rb", "row")
            .mapInArrow(_tiles(kind), _FOUND))


def packed(anchor: Column, score: Column, kind: int, ident: Column) -> Column:
    """25 bytes in the order of (anchor, score falling, kind, id): each number
    big-endian with its sign bit turned, the score's bits all turned."""
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    turned = lambda c: c.bitwiseXOR(F.lit(-2**63))
    return F.unhex(F.concat(hexed(turned(anchor)), hexed(F.bitwise_not(turned(score))), F.lit(f"{kind:02x}"), hexed(turned(ident))))


_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])


def unpacked(keys: pa.Array) -> tuple[list[int], ...]:
    """Anchors, scores, kinds and ids of an array of packed keys."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), _KEY)
    signed = lambda a: (a.astype(np.uint64) ^ np.uint64(2**63)).view(np.int64).tolist()
    return signed(raw["anchor"]), signed(~raw["score"].astype(np.uint64)), raw["kind"].tolist(), signed(raw["id"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted keys once; holds the open windows of one anchor."""
    here, windows = None, []
    for batch in batches:
        out = []
        for anchor, score, kind, ident in zip(*unpacked(batch.column("key")), strict=True):
            if anchor != here:
                here, windows = anchor, []
            if kind == _POSITIVE:
                windows.append([ident, score, *bounds(score), 0])
                continue
            for w in windows:
                if w[2] <= score <= w[3]:
                    w[4] += 1
                    out.append((anchor, w[0], w[4], ident, w[1], score))
            # done: full, or all that follows scores less
            windows = [w for w in windows if w[4] < NEGATIVES and w[2] <= score]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
            names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def mine(spark: SparkSession, rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for every anchor and each of its first POSITIVES rows of
    the same label, the first NEGATIVES rows of other labels whose score is
    LEAST to MOST hundredths of the positive's. Scores are integer inner
    products with the anchor of components floor(SCALE * x); higher ones come
    first, then smaller ids.

    is_anchor is a condition on the columns of rows. Rows whose id, label or
    vector is null, or whose vector holds null or non-finite components, take
    no part; vectors meet those of their own length, empty ones score 0.
    Components and scores beyond a long stay at its end. A row with the
    anchor's id is never its partner; of anchors that repeat an id the least
    (label, vector) asks, and other rows that repeat an id each count. A
    positive whose score is negative has an empty window. Other columns are
    ignored; an empty table gives none."""
    name = {"id": F.col(id_col).cast("long"), "label": F.col(label_col).cast("long"), "vector": F.col(vector_col)}
    there = (rows.select(is_anchor.alias("asks"), *(c.alias(n) for n, c in name.items()))
             .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector"))
             .withColumn("vector", F.expr(f"transform(vector, x -> cast(floor({SCALE} * cast(x AS double)) AS long))"))
             .withColumn("dim", F.size("vector")))
    anchors = (there.filter("asks").groupBy("id").agg(F.min(F.struct("label", "vector", "dim")).alias("a"))
               .select("id", "a.label", "a.vector", "a.dim"))
    there = there.drop("asks")
    sizes = anchors.count(), there.count()

    near = _met(spark, anchors.withColumn("scores", F.lit(None).cast("array<long>")), there, sizes, PositiveTile)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id"))
    positives = written(spark, near.withColumn("place", place).filter(F.col("place") <= POSITIVES).drop("place"), "positives")
    windows = positives.filter("score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("score").alias("scores"))
    negatives = _met(spark, anchors.join(windows, "id"), there, sizes, NegativeTile)

    key = lambda df, kind: df.select("anchor_id", packed(F.col("anchor_id"), F.col("score"), kind, F.col("id")).alias("key"))
    return (key(positives, _POSITIVE).unionByName(key(negatives, _NEGATIVE))
            .repartition(parallelism(spark), "anchor_id").sortWithinPartitions("key").select("key")
            .mapInArrow(_windows, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
