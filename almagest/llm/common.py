"""Helpers shared by the operators of this package.

Conventions
-----------
* A document row is identified by ``doc_key`` (its id, nulls mapped to a
  sentinel) together with ``text_key`` (a hash of its text), so repeated ids
  with different texts stay apart and repeated rows share one result.
* Intermediate tables are Parquet files below the folder named by
  ``spark.checkpoint.dir``; every executor can read them, so a lost executor
  never takes the only copy with it.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.session import ensure_checkpoint_dir

#: Stands for a null doc_id where rows are matched by id.
NULL_ID = -(2**63)
#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = (32, 9, 10, 11, 12, 13)
#: The same as a pattern: one word.
WORD = r"[^\x20\x09-\x0D]+"


def doc_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def text_key(col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("")), F.col(col).isNull())


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two key columns of every row; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"),
                       doc_key().alias("k1"), text_key().alias("k2"))


def as_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct ``row``, so that helper columns beside
    it cannot have their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/almagest-llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession):
    """Queries that run meanwhile delete their shuffle files when they end."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and
    the files are there for every executor; shuffles on the way to it go."""
    path = shared_path(spark, name)
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.shared_path = path
    return back


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in frames:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What the tasks of one operator keep in a worker from one to the next."""
    return _KEPT.setdefault(owner, {})


def let_go(owner: str | None) -> None:
    """Forget what tasks of other operators keep in this worker."""
    for other in [o for o in _KEPT if o != owner]:
        del _KEPT[other]


def give_back() -> None:
    """Return free memory to the system; Arrow's pool and the C library hold
    what the largest batch took for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch
        del batch
        give_back()


def lean(run: Callable, owner: str | None = None) -> Callable:
    """run, a function for mapInArrow, in a worker that is free of what other
    operators than ``owner`` keep there; what a batch took goes back."""
    def task(batches):
        let_go(owner)
        try:
            yield from run(_in_turn(batches))
        finally:
            give_back()
    return task


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column as numpy arrays; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each (a longer row stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray,
               inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word, or of every run of inside bytes; none
    crosses rows."""
    inside = ~_IS_SPACE[data] if inside is None else inside
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tail = offsets[1:][offsets[1:] > 0] - 1
    last[tail] = inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], from one polynomial prefix sum."""
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix64(h)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str],
                 rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by keys: a group that is
    still open at a batch's end waits for the next one. A table holds at most
    ``rows`` rows, or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            table = pa.Table.from_batches(held)
            if table.num_rows >= rows:
                cuts = group_starts(table, keys)
                yield from _tables(table, cuts, rows)
                held = table.slice(cuts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield from _tables(table, [*group_starts(table, keys), table.num_rows], rows)


def group_starts(table: pa.Table, keys: list[str]) -> list[int]:
    """The rows at which the groups of a sorted table begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        col = table.column(k)
        if table.num_rows > 1:
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, table.num_rows - 1)).combine_chunks().to_numpy(
                zero_copy_only=False)
    return np.flatnonzero(new).tolist()


def _tables(table: pa.Table, cuts: list[int], rows: int) -> Iterator[pa.Table]:
    """The table up to the last cut, in parts that end at cuts."""
    begin = 0
    for here, after in zip(cuts, [*cuts[1:], None], strict=True):
        if here > begin and (after is None or after - begin > rows):
            yield table.slice(begin, here - begin)
            begin = here
