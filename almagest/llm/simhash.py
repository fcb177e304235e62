"""SimHash near-duplicate detection with pivot distance tables.

Method
------
1. Every text gets a 64-bit fingerprint: words are lower-cased (A-Z), joined
   in windows of ``shingle_words``, hashed by XXH64 (seed 42), and a bit is 1
   if it is set in over half of the hashes.
2. Equal fingerprints are one class; only classes go on, so exact copies
   never meet in pairs.
3. Each class gets its Hamming distances to a table of reference fingerprints
   (pivots). By the triangle inequality, fingerprints within k bits differ by
   at most k in every coordinate. Distances to random pivots bunch around 32
   and cannot key a join; so the table also has zero and the 32 references
   with one pair of bits set, whose coordinates give the count of ones in each
   two-bit field. Within ``max_bits`` differing bits, at most that many fields
   change, so of ``max_bits + 3`` runs of fields at least three are untouched:
   classes are dealt out by every choice of three runs.
4. In a bucket, pairs whose largest coordinate difference exceeds
   ``max_bits`` are discarded, survivors are verified by their Hamming
   distance, and a spanning forest of the verified links is returned, which
   keeps every connection without all pairs of a group.
5. Components come from large-star / small-star rounds over the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.llm.common import as_row, chunks, doc_key, keyed, lean, parallelism, text_key, utf8, whole_groups, written
from almagest.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
#: Random reference fingerprints of the distance table.
PIVOTS = np.random.default_rng(20240607).integers(0, 2**64, 16, dtype=np.uint64)
FIELDS = 32
#: Buckets up to this size are compared by shifts, larger ones by a search.
SMALL_BUCKET = 48


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of every k-word shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) < k:
        return [xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = map(slice, starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    return list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(HASH_SEED)))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            out = np.zeros(batch.num_rows, np.uint64)
            for i, j in chunks(off, 1 << 21):
                raw = data[off[i]:off[j]].tobytes()
                for r in range(i, j):
                    hashes = shingle_hashes(raw[off[r] - off[i]:off[r + 1] - off[i]], k)
                    out[r] = fingerprint(np.array(hashes, np.uint64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(out.view(np.int64))],
                names=["doc_id", "k1", "k2", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row keys and fp (long) of every row; a null text counts as empty."""
    return keyed(docs).mapInArrow(lean(_fingerprints(shingle_words)), "doc_id long, k1 long, k2 long, fp long")


def _field_ones(j: int):
    """Ones in the two-bit field j, from the distances to zero and to the
    reference with just that field set."""
    mask = 3 << (2 * j)
    mask = mask - 2**64 if mask >= 2**63 else mask
    return ((F.bit_count("fp") - F.bit_count(F.col("fp").bitwiseXOR(F.lit(mask))) + 2) / 2).cast("long")


def _bucket_keys(max_bits: int):
    """One key for each choice of three of the max_bits + 3 runs of fields."""
    runs = [list(r) for r in np.array_split(np.arange(FIELDS), max_bits + 3)]
    keys = []
    for n, chosen in enumerate(combinations(range(len(runs)), 3)):
        code = F.lit(0).cast("long")
        for j in (int(f) for r in chosen for f in runs[r]):
            code = code * 3 + F.col("ones")[j]
        keys.append(F.struct(F.lit(n).alias("choice"), code.alias("key")))
    return F.array(*keys)


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _search(fp: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one large bucket: a breadth-first
    search in which every class is compared once with those not yet reached,
    first by the pivot table, then by Hamming distance."""
    order = np.argsort(table[:, 0], kind="stable")
    left = order  # not yet reached, by distance to the first pivot
    links = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            d0 = table[left, 0]
            lo, hi = np.searchsorted(d0, [int(table[x, 0]) - max_bits, int(table[x, 0]) + max_bits + 1])
            near = left[lo:hi]
            near = near[np.abs(table[near] - table[x]).max(axis=1, initial=0) <= max_bits]
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= max_bits]
            if len(near):
                links += [(x, int(y)) for y in near]
                queue += near.tolist()
                left = left[~np.isin(left, near)]
    return links


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["choice", "key"]):
            key = group.column("key").to_numpy()
            choice = group.column("choice").to_numpy()
            fp = group.column("fp").to_numpy().view(np.uint64)
            same = (key[1:] == key[:-1]) & (choice[1:] == choice[:-1])
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(begin, len(fp)))
            of = np.repeat(np.arange(len(begin)), size)
            keep = size[of] > 1
            fp, of = fp[keep], of[keep]
            table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
            small = np.flatnonzero(size[of] <= SMALL_BUCKET)
            found = []
            for s in range(1, SMALL_BUCKET):
                i = small[:-s] if s < len(small) else small[:0]
                j = small[s:][:len(i)]
                ok = of[i] == of[j]
                if not ok.any():
                    break
                i, j = i[ok], j[ok]
                ok = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= max_bits
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
                found.append(np.stack([i[ok], j[ok]], axis=1))
            pairs = _forest(len(fp), np.concatenate(found)) if found else []
            for g in np.flatnonzero(size > SMALL_BUCKET):
                rows = np.flatnonzero(of == g)
                pairs += [(int(rows[a]), int(rows[b])) for a, b in _search(fp[rows], table[rows], max_bits)]
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))],
                                                 names=["a", "b"])
    return run


def links(spark: SparkSession, classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that span the components of fingerprints (column fp, each
    once) within max_bits of each other."""
    n = parallelism(spark)
    dealt = (classes.select("fp", F.array(*[_field_ones(j) for j in range(FIELDS)]).alias("ones"))
             .select("fp", F.explode(_bucket_keys(max_bits)).alias("at"))
             .select("at.choice", "at.key", "fp"))
    return (dealt.repartition(n, "choice", "key").sortWithinPartitions("choice", "key")
            .mapInArrow(lean(_links(max_bits)), "a long, b long"))


def classified(spark: SparkSession, docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
               max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, k1, k2, fp and component (least fingerprint) of every row, as a
    written table."""
    marks = written(spark, fingerprints(docs, shingle_words), "fingerprints")
    classes = marks.select("fp").distinct()
    forest = written(spark, links(spark, classes, max_bits).distinct(), "links")
    comp = components(spark, forest, "a", "b").withColumnRenamed("node", "fp")
    # a class without links is its own component
    return marks.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row.

    component_id is the least doc_id reachable over links of at most max_bits
    bits, the row's own included. A null or word-less text has fingerprint
    zero and is linked like any other; null ids are ignored in the minimum;
    repeated rows each get their result; an empty table gives an empty one."""
    marks = classified(spark, docs, shingle_words, max_bits)
    least = marks.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return marks.join(least, "component").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, one for each component: the one with the least
    doc_id (null last, then by text where an id repeats; one of whole rows
    that repeat). Columns, whatever their names, are kept as they are."""
    marks = classified(spark, docs, shingle_words, max_bits)
    first = marks.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "k1", "k2")).alias("r")).select("r.k1", "r.k2")
    own = docs.select(as_row(docs), doc_key().alias("k1"), text_key().alias("k2"))
    # the same id and text in more rows than one: the join has them side by side
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    return own.join(first, ["k1", "k2"], "left_semi").withColumn("nth", nth).filter("nth = 1").select("row.*")
