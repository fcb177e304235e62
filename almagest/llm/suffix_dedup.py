"""Exact substring de-duplication over a sparse suffix array.

Removes every byte covered by a ``window``-byte string that also starts at
another place of the corpus (same document included), judged on the input.

Method
------
1. Sync points. In every window the leftmost least hash of an 8-byte gram,
   taken over the positions that leave room for ``PREFIX`` bytes, is the
   window's anchor. The choice depends on the window's bytes alone, so equal
   windows have equal anchors at equal offsets: it is enough to sort the
   suffixes that start in blocks around anchors whose prefix occurs twice.
   Consecutive windows with one anchor form a block.
2. Anchors are counted by a hash of their PREFIX bytes (pre-aggregated before
   the shuffle). One occurrence: nothing in its block repeats. Equal blocks
   throughout: the whole blocks repeat. The rest ("mixed") goes on, once for
   each distinct block.
3. Suffix buckets. Distinct blocks are range-partitioned by the leading bytes
   of their anchor's suffix: Spark's range exchange samples the splitters. Each
   bucket is read in order; blocks of one anchor prefix stay together, also
   across read boundaries, where the open run of equal leading bytes waits for
   its next part. All suffixes that start at a block's windows are sorted by
   multikey quicksort on 40-byte tokens (ordered by hash, the shared prefix
   skipped), and neighbours that agree byte for byte over the whole window mark
   each other as repeated.
4. A prefix with more than ``HOT_BLOCKS`` distinct blocks (one passage in very
   many surroundings) would be an unbounded run of one bucket. Its windows are
   dealt out one by one instead, by a 128-bit digest, and counted with
   pre-aggregation.
5. Spans of each document are merged, and the bytes left are hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm.common import (NULL_ID, as_row, chunks, doc_key, drop, keyed, lean, mix64, parallelism, span_hashes, text_key, utf8,
                                 whole_groups, written)

WINDOW = 400
PREFIX = 160
HOT_BLOCKS = 4096
#: Bytes of a text that are handled at once; longer texts go in overlapping parts.
PART = 1 << 19
#: Windows that are sorted at once, blocks whose bytes are cut out at once, and documents that are cut at once.
SORTED = 1 << 18
BLOCKS = 4_000
DOCUMENTS = 1_000
_POS = np.uint64((1 << 24) - 1)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i:i+w]) for every i, by doubling."""
    out, span = v, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:span - w], out[w - span:]) if span < w else out


def anchor_blocks(data: np.ndarray, offsets: np.ndarray, window: int, prefix: int):
    """(row, first window, last window, anchor) of every block of the texts,
    positions from each text's start. data holds fewer than 2^24 bytes."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none
    grams = np.ascontiguousarray(np.lib.stride_tricks.as_strided(
        np.concatenate([data, np.zeros(8, np.uint8)]), shape=(n, 8), strides=(1, 1))).view(np.uint64).ravel()
    keys = (mix64(grams) & ~_POS) | np.arange(n, dtype=np.uint64)
    anchor = (_sliding_min(keys, window - prefix + 1) & _POS).astype(np.int64)[:n - window + 1]
    rows = np.searchsorted(offsets, np.arange(len(anchor)), "right") - 1
    inside = np.arange(len(anchor)) + window <= offsets[rows + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none
    a, r = anchor[at], rows[at]
    first = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (r[1:] != r[:-1])) + 1])
    last = np.append(first[1:], len(at)) - 1
    base = offsets[r[first]]
    return r[first], at[first] - base, at[last] - base, a[first] - base


def _pieces(data: np.ndarray, off: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset of the piece in that row's text, bytes, offsets):
    chunks of rows; a text beyond PART in parts that share window - 1 bytes."""
    for i, j in chunks(off, PART):
        if off[j] - off[i] <= 2 * PART:
            yield i, 0, data[off[i]:off[j]], off[i:j + 1] - off[i]
        else:
            for s in range(0, int(off[j] - off[i]) - window + 1, PART):
                part = data[off[i] + s:min(off[i] + s + PART + window - 1, off[j])]
                yield i, s, part, np.array([0, len(part)])


def _anchors(window: int, prefix: int):
    """A row for each block: document keys; pack = first window, windows - 1
    and the anchor's offset in the block; prefix and block hashes."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            data, off = utf8(batch.column("text"))
            for i, shift, part, poff in _pieces(data, off, window):
                row, p1, p2, a = anchor_blocks(part, poff, window, prefix)
                if not len(row):
                    continue
                raw, base = part.tobytes(), poff[row]
                x, y, z = (base + a).tolist(), (base + p1).tolist(), (base + p2 + window).tolist()
                ph = np.fromiter((digest(raw[q:q + prefix]) for q in x), np.uint64, len(x))
                bh = np.fromiter((digest(raw[q:e]) for q, e in zip(y, z, strict=True)), np.uint64, len(x))
                pack = ((p1 + shift) << 24) | ((p2 - p1) << 12) | (a - p1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[i + row]), pa.array(k2[i + row]), pa.array(pack), pa.array(ph.view(np.int64)),
                     pa.array(bh.view(np.int64))], names=["k1", "k2", "pack", "ph", "bh"])
    return run


def _contexts(window: int, prefix: int):
    """The bytes of each asked block, with the leading bytes of its anchor."""
    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            lists = batch.column("blocks")
            per = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), per)
            flat = lists.flatten()
            if not len(flat):
                continue
            pack, ph = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pack", "ph"))
            first, more, anchor = pack >> 24, (pack >> 12) & 4095, pack & 4095
            s = off[row] + first
            e = s + more + window
            for g in range(0, len(row), BLOCKS):
                of = slice(g, g + BLOCKS)
                body = [data[x:y].tobytes() for x, y in zip(s[of].tolist(), e[of].tolist(), strict=True)]
                lead = [b[a:a + min(24, prefix)] for b, a in zip(body, anchor[of].tolist(), strict=True)]
                keys = [pa.array(batch.column(c).to_numpy()[row[of]]) for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(pack[of]), pa.array(ph[of]), pa.array(lead, pa.binary()), pa.array(body, pa.binary())],
                    names=["k1", "k2", "pack", "ph", "lead", "body"])
    return run


def multikey_sort(tokens: list, n: int, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of n strings of tokens. tokens: for each position, a
    function that gives the token of the asked strings; run: a number for each
    string, strings of different numbers are not compared. Strings that differ
    at a token are placed by it, runs of equal ones go on to the next token.
    Returns the order and, for each place in it, whether the string equals its
    predecessor."""
    order = np.argsort(run, kind="stable")
    run = run[order]
    equal = np.zeros(n, bool)
    equal[1:] = run[1:] == run[:-1]
    live = np.arange(n)  # places that share their run
    for d in range(len(tokens) + 1):
        heads = np.flatnonzero(~equal[live])
        size = np.diff(np.append(heads, len(live)))
        run[live] = np.repeat(live[heads], size)
        live = live[np.repeat(size > 1, size)]
        if d == len(tokens) or not len(live):
            break
        key = tokens[d](order[live])
        rank = np.lexsort((key, run[live]))
        order[live] = order[live[rank]]
        key = key[rank]
        equal[live[1:]] &= (key[1:] == key[:-1])
    return order, equal


#: Bytes of a token in the bucket sort; tokens are ordered by their hashes.
TOKEN = 40


def _token_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes at every place; a part of data at a time."""
    hashes = np.zeros(max(0, len(data) - size + 1), np.uint64)
    for g in range(0, len(hashes), PART):
        at = np.arange(min(PART, len(hashes) - g))
        hashes[g:g + PART] = span_hashes(data[g:g + len(at) + size - 1], at, at + size)
    return hashes


def _window_tokens(hashes: np.ndarray, size: int, start: np.ndarray, anchor: np.ndarray, window: int, prefix: int) -> list:
    """Tokens of windows that start at ``start`` and agree over the prefix at
    ``start + anchor``: those before it, then those behind it."""
    before = -(-int(anchor.max(initial=0)) // size)
    behind = -(-(window - prefix - int(anchor.min(initial=0))) // size)
    places = [lambda i, d=d: np.minimum(d * size, window - size) for d in range(before)]
    places += [lambda i, d=d: np.minimum(anchor[i] + prefix + d * size, window - size) for d in range(behind)]
    return [lambda i, p=p: hashes[start[i] + p(i)] for p in places]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows at a and b agree byte for byte."""
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(
        data, shape=(max(0, len(data) - 7), 8), strides=(1, 1))).view(np.uint64).ravel()
    same = np.ones(len(a), bool)
    for d in [*range(0, window - 7, 8), window - 8]:
        same &= words[a + d] == words[b + d]
    return same


def _sorted_windows(window: int, prefix: int):
    """Windows of the blocks that occur elsewhere, as (keys, from, to)."""
    def run(batches):
        for group in whole_groups(batches, ["lead", "ph"], rows=1_000):
            body = group.column("body").combine_chunks().cast(pa.large_binary())
            off = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, body.offset * 8)
            data = np.frombuffer(body.buffers()[2], np.uint8)
            pack = group.column("pack").to_numpy()
            windows = ((pack >> 12) & 4095) + 1
            row = np.repeat(np.arange(len(pack), dtype=np.int32), windows)
            step = (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
            place = ((pack & 4095)[row] - step).astype(np.int32)
            # windows with unequal prefixes, or with them at unequal places, differ
            ph = np.unique(group.column("ph").to_numpy(), return_inverse=True)[1]
            size = min(TOKEN, window)
            hashes = _token_hashes(data, size)
            hit = np.zeros(len(row), bool)
            for of in _by_place(place):
                start, anchor = off[row[of]] + step[of], place[of].astype(np.int64)
                order, equal = multikey_sort(_window_tokens(hashes, size, start, anchor, window, prefix), len(of),
                                             ph[row[of]] * (2 * window) + anchor + window)
                at = np.flatnonzero(equal)
                at = at[_same_bytes(data, start[order[at]], start[order[at - 1]], window)]
                hit[of[order[at]]] = True
                hit[of[order[at - 1]]] = True
            yield _spans(group, row[hit], ((pack >> 24)[row[hit]] + step[hit]), window)
    return run


def _by_place(place: np.ndarray) -> Iterator[np.ndarray]:
    """The windows in parts of at most SORTED, or those of one place; windows of
    one place are never parted."""
    if len(place) <= SORTED:
        yield np.arange(len(place))
        return
    order = np.argsort(place, kind="stable").astype(np.int32)
    ends = np.append(np.flatnonzero(np.diff(place[order])) + 1, len(order))
    begin = 0
    while begin < len(order):
        end = max(ends[np.searchsorted(ends, begin, "right")], ends[max(0, np.searchsorted(ends, begin + SORTED, "right") - 1)])
        yield np.sort(order[begin:end])
        begin = end


def _spans(keys: pa.Table, row: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch:
    """Windows in order of (row, start), joined to spans where they overlap."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + window)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[:len(first)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.column("k1").to_numpy()[row[first]]), pa.array(keys.column("k2").to_numpy()[row[first]]),
         pa.array(start[first]), pa.array(start[last] + window)], names=["k1", "k2", "s", "e"])


def _digested(window: int):
    """Every window of the blocks by itself, under a 128-bit digest."""
    def run(batches):
        for batch in batches:
            for g in range(0, batch.num_rows, 1000):
                part = batch.slice(g, 1000)
                out = ([], [], [])
                for r, (body, pack) in enumerate(zip(part.column("body").to_pylist(), part.column("pack").to_pylist(), strict=True)):
                    for p in range(((pack >> 12) & 4095) + 1):
                        out[0].append(xxhash.xxh3_128_digest(body[p:p + window]))
                        out[1].append(r)
                        out[2].append((pack >> 24) + p)
                row = np.array(out[1], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.binary()), *(pa.array(part.column(c).to_numpy()[row]) for c in ("k1", "k2")),
                     pa.array(out[2], pa.int64())], names=["digest", "k1", "k2", "s"])
    return run


def _texts(docs: DataFrame) -> DataFrame:
    """k1, k2, text of every row: the one exchange of texts that all joins by
    document share."""
    return keyed(docs).select("k1", "k2", "text")


def repeated_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(k1, k2, s, e): byte spans of documents made of repeated windows. They
    may overlap; their union is what repeats."""
    blocks = written(spark, keyed(docs).mapInArrow(
        lean(_anchors(window, prefix)), "k1 long, k2 long, pack long, ph long, bh long"), "blocks")
    often = blocks.groupBy("ph").agg(F.count(F.lit(1)).alias("n"), F.min("bh").alias("lo"), F.max("bh").alias("hi"))
    often = written(spark, often.filter("n > 1").select("ph", (F.col("lo") != F.col("hi")).alias("mixed")), "often")
    again = written(spark, blocks.join(often, "ph"), "again")
    drop(spark, blocks, often)
    mixed = again.filter("mixed")
    distinct = mixed.groupBy("ph", "bh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pack")).alias("one"))
    distinct = written(spark, distinct.select("ph", "bh", "n", "one.*"), "distinct")
    hot = written(spark, distinct.groupBy("ph").count().filter(F.col("count") > HOT_BLOCKS).select("ph"), "hot")
    n = parallelism(spark)

    def contexts(asked: DataFrame) -> DataFrame:
        lists = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("pack", "ph")).alias("blocks"))
        return _texts(docs).join(lists, ["k1", "k2"]).select("k1", "k2", "text", "blocks").mapInArrow(
            lean(_contexts(window, prefix)), "k1 long, k2 long, pack long, ph long, lead binary, body binary")

    first = F.shiftright("pack", 24)
    whole = again.filter("NOT mixed").select("k1", "k2", "pack").unionByName(
        mixed.join(distinct.filter("n > 1").select("ph", "bh"), ["ph", "bh"]).select("k1", "k2", "pack"))
    spans = whole.select("k1", "k2", first.alias("s"),
                         (first + F.shiftright("pack", 12).bitwiseAND(F.lit(4095)) + window).alias("e"))
    few = distinct
    if not hot.isEmpty():
        few = distinct.join(hot, "ph", "left_anti")
        single = contexts(distinct.join(hot, "ph", "left_semi")).select("k1", "k2", "pack", "body").mapInArrow(
            lean(_digested(window)), "digest binary, k1 long, k2 long, s long")
        twice = single.groupBy("digest").count().filter("count > 1").select("digest")
        spans = spans.unionByName(single.join(twice, "digest").select("k1", "k2", "s", (F.col("s") + window).alias("e")))
    by_sort = (contexts(few).repartitionByRange(n, "lead", "ph").sortWithinPartitions("lead", "ph")
               .mapInArrow(lean(_sorted_windows(window, prefix)), "k1 long, k2 long, s long, e long"))
    return spans.unionByName(by_sort)


def cut(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes left, removed bytes, maximal removed runs)."""
    if not len(starts):
        return data, 0, 0
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    s, e = s[first], e[np.append(first[1:], len(e)) - 1]
    edges = np.stack([np.append(0, e), np.append(s, len(data))], axis=1).tolist()
    return b"".join(data[a:b] for a, b in edges), int((e - s).sum()), len(s)


def _each_text(batch: pa.RecordBatch):
    data, off = utf8(batch.column("text"))
    lists = batch.column("__spans")
    flat = lists.flatten()
    s, e = (flat.field(c).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64) for c in ("s", "e"))
    at = np.zeros(batch.num_rows + 1, np.int64)
    per = np.diff(lists.offsets.to_numpy())
    at[1:] = np.cumsum(np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, per))
    for r in range(batch.num_rows):
        yield cut(data[off[r]:off[r + 1]].tobytes(), s[at[r]:at[r + 1]], e[at[r]:at[r + 1]])


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most DOCUMENTS rows."""
    for batch in batches:
        for g in range(0, batch.num_rows, DOCUMENTS):
            yield batch.slice(g, DOCUMENTS)


def _digests(batches):
    for batch in _few(batches):
        rows = [(len(kept) + gone, gone, runs, hashlib.sha256(kept).hexdigest()) for kept, gone, runs in _each_text(batch)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(spark: SparkSession, docs: DataFrame, own: DataFrame, window: int, prefix: int) -> DataFrame:
    """own (its keys in __k1, __k2) with each row's spans (null: none)."""
    spans = repeated_spans(spark, docs, window, prefix).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("s", "e")).alias("__spans"))
    return own.join(spans.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left")


def digests(spark: SparkSession, docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null text counts as empty; texts shorter than the window lose nothing;
    rows that repeat are places of their own, so both lose their windows; an
    empty table gives an empty result."""
    own = _texts(docs).withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    rows = _with_spans(spark, docs, own, window, prefix)
    return rows.select(F.nullif("__k1", F.lit(NULL_ID)).alias("doc_id"), "text", "__spans").mapInArrow(
        lean(_digests), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """docs with repeated windows cut out of text, in docs' columns. A
    character of which bytes were cut goes as a whole; a null text stays null;
    a text that repeats throughout becomes empty; n_chars, if there, follows."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names = list(docs.columns)
    at = names.index("text")

    def run(batches):
        for batch in _few(batches):
            cols = batch.column("row").flatten()
            own = pa.RecordBatch.from_arrays([cols[at], batch.column("__spans")], names=["text", "__spans"])
            kept = [k.decode("utf-8", "ignore") for k, _, _ in _each_text(own)]
            nulls = cols[at].is_null().to_numpy(zero_copy_only=False)
            cols[at] = pa.array(kept, pa.string(), mask=nulls)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    own = docs.select(as_row(docs), doc_key().alias("__k1"), text_key().alias("__k2"))
    rows = _with_spans(spark, docs, own, window, prefix)
    out = rows.select("row", "__spans").mapInArrow(lean(run), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
