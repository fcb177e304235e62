"""Packing of tokenised documents into training sequences, best fit decreasing.

1. Each document's token ids, with an end id, are cut into full windows of
   ``WINDOW`` ids and a rest. White space never lies in a token of the
   tokenizer, so words are encoded once, kept, and looked up; a worker keeps
   ``KEPT_WORDS`` of them and then begins anew.
2. Pieces are dealt into groups of about ``GROUP_PIECES`` at random (by hash),
   so no task sees an unbounded number and every group has all lengths.
3. In a group, pieces go by falling length into the open window that they fill
   best: a segment tree over remaining capacities finds the least capacity
   that is enough. Full windows stand alone.

With an order, groups are stretches of 2^STRETCH_BITS consecutive pieces
instead, and sequences are numbered in it.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm.bpe import Merges
from almagest.llm.common import chunks, kept, lean, utf8, whole_groups, written

WINDOW = 4096
END_ID = 2
GROUP_PIECES = 100_000
#: Consecutive pieces that are packed together where an order is given, as a power of two.
STRETCH_BITS = 13
#: Words that a worker keeps the ids of.
KEPT_WORDS = 800_000


#: What lower-casing and normalisation keep in one piece: a run of letters.
_PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]{1,24}")
#: Between a letter and punctuation behind it, pre-tokens always part.
_PART, _PARTED = r"([a-z])([!-/:-@\[-`{-~])", r"\1 \2"
#: Begins special tokens; texts with it are left as they are.
_SPECIAL = "<|"


class WordIds:
    """Token ids of words, by a tokenizer that drops white space.

    Plain words are encoded many at a time by :mod:`almagest.llm.bpe`, all
    others by the library; each word once, as long as it is kept."""

    def __init__(self, path: str, end_id: int | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.end_id = Tokenizer.from_file(path), Merges(path), end_id
        self._clear()

    def _clear(self):
        self.code: dict[str | None, int] = {None: 0, "": 1}  # the end, nothing
        self.ids = np.array([self.end_id or 0], np.uint32)
        self.begin = np.array([0, 1], np.int64)
        self.size = np.array([1, 0], np.int64)

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.begin)
        self.code.update(zip(words, range(n, n + len(words)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def _add_lists(self, words: list[str], found: list) -> None:
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._add(words, np.concatenate([*map(np.asarray, found), np.zeros(0, np.int64)]), size)

    def learn(self, words: list[str]) -> None:
        """Know these words, each of them given once."""
        new = [w for w in words if w not in self.code]
        if not new:
            return
        if len(self.code) + len(new) > KEPT_WORDS:
            self._clear()
            new = [w for w in words if w]
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        other = [w for w in new if not _PLAIN.fullmatch(w)]
        self._add_lists(plain, self.merges.encode([w.encode() for w in plain]))
        self._add_lists(other, [e.ids for e in self.tokenizer.encode_batch(other, add_special_tokens=False)])

    def _joined(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the codes in order, and how many come from each."""
        size = self.size[code]
        total = np.cumsum(size)
        at = np.repeat(self.begin[code] - total + size, size) + np.arange(total[-1] if len(total) else 0)
        return self.ids[at], size

    def counts(self, words: list[str]) -> int:
        """Tokens of some words."""
        self.learn(list(set(words)))
        return int(sum(self.size[self.code[w]] for w in words))

    def lookup(self, texts: pa.Array, parted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all words of the texts, words of each text). parted:
        letters and punctuation behind them may count as words of their own."""
        if parted:
            easy = pc.replace_substring_regex(pc.ascii_lower(texts), _PART, _PARTED)
            texts = pc.if_else(pc.match_substring(texts, _SPECIAL), texts, easy)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        per = np.diff(lists.offsets.to_numpy())
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        self.learn(known)
        code = np.fromiter(map(self.code.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]
        full = code != 1  # white space at an edge of a text gives empty words
        if not full.all():
            row = np.repeat(np.arange(len(texts)), per)[full]
            code, per = code[full], np.bincount(row, minlength=len(texts))
        return code, per

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): each text's ids, then the end id."""
        code, per = self.lookup(texts)
        ends = np.cumsum(per)
        if self.end_id is not None:
            code = np.insert(code, ends, 0)
            ends = ends + np.arange(1, len(ends) + 1)
        ids, size = self._joined(code)
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.concatenate([[0], ends])]


def word_ids(path: str, end_id: int | None) -> WordIds:
    """One table of word ids for each tokenizer in a worker."""
    tables = kept("word_ids")
    if (path, end_id) not in tables:
        tables[path, end_id] = WordIds(path, end_id)
    return tables[path, end_id]


def _pieces(path: str, window: int, end_id: int, with_ids: bool, order: list[str]):
    def run(batches):
        encoder = word_ids(path, end_id)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            _, off = utf8(texts)
            for i, j in chunks(off, 1 << 22):
                ids, at = encoder.encode(texts.slice(i, j - i))
                n = np.diff(at)
                parts = -(-n // window)
                row = np.repeat(np.arange(j - i), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, n[row] - start)
                raw_ids, begin = ids.astype("<u4").tobytes(), at[row] + start
                slices = [raw_ids[4 * b:4 * e] for b, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                cols = [pa.array(batch.column("doc_id").slice(i, j - i).to_numpy(zero_copy_only=False)[row]
                                 if not batch.column("doc_id").null_count else
                                 batch.column("doc_id").slice(i, j - i).take(pa.array(row))),
                        pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, slices)), pa.int64()),
                        pa.array(n[row])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols, names = [*cols, pa.array(slices, pa.binary())], [*names, "ids"]
                cols += [batch.column(c).slice(i, j - i).take(pa.array(row)) for c in order]
                names = [*names, *order]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


class Capacities:
    """Segment tree over remaining capacities 0..size: counts of the open
    windows with a capacity in each node's range."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with at least that
        capacity, taken out; None if there is none."""
        count, i = self.count, least + self.leaves
        while not count[i]:
            while i & 1:  # a right child: go up until there is a right sibling
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of the level
                return None
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each piece, offset there) for pieces in any order."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = Capacities(window), 0
    for r, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if length == window:
            place[r], n = n, n + 1
            continue
        best = tree.take(length)
        if best is None:
            best, n = (window, n), n + 1
        capacity, w = best
        place[r], offset[r] = w, window - capacity
        if capacity > length:
            tree.put(capacity - length, w)
    return place, offset


def _packed(window: int, groups: int, stretch: int | None = None):
    def run(batches):
        for table in whole_groups(batches, ["grp"]):
            table = table.combine_chunks()
            group, length = table.column("grp").to_numpy(), table.column("length").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            seq, off = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                place, off[a:b] = best_fit_decreasing(length[a:b], window)
                if stretch is None:
                    seq[a:b] = place * groups + group[a]
                else:  # sequences by the mean place of their pieces in the order
                    mean = np.bincount(place, weights=np.arange(b - a)) / np.bincount(place)
                    rank = np.empty(len(mean), np.int64)
                    rank[np.argsort(mean, kind="stable")] = np.arange(len(mean))
                    seq[a:b] = (group[a] << stretch) + rank[place]
            out = table.drop_columns(["grp"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            yield from out.to_batches()
    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID,
         with_ids: bool = False, order: list[Column] | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; ids (little-endian 32-bit) if asked.

    tokenizer: path of a tokenizer file that every executor can read. Null
    text counts as empty and gives the end id alone; repeated rows are packed
    each; an empty table gives no pieces. order: columns of docs; consecutive
    rows are packed together and sequence_id rises with them."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    by = {f"order{i}": c for i, c in enumerate(order or [])}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[c.alias(n) for n, c in by.items()])
    kinds = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in by)
    pieces = written(spark, rows.mapInArrow(
        lean(_pieces(tokenizer, window, end_id, with_ids, list(by)), "word_ids"), schema + kinds), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    if order:
        dealt = pieces.repartitionByRange(groups, *by, "start").sortWithinPartitions(*by, "start").drop(*by)
        # the partition in the upper bits, the row in the partition in the lower 33
        dealt = dealt.withColumn("grp", F.shiftright(F.monotonically_increasing_id(), STRETCH_BITS))
        return dealt.mapInArrow(lean(_packed(window, groups, STRETCH_BITS), "word_ids"), f"{schema}, sequence_id long, offset long")
    luck = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("grp", F.pmod(luck, F.lit(groups))).repartition(groups, "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(lean(_packed(window, groups), "word_ids"), f"{schema}, sequence_id long, offset long")
