"""Spelling variants grouped by reduced-alphabet generation.

1. Words are counted over all texts. A small share of the occurrences, chosen
   by a checksum of document and word, loses one letter first.
2. Letters are hashed to SYMBOLS symbols. Every vocabulary word makes the full
   one-edit neighbourhood of its reduced word: the word itself, each symbol
   replaced, each left out, each put in at each place. Words of one edit have
   reduced words of one edit or none, so each finds the other's.
3. The neighbourhoods are joined with the reduced vocabulary. As words have at
   least SHORTEST code points, an edit leaves either their first or their last
   ANCHOR code points as they were, and each neighbour knows which: these
   letters, unreduced, are part of the join key, so that a reduced word shared
   by many words meets few of them.
4. Pairs found are verified on the original words.

Neighbours are 64-bit hashes made by arithmetic on one polynomial hash of the
reduced word, so a word of any length costs a few numbers for each letter; a
collision costs a check, never a result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm.common import drop, lower_ascii, mix64, utf8, word_spans, written

SHORTEST, LEAST, RATIO = 6, 5, 5
#: An occurrence whose checksum this divides loses a letter.
MISSPELT = 199
SYMBOLS, ANCHOR = 4, 3
CHUNK = 4 << 20
#: Words that a task counts before it hands them on.
KEPT_WORDS = 400_000
#: Neighbours made at once.
MADE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_UNBASE = np.uint64(pow(_BASE, -1, 2**64))
_SHORT = 64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Checksums:
    """CRC-32 of a prefix followed by a word, from the CRC-32 of each: what a
    checksum becomes under n more bytes is linear, so four table rows for
    every n up to _SHORT say it."""

    def __init__(self):
        step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        row = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
        rows = [row]
        for _ in range(_SHORT):
            row = step[row & 255] ^ (row >> 8)
            rows.append(row)
        self.shift = np.stack(rows)

    def join(self, before: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = after.copy()
        for k in range(4):
            out ^= self.shift[size, k, (before >> np.uint32(8 * k)) & 255]
        return out


_CHECKSUMS: list[Checksums] = []


def run_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters A-Z, a-z, U+00C0 to U+00FF."""
    inside = _LETTER[data]
    lead = np.flatnonzero(data == 0xC3)  # C3 80 to C3 BF
    inside[lead] = True
    inside[lead[lead + 1 < len(data)] + 1] = True
    return inside


def windows(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Parts of at most about limit bytes that end between runs."""
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data):
            outside = np.flatnonzero(~run_bytes(data[end - 1:end + 4096])[1:])
            if len(outside):
                end += int(outside[0])
                break
            end = min(end + 4096, len(data))
        yield at, end
        at = end


def _words_of(data: np.ndarray, offsets: np.ndarray, heads: np.ndarray) -> Counter:
    """Occurrences of each word as bytes, after the misspellings."""
    if not _CHECKSUMS:
        _CHECKSUMS.append(Checksums())
    inside = run_bytes(data)
    starts, ends, rows = word_spans(data, offsets, inside)
    size = ends - starts
    total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(size), [
        None, pa.py_buffer(total), pa.py_buffer(lower_ascii(data[inside]))]).dictionary_encode()
    known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    letters = np.fromiter((len(w) - w.count(0xC3) for w in known), np.int64, len(known))
    own = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    check = np.zeros(len(code), np.uint32)
    short = size <= _SHORT
    check[short] = _CHECKSUMS[0].join(heads[rows[short]], own[code[short]], size[short])
    for i in np.flatnonzero(~short).tolist():
        check[i] = zlib.crc32(known[code[i]], int(heads[rows[i]]))
    wrong = check % MISSPELT == 0
    times = np.bincount(code[~wrong], minlength=len(known))
    keep = np.flatnonzero((times > 0) & (letters >= SHORTEST))
    out = Counter(dict(zip([known[i] for i in keep.tolist()], times[keep].tolist(), strict=True)))
    for c, h in zip(code[wrong].tolist(), check[wrong].tolist(), strict=True):
        if letters[c] > SHORTEST:
            word = known[c].decode()
            at = h % len(word)
            out[(word[:at] + word[at + 1:]).encode()] += 1
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def made():
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()),
                                           pa.array(list(held.values()), pa.int64())], names=["word", "n"])
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        heads = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column("id").to_pylist()], np.uint32)
        for a, b in windows(data, CHUNK):
            first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
            held.update(_words_of(data[a:b], np.clip(offsets[first:last + 1], a, b) - a, heads[first:last]))
            if len(held) > KEPT_WORDS:
                yield made()
                held.clear()
    yield made()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: results of at least SHORTEST code points and LEAST occurrences."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return (rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= LEAST))


class Reduced:
    """The reduced words of a batch, as code points, symbols and prefix hashes."""

    def __init__(self, words: pa.Array):
        self.size = pc.utf8_length(words).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.at = np.arange(len(points)) - self.start[self.word]
        self.symbol = symbols(points)
        steps = np.full(int(self.size.max(initial=0)) + 2, _BASE, np.uint64)
        steps[:1] = 1
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(steps)
            self.term = (self.symbol + np.uint64(1)) * self.power[self.at]
            self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.term, dtype=np.uint64)])
            self.whole = self.sum[self.end] - self.sum[self.start]
            edge = lambda at: (points[at] << np.uint64(42)) ^ (points[at + 1] << np.uint64(21)) ^ points[at + 2]
            self.first = mix64(edge(self.start) + np.uint64(_BASE))
            self.last = mix64(edge(self.end - ANCHOR) + np.uint64(2) * _UNBASE)

    def key(self, word: np.ndarray, value: np.ndarray, longer: int, early: np.ndarray | bool) -> np.ndarray:
        """Join keys of reduced words given by hash; early edits leave the
        last code points alone, later ones the first."""
        with np.errstate(over="ignore"):
            size = (self.size[word] + longer).astype(np.uint64)
            return mix64(value + size * _UNBASE) ^ np.where(early, self.last[word], self.first[word])

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, key) of every reduced word, by its last and first letters."""
        word = np.arange(len(self.size))
        return np.concatenate([word, word]), np.concatenate([self.key(word, self.whole, 0, e) for e in (True, False)])

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of all reduced words one edit away, and of the words'
        own. Where edits at two places make the same word, the first is left
        out, unless it is the last early one."""
        yield self.own()
        word, at = self.word, self.at
        early, twin = at < ANCHOR, at != ANCHOR - 1
        with np.errstate(over="ignore"):
            before = self.sum[:-1] - self.sum[self.start[word]]
            after = self.whole[word] - before - self.term
            inner = at + 1 < self.size[word]
            same = np.zeros(len(at), bool)
            same[:-1] = (self.symbol[1:] == self.symbol[:-1])
            out = ~(same & inner & twin)
            yield word[out], self.key(word[out], (before + after * _UNBASE)[out], -1, early[out])
            behind = np.arange(len(self.size))
            for c in range(SYMBOLS):
                c = np.uint64(c)
                other = self.symbol != c
                value = before + (c + np.uint64(1)) * self.power[at] + after
                yield word[other], self.key(word[other], value[other], 0, early[other])
                put = other | ~twin
                value = before + (c + np.uint64(1)) * self.power[at] + (after + self.term) * np.uint64(_BASE)
                yield word[put], self.key(word[put], value[put], 1, early[put])
                yield behind, self.key(behind, self.whole + (c + np.uint64(1)) * self.power[self.size], 1, False)


def symbols(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    with np.errstate(over="ignore"):
        return (points * np.uint64(_BASE)) >> np.uint64(64 - (SYMBOLS - 1).bit_length())


def _keys(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.utf8_length(batch.column("word")).to_numpy())
            a = 0
            while a < batch.num_rows:  # so many letters at once, or one word
                made = MADE // (2 * SYMBOLS + 1) + (sizes[a - 1] if a else 0)
                b = max(a + 1, int(np.searchsorted(sizes, made, "right")))
                part = batch.slice(a, b - a)
                reduced, ids = Reduced(part.column("word")), part.column("id").to_numpy()
                for word, key in reduced.neighbours() if kind == "neighbours" else [reduced.own()]:
                    for p in range(0, len(word), MADE):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[word[p:p + MADE]], pa.int64()),
                                                          pa.array(key[p:p + MADE].view(np.int64))], names=["id", "key"])
                a = b
    return run


def near_words(words: DataFrame) -> DataFrame:
    """id, near: every pair, in both directions, of words (id, word) one
    inserted, deleted or replaced code point apart. Both words of a pair reach
    each other, so it is verified once."""
    made = words.select("id", "word").mapInArrow(_keys("neighbours"), "id long, key long")
    own = words.select("id", "word").mapInArrow(_keys("own"), "near long, key long")
    found = made.join(own, "key").filter("id < near").select("id", "near").distinct()
    left, right = words.select("id", F.col("word").alias("a")), words.select(F.col("id").alias("near"), F.col("word").alias("b"))
    pairs = found.join(left, "id").join(right, "near").filter(F.levenshtein("a", "b", 1) == 1)
    both = F.array(F.struct("id", "near"), F.struct(F.col("near").alias("id"), F.col("id").alias("near")))
    return pairs.select(F.explode(both).alias("p")).select("p.id", "p.near")


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """id, root: the end of each chain of forms (id, form), by pointers that
    double their reach. A form is at least RATIO times as frequent, so chains
    are short and end."""
    now = written(spark, forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = written(spark, now.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"),
                                                                        F.col("next").isNotNull().alias("moved")), "roots")
        drop(spark, now)
        if moved.filter("moved").isEmpty():
            return moved.drop("moved")
        now = moved.drop("moved")
        now.shared_path = moved.shared_path


def group_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary.

    A word's form is its near word of largest n (ties: the smallest by code
    point), if that n is at least RATIO times the word's; root follows forms
    to the last and is the word itself without one. Runs are of letters A-Z,
    a-z and U+00C0 to U+00FF, lower-cased in A-Z only, and an occurrence whose
    CRC-32 of "<doc_id>:<run>" MISSPELT divides loses the code point of that
    number modulo its length. Null texts have no words, a null doc_id is the
    empty string in the checksum, repeated rows count each, other columns are
    ignored. An empty table gives no rows."""
    # ids are written with the words, so that they stay what they are
    words = written(spark, vocabulary(docs).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    named = words.select(F.col("id").alias("near"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = (near_words(words).join(named, "near").groupBy("id")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("form_n"), "form", "near")).alias("f"))
            .select("id", "n_near", "f.form", "f.near", (-F.col("f.col1")).alias("form_n")))
    rows = words.join(best, "id", "left")
    fit = F.col("form_n") >= RATIO * F.col("n")
    rows = written(spark, rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                      *(F.when(fit, F.col(c)).alias(c) for c in ("form", "form_n", "near"))), "variants")
    ends = roots(spark, rows.filter("near IS NOT NULL").select("id", F.col("near").alias("form")))
    last = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    return rows.join(last, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"),
                                                "n", "n_near", "form_n")
