"""Byte-level BPE through a lexicon of frequent words.

1. Pre-tokens are counted over all texts, and the most frequent ones, LEXICON
   at most, are compiled into a minimal acyclic transducer: an automaton whose
   equal suffixes are one, with numbers on its edges that add up to a word's
   place in the lexicon and so to its token ids. It is written to one file in
   the shared folder, which Spark hands to every executor and workers
   memory-map.
2. Texts are cut into pre-tokens and all words of a part walk the automaton
   side by side. Words that it lacks are merged exactly, once each for as long
   as a worker keeps them.
3. Decoding looks up each id's bytes.

The lexicon decides how much is merged anew, never a result. The letter, number
and space classes of the cutting come from the tokenizer's own pre-tokenizer,
asked once for each code point that occurs.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm.bpe import LONGEST, Merges, byte_characters
from almagest.llm.common import chunks, drop, shared_path, utf8, written

#: Words of the lexicon.
LEXICON = 65_536
CHUNK = 1 << 20
#: Words that a task counts, and a worker keeps the ids of, before it begins anew.
KEPT_WORDS = 300_000
#: Words that walk the automaton at once.
SIDE_BY_SIDE = 32_768
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)


# the tokenizer file

class Vocabulary(Merges):
    """Merges, token bytes and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, names = whole["model"], byte_characters()
        if model.get("end_of_word_suffix") or whole["normalizer"] or any(
                t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in whole["added_tokens"]):
            raise ValueError("only byte-level files without word ends, normaliser and stripping special tokens")
        vocab = model["vocab"]
        self.inner = self.last = np.array([vocab[c] for c in names], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._table(np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64))

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"].encode(): t["id"] for t in whole["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        self.names = names
        byte = {c: b for b, c in enumerate(names)}
        spelt = {i: bytes(map(byte.__getitem__, t)) for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = max(spelt) + 1
        self.size = np.array([len(spelt.get(i, b"")) for i in range(self.tokens)], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelt.get(i, b"") for i in range(self.tokens)), np.uint8)
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.learn(np.arange(128))

    def learn(self, points: np.ndarray) -> None:
        """Class of each code point: what the pre-tokenizer leaves it joined to."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes[points] = _SPACE
        for head, kind in (("!", _OTHER), ("1", _NUMBER), ("x", _LETTER)):
            starts = {begin for _, (begin, _) in cut("".join(f"\n{head}{chr(p)}" for p in points.tolist()))}
            joined = [3 * i + 2 not in starts for i in range(len(points))]
            self.classes[points[joined]] = kind

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact ids of words: by the merges side by side, or one by one by
        the library if long."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        for i, ids in zip(short, self.encode([words[i] for i in short]), strict=True):
            out[i] = ids
        for i, word in enumerate(words):
            if out[i] is None:
                out[i] = np.array([t.id for t in self.tokenizer.model.tokenize("".join(map(self.names.__getitem__, word)))], np.int32)
        return out

    # pre-tokens

    def _classes(self, data: np.ndarray) -> np.ndarray:
        """Class of the character that each byte belongs to."""
        out = self.classes[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            byte = data[lead].astype(np.int64)
            size = 2 + (byte >= 0xE0) + (byte >= 0xF0)
            after = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 63
            point = np.where(size == 2, (byte & 31) << 6 | after(1),
                             np.where(size == 3, (byte & 15) << 12 | after(1) << 6 | after(2),
                                      (byte & 7) << 18 | after(1) << 12 | after(2) << 6 | after(3)))
            point = np.minimum(point, 0x10FFFF)
            kind = self.classes[point]
            if (kind == _UNKNOWN).any():
                self.learn(np.unique(point[kind == _UNKNOWN]))
                kind = self.classes[point]
            for k in range(4):
                there = size > k
                out[np.minimum(lead[there] + k, len(data) - 1)] = kind[there]
        return out

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of texts begin; each ends where the next one
        begins. A run of letters, numbers or others is one, with one space
        before it; of a run of white space the last character stays apart
        before another run; an apostrophe alone takes the ending of a
        contraction with it."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = self._classes(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        mark = edge[:n].copy()
        mark[0] = True
        mark[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(mark)
        end = np.append(begin[1:], n)
        of = kind[begin]

        white = np.flatnonzero((of == _SPACE) & ~edge[end])
        last = end[white] - 1
        for _ in range(3):
            last -= (data[last] & 0xC0) == 0x80
        mark[last] = True
        mark[end[white][data[last] == 32]] = False

        lone = np.flatnonzero((of[:-1] == _OTHER) & (of[1:] == _LETTER) & (end[:-1] - begin[:-1] == 1)
                              & (data[begin[:-1]] == 39) & mark[begin[:-1]] & ~edge[end[:-1]])
        at, stop = end[lone], end[lone + 1]
        one, two = data[at], np.where(at + 1 < stop, data[np.minimum(at + 1, n - 1)], 0)
        takes = np.where(np.isin(one, list(b"stmd")), 1, 0)
        for pair in (b"re", b"ve", b"ll"):
            takes[(one == pair[0]) & (two == pair[1])] = 2
        at, stop, takes = at[takes > 0], stop[takes > 0], takes[takes > 0]
        mark[at] = False
        inner = at + takes < stop
        mark[(at + takes)[inner]] = True
        return np.flatnonzero(mark)

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Boundaries inside which texts are cut on their own, and the id of
        each segment (by its start) that is a special token. Long texts are
        cut where a pre-token begins in any case: before a space between two
        letters."""
        cuts, special = [offsets], {}
        whole = data.tobytes()
        if self.specials and self.specials.search(whole):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for m in self.specials.finditer(whole, a, b):
                    special[m.start()] = self.special[m[0]]
                    cuts.append(np.array(m.span()))
        letter = (data | 32) - np.uint8(97) < 26 if (np.diff(offsets) > CHUNK).any() else None
        for i in np.flatnonzero(np.diff(offsets) > CHUNK).tolist():
            for at in range(int(offsets[i]) + CHUNK, int(offsets[i + 1]) - 1, CHUNK):
                upto = min(at + CHUNK, int(offsets[i + 1]) - 1)
                good = np.flatnonzero((data[at:upto] == 32) & letter[at - 1:upto - 1] & letter[at + 1:upto + 1])
                cuts.append(at + good[:1])
        return np.unique(np.concatenate(cuts)), special


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


# the lexicon

def minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], list[int]]:
    """Edges, ends and word counts of the states of the minimal automaton of
    sorted distinct words. The last state is the start."""
    edges: list[dict[int, int]] = []
    ends: list[bool] = []
    counts: list[int] = []
    known: dict[tuple, int] = {}
    path: list[tuple[dict[int, int], bool]] = [({}, False)]  # open states along the last word
    before = b""

    def close(depth: int) -> None:
        """Close the open states below depth: equal ones become one."""
        for at in range(len(path) - 1, depth, -1):
            out, end = path.pop()
            key = (end, tuple(out.items()))
            if key not in known:
                known[key] = len(edges)
                edges.append(out)
                ends.append(end)
                counts.append(end + sum(counts[s] for s in out.values()))
            path[-1][0][before[at - 1]] = known[key]

    for word in words:
        shared = len(os.path.commonprefix([before, word]))
        close(shared)
        path += [({}, False) for _ in word[shared:]]
        path[-1] = (path[-1][0], True)
        before = word
    close(0)
    out, end = path[0]
    edges.append(out)
    ends.append(end)
    counts.append(end + sum(counts[s] for s in out.values()))
    return edges, ends, counts


def compiled(words: list[bytes], ids: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The transducer of sorted distinct words as arrays. Edge (state, byte)
    lies at place[state] + byte if owner there is the state; rows of many edges
    are put, the longest first, where they fit, rows of one edge into what is
    left."""
    edges, ends, counts = minimal(words)
    total = sum(map(len, edges))
    place, taken = np.zeros(len(edges), np.int64), np.zeros(2 * total + 8192, bool)
    at, window = 256, 1024
    for state in sorted((s for s, e in enumerate(edges) if len(e) > 1), key=lambda s: (-len(edges[s]), s)):
        need = np.fromiter(edges[state], np.int64, len(edges[state]))
        need = need - need[0]
        while True:
            if at + window + 256 > len(taken):
                taken = np.append(taken, np.zeros(len(taken), bool))
            free = at + np.flatnonzero(~taken[at:at + window])
            fit = free[~taken[free[:, None] + need].any(axis=1)]
            if len(fit):
                break
            at += window  # rows to come are as long or shorter, and begin here
        place[state] = fit[0] - next(iter(edges[state]))
        taken[fit[0] + need] = True
    ones = [s for s, e in enumerate(edges) if len(e) == 1]
    free = np.flatnonzero(~taken[256:]) + 256
    if len(free) < len(ones):
        free = np.append(free, len(taken) + np.arange(len(ones)))
    place[ones] = free[:len(ones)] - np.array([next(iter(edges[s])) for s in ones], np.int64)
    size = int(max(place.max(), free[len(ones) - 1] if ones else 0)) + 257
    owner, target, number = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    for state, out in enumerate(edges):
        passed = int(ends[state])
        for byte, to in out.items():
            at = place[state] + byte
            owner[at], target[at], number[at] = state, to, passed
            passed += counts[to]
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    return {"place": place.astype(np.int32), "ends": np.array(ends), "owner": owner, "target": target, "number": number, "size": length,
            "ids": np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.uint32)}


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in one file: a line that names them, then each at a multiple of 64."""
    at, head = 4096, {}
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    out = bytearray(at)
    line = json.dumps(head).encode()
    out[:len(line)] = line
    for name, a in arrays.items():
        out[head[name][2]:head[name][2] + a.nbytes] = a.tobytes()
    return bytes(out)


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            head = json.loads(f.read(4096).rstrip(b"\0"))
        for name, (kind, n, at) in head.items():
            setattr(self, name, np.memmap(file, np.dtype(kind), "r", at, (n,)) if n else np.zeros(0, np.dtype(kind)))
        self.start = len(self.place) - 1

    def find(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word of data, -1 if the lexicon lacks it."""
        out = np.full(len(starts), -1, np.int64)
        for a in range(0, len(starts), SIDE_BY_SIDE):
            self._walk(data, starts[a:a + SIDE_BY_SIDE], size[a:a + SIDE_BY_SIDE], out[a:a + SIDE_BY_SIDE])
        return out

    def _walk(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        row = np.argsort(-size, kind="stable")  # longest first: words that end are at the end
        row = row[np.searchsorted(-size[row], -LONGEST):]
        ends = np.searchsorted(-size[row], -np.arange(LONGEST + 2), "right")  # words longer than k, less one
        at = starts[row]
        state, number = np.full(len(row), self.start, np.int32), np.zeros(len(row), np.int32)
        alive = np.ones(len(row), bool)
        for k in range(int(size[row[0]]) if len(row) else 0):
            n = ends[k + 1]
            here = state[:n]
            slot = self.place[here] + data[at[:n] + k]
            alive[:n] &= self.owner[slot] == here
            number[:n] += self.number[slot]
            state[:n] = self.target[slot]
        good = alive & self.ends[state]
        out[row[good]] = number[good]


class Encoder:
    """Token ids of texts by a lexicon, and by merging what it lacks."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary(path), lexicon
        self._clear()

    def _clear(self) -> None:
        special = self.vocabulary.special
        self.code = {w: len(self.lexicon.size) + i for i, w in enumerate(special)}
        self.size = np.concatenate([self.lexicon.size, np.ones(len(special), np.int64)])
        self.ids = np.concatenate([self.lexicon.ids, np.array(list(special.values()), np.uint32)])
        self.begin = np.cumsum(self.size) - self.size

    def _learn(self, words: list[bytes]) -> None:
        new = [w for w in words if w not in self.code]
        if len(self.code) + len(new) > KEPT_WORDS:
            self._clear()
            new = [w for w in words if w not in self.code]
        ids = self.vocabulary.merged(new)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.code.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *ids]).astype(np.uint32)
        self.begin = np.cumsum(self.size) - self.size

    def _part(self, data: np.ndarray, offsets: np.ndarray, special: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each word, its number of ids, all ids) of some segments."""
        starts = self.vocabulary.starts(data, offsets)
        if special:
            own = np.isin(offsets[:-1], list(special))
            segment = np.searchsorted(offsets, starts, "right") - 1
            starts = starts[~own[segment] | (starts == offsets[segment])]
        size = np.diff(np.append(starts, len(data)))
        code = self.lexicon.find(data, starts, size)
        if special:
            code[np.isin(starts, list(special))] = -1
        new = np.flatnonzero(code < 0)
        if len(new):
            coded = words_of(data, starts[new], size[new]).dictionary_encode()
            known = coded.dictionary.to_pylist()
            self._learn(known)
            code[new] = np.fromiter(map(self.code.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]
        per = self.size[code]
        total = np.cumsum(per)
        at = np.repeat(self.begin[code] - total + per, per) + np.arange(int(total[-1]) if len(total) else 0)
        return starts, per, self.ids[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(ids in parts, ids of each text) of UTF-8 texts."""
        segments, special = self.vocabulary.segments(data, offsets)
        n, out = np.zeros(len(offsets) - 1, np.int64), []
        for i, j in chunks(segments, CHUNK):
            a, b = int(segments[i]), int(segments[j])
            starts, per, ids = self._part(data[a:b], segments[i:j + 1] - a, {s - a: t for s, t in special.items() if a <= s < b})
            row = np.searchsorted(offsets, starts + a, "right") - 1
            n += np.bincount(row, per, len(n)).astype(np.int64)
            out.append(ids)
        return out, n


def words_of(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parts of data as a binary array."""
    ends = np.cumsum(size)
    at = np.repeat(starts - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [
        None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data[at])])


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = vocabulary(path), Counter()

        def made():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                              names=["word", "n"])
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            segments, _ = known.segments(data, offsets)
            for i, j in chunks(segments, CHUNK):
                part = data[segments[i]:segments[j]]
                starts = known.starts(part, segments[i:j + 1] - segments[i])
                size = np.diff(np.append(starts, len(part)))
                starts, size = starts[size <= LONGEST], size[size <= LONGEST]
                coded = words_of(part, starts, size).dictionary_encode()
                times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                held.update(dict(zip(coded.dictionary.to_pylist(), times.tolist(), strict=True)))
                if len(held) > KEPT_WORDS:
                    yield made()
                    held.clear()
        yield made()
    return run


def frequent_words(spark: SparkSession, docs: DataFrame, path: str, most: int = LEXICON) -> list[bytes]:
    """The most frequent pre-tokens of all texts, most at most: all with a
    count above a limit that a histogram of counts (to three digits) gives."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    counts = written(spark, texts.mapInArrow(_counted(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
                     .filter("n > 1"), "words")
    step = F.pow(F.lit(10), F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))).cast("long")
    digits = (F.floor(F.col("n") / step) * step).cast("long")
    least, total = None, 0
    for row in counts.groupBy(digits.alias("least")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("least")).collect():
        total += row.words
        if total > most:
            break
        least = row.least
    words = [bytes(r.word) for r in counts.filter(F.col("n") >= least).select("word").collect()] if least else []
    drop(spark, counts)
    return sorted(words)


def lexicon_file(spark: SparkSession, words: list[bytes], path: str) -> str:
    """Compile words, write the file to the shared folder and have Spark hand
    it to every executor; its name there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "lexicon") + ".bin")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed(compiled(words, vocabulary(path).merged(words)))))
    out.close()
    spark.sparkContext.addFile(target.toString())
    return target.getName()


# operators

_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoded(path: str, file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, file) not in _ENCODERS:
            _ENCODERS[path, file] = Encoder(path, Lexicon(SparkFiles.get(file)))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets, 38 * CHUNK):
                parts, n = _ENCODERS[path, file].encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ids = np.concatenate([*parts, np.zeros(0, np.uint32)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), binary(ids.view(np.uint8), 4 * n)],
                                                 names=["doc_id", "ids"])
    return run


def binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)])
    if ends[-1] >= 2**31:
        raise ValueError("more than 2 GB of ids in one part")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def encode(spark: SparkSession, docs: DataFrame, path: str, words: list[bytes] | None = None) -> DataFrame:
    """doc_id, ids of every row: the token ids of its whole text as
    little-endian unsigned 32-bit integers, as the tokenizer file at path gives
    them, its special tokens recognised in the text.

    words are those of the lexicon, by default the frequent ones of docs. Null
    and empty texts have no ids; repeated rows and ids give a row each; an
    empty table gives none; other columns are ignored."""
    file = lexicon_file(spark, frequent_words(spark, docs, path) if words is None else sorted(set(words)), path)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_encoded(path, file), "doc_id long, ids binary"))


def decoded(ids: np.ndarray, per: np.ndarray, known: Vocabulary) -> pa.Array:
    """Texts of ids; ids that the vocabulary lacks are nothing, bytes that are
    not UTF-8 become replacement characters."""
    row = np.repeat(np.arange(len(per)), per)
    there = ids < known.tokens
    ids, row = ids[there], row[there]
    size = known.size[ids]
    ends = np.cumsum(size)
    at = np.repeat(known.begin[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
    data = binary(known.bytes[at], np.bincount(row, size, len(per)).astype(np.int64))
    try:
        return data.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in data.to_pylist()], pa.string())


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            offsets = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column("ids")).fill_null(0).to_numpy())])
            for i, j in chunks(offsets, 8 * CHUNK):
                ids = batch.column("ids").slice(i, j - i)
                values = np.frombuffer(b"".join(b or b"" for b in ids.to_pylist()), "<u4")
                texts = decoded(values, np.diff(offsets[i:j + 1]) // 4, known)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), ids, texts], names=["doc_id", "ids", "text"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the text of each row's ids (see :func:`encode`),
    special tokens spelt out. Null ids give an empty text, ids that the
    vocabulary lacks nothing."""
    return (encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids"))
            .mapInArrow(_decoded(path), "doc_id long, ids binary, text string"))


def digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them."""
    return decode(encode(spark, docs, path), path).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))
