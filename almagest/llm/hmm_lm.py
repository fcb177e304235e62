"""Hidden Markov language model: Baum-Welch training over partitions, exact
scoring by the scaled forward recursion.

Model. A text is a sequence of tokens (words, then one end) emitted by a hidden
chain of ``STATES`` states. A state emits a token's class, and the class the
token: P(token | state) = P(class | state) P(token | class). The ``HEAD`` most
frequent training tokens are classes of their own; the others fall into
``TAIL`` classes by their last bytes, in which a token has the add-one share
(c + 1) / (n + v + 1) (n: training tokens of the class, v: distinct ones; the
last 1 is all unseen tokens). So a state's table has a fixed size whatever the
vocabulary, and the token counts stay a distributed table.

Training. Token counts come from one pass over all training texts. Every round
of Baum-Welch is one pass over all training sequences: each task sums expected
counts of its own sequences, the sums are added up by Spark by table cell, and
the driver gets the table. Sequences are cut at ``SEGMENT`` tokens for this.

Scoring. Sequences of a batch advance together. A text longer than a segment
is cut into segments whose transfer matrices are found side by side and
multiplied in order, which is the same recursion. Counts of tokens outside the
``KNOWN`` most frequent ones come by a join with the table of counts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm.common import chunks, keyed, lower_ascii, mix64, span_hashes, utf8, word_spans, written

STATES = 6
HEAD = 3072
TAIL = 1024
#: At most so many tokens' counts are sent to every task: 6 MB.
KNOWN = 1 << 18
ROUNDS = 4
SEGMENT = 512
#: Segments of the exact scoring, which loses nothing at their borders.
SCORE_SEGMENT = 4096
#: Sequences of about this many tokens advance together.
TRAIN_TOKENS, SCORE_TOKENS = 1 << 18, 1 << 20
#: Distinct tokens that a task holds while it counts.
MERGE_ROWS = 600_000
HELD_OUT = (7, 2)
END = mix64(np.array([0xE0D], np.uint64))
_PSEUDO = 0.1


def held_out(ids: list, modulus: int = HELD_OUT[0], part: int = HELD_OUT[1]) -> np.ndarray:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus == part for i in ids], bool)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tail class, offsets of each text) of all tokens of the texts,
    each text's words followed by the end token (class 0)."""
    low = lower_ascii(data)
    starts, ends, rows = word_spans(low, offsets)
    n = len(offsets) - 1
    words = np.bincount(rows, minlength=n)
    at = np.concatenate([[0], np.cumsum(words + 1)])
    place = np.arange(len(rows)) + rows
    h = np.full(at[-1], END[0], np.uint64)
    h[place] = span_hashes(low, starts, ends)
    suffix = mix64(span_hashes(low, np.maximum(starts, ends - 3), ends) + np.uint64(1))
    tail = np.zeros(at[-1], np.int64)
    tail[place] = (suffix % np.uint64(TAIL)).astype(np.int64)
    return h, tail, at


def _texts(batches, columns):
    """(values of columns, hashes, tails, offsets) for chunks of each batch."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in chunks(off, 1 << 20):
            yield [batch.column(c).slice(i, j - i) for c in columns], *tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])


def _counted(batches):
    """(token, tail, n) of the training texts, summed within the task over
    some MERGE_ROWS distinct tokens at a time."""
    held, n = [], 0
    for (ids,), h, tail, at in _texts(batches, ["doc_id"]):
        train = np.repeat(~held_out(ids.to_pylist()), np.diff(at))
        held.append(_summed(h[train], tail[train], np.ones(int(train.sum()), np.int64)))
        n += len(held[-1][0])
        if n > MERGE_ROWS:
            one = _summed(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [one], len(one[0])
            if n > MERGE_ROWS // 2:
                yield from _counts_batches(*one)
                held, n = [], 0
    if held:
        yield from _counts_batches(*_summed(*map(np.concatenate, zip(*held, strict=True))))


def _summed(h: np.ndarray, tail: np.ndarray, n: np.ndarray):
    """(token, tail, sum of n) of each different token."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], tail[order[first]], np.add.reduceat(n[order], first) if len(h) else n


def _counts_batches(h, tail, n):
    """As batches that neither side needs much memory for."""
    for i in range(0, len(h), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 50_000]) for x in (h.view(np.int64), tail, n)],
                                         names=["token", "tail", "n"])


def token_counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """token (hash), tail (class by ending), n: over the training texts."""
    part = keyed(docs).mapInArrow(_counted, "token long, tail long, n long")
    return written(spark, part.groupBy("token").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "counts")


@dataclass
class Vocabulary:
    """The most frequent tokens by hash, their counts and classes, and the
    size of each tail class. total: all training tokens; distinct: different ones."""

    hashes: np.ndarray
    counts: np.ndarray
    head: np.ndarray  # class of a head token, else -1
    tail_log: np.ndarray  # log10(n + v + 1) of each tail class
    total: int
    distinct: int

    @property
    def classes(self) -> int:
        return TAIL + HEAD

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each token, -1 if it is not among them."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def vocabulary(spark: SparkSession, counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the least count, on a log grid, that at most KNOWN tokens reach
    level = F.floor(F.log2("n") * 64).cast("int")
    levels = sorted(((r["level"], r["v"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect()),
                    reverse=True)
    reach = np.cumsum([v for _, v in levels])
    enough = [lv for (lv, _), r in zip(levels, reach, strict=True) if r <= KNOWN]
    top = counts.filter(level >= F.lit(enough[-1] if enough else 1 << 20)).select("token", "n").toArrow()  # KNOWN rows
    h, c = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    head = np.where(np.arange(len(h)) < HEAD, TAIL + np.arange(len(h)), -1)
    firsts = spark.createDataFrame([(int(x),) for x in h[:HEAD].view(np.int64)], "token long")
    rest = counts.join(F.broadcast(firsts), "token", "left_anti")  # HEAD rows
    size = np.ones(TAIL)
    for r in rest.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # TAIL rows
        size[r["tail"]] += r["n"] + r["v"]
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], head[order], np.log10(size), int(total[0]), int(total[1]))


def _sequences(words: Vocabulary):
    """Classes of every text's tokens, and what its score needs besides."""
    def run(batches):
        base = np.log10(words.total + words.distinct + 1)
        for (ids, k1, k2), h, tail, at in _texts(batches, ["doc_id", "k1", "k2"]):
            n = len(at) - 1
            row = np.repeat(np.arange(n), np.diff(at))
            place = words.find(h)
            known = place >= 0
            logs = np.where(known, np.log10(words.counts[place] + 1.0) if len(words.counts) else 0.0, 0.0)
            cls = np.where(known, words.head[place], -1) if len(words.head) else np.full(len(h), -1)
            in_tail = cls < 0
            cls = np.where(in_tail, tail, cls)
            inner = np.where(in_tail, logs - words.tail_log[tail], 0.0)
            rare = np.flatnonzero(~known)
            per = np.bincount(row[rare], minlength=n)
            yield pa.RecordBatch.from_arrays([
                ids, k1, k2, pa.array(held_out(ids.to_pylist())), pa.array(np.diff(at)),
                pa.array(np.bincount(row[known], minlength=n)),
                pa.array(np.bincount(row, weights=logs, minlength=n) - np.diff(at) * base),
                pa.array(np.bincount(row, weights=inner, minlength=n)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at[1:] - at[:-1])]).astype(np.int32)),
                                         pa.array(cls.astype(np.int16))),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)),
                                         pa.array(h[rare].view(np.int64)))],
                names=["doc_id", "k1", "k2", "held_out", "n_tokens", "n_known", "base_score", "inner", "classes", "rare"])
    return run


_SEQUENCES = ("doc_id long, k1 long, k2 long, held_out boolean, n_tokens long, n_known long, base_score double, "
              "inner double, classes array<short>, rare array<long>")


@dataclass
class Chain:
    """Start and later-segment state shares, transitions, class emissions."""

    start: np.ndarray
    within: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # classes x states


def first_guess(unigram: np.ndarray, states: int = STATES) -> Chain:
    """Sticky transitions, and emissions around the unigram table."""
    rng = np.random.default_rng(11)
    emits = (unigram[:, None] + 1e-9) * np.exp(0.5 * rng.standard_normal((len(unigram), states)))
    moves = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(moves, 0.9)
    return Chain(np.full(states, 1 / states), np.full(states, 1 / states), moves, emits / emits.sum(axis=0))


def _by_step(classes: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Sequences in order of falling length, and at each step the class of
    those that are that long: (order, list of class arrays)."""
    order = np.argsort(-size, kind="stable")
    b, s = begin[order], size[order]
    alive = np.searchsorted(-s, -np.arange(s[0] if len(s) else 0), "left")
    return order, [classes[b[:m] + t] for t, m in enumerate(alive.tolist())]


def _expected(chain: Chain, classes: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray):
    """Expected counts (start, within, moves, emits) of sequences that advance
    together; first marks those that begin a text."""
    order, steps = _by_step(classes, begin, size)
    k = len(chain.start)
    alphas, scales, emitted = [], [], []
    a = np.where(first[order][:, None], chain.start, chain.within)
    for t, cls in enumerate(steps):
        e = chain.emits[cls]
        a = (a[:len(cls)] if t == 0 else alphas[-1][:len(cls)] @ chain.moves) * e
        c = a.sum(axis=1, keepdims=True)
        alphas.append(a / c)
        scales.append(c)
        emitted.append(e)
    moves, gammas = np.zeros((k, k)), []
    beta = np.zeros((0, k))
    for t in range(len(steps) - 1, -1, -1):
        b = np.ones((len(steps[t]), k))
        if len(beta):
            ahead = emitted[t + 1] * beta / scales[t + 1]
            moves += alphas[t][:len(beta)].T @ ahead
            b[:len(beta)] = ahead @ chain.moves.T
        gammas.append(alphas[t] * b)
        beta = b
    moves *= chain.moves
    gammas.reverse()
    g, cls = np.concatenate(gammas), np.concatenate(steps)
    emits = np.stack([np.bincount(cls, weights=g[:, s], minlength=len(chain.emits)) for s in range(k)], axis=1)
    fresh = first[order]
    return gammas[0][fresh].sum(axis=0), g.sum(axis=0), moves, emits


def _gathered(batches, most: int, column: str = "classes"):
    """(batches, classes, begin, size) of rows with some ``most`` tokens."""
    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            held.append(part)
            n += len(part.column(column).flatten())
            if n >= most:
                yield held, *_flat(held, column)
                held, n = [], 0
    if held:
        yield held, *_flat(held, column)


def _flat(held, column):
    lists = [b.column(column) for b in held]
    classes = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
    size = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
    return classes, np.cumsum(size) - size, size


def _segments(begin: np.ndarray, size: np.ndarray, segment: int):
    """Segments of each sequence: (sequence, number in it, begin, size)."""
    parts = np.maximum(1, -(-size // segment))
    seq = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(parts) - parts, parts)
    return seq, nth, begin[seq] + nth * segment, np.minimum(segment, size[seq] - nth * segment)


def _round(chain: Chain):
    def run(batches):
        total = None
        for _, classes, begin, size in _gathered(batches, TRAIN_TOKENS):
            _, nth, b, s = _segments(begin, size, SEGMENT)
            got = _expected(chain, classes, b, s, nth == 0)
            total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
        if total is not None:
            flat = np.concatenate([np.ravel(x) for x in total])
            cell = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(flat[cell])], names=["cell", "v"])
    return run


def train(sequences: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch over all training sequences."""
    chain = first_guess(unigram)
    k, n = len(chain.start), len(unigram)
    for _ in range(rounds):
        sums = sequences.filter("NOT held_out").select("classes").mapInArrow(_round(chain), "cell int, v double")
        cells = sums.groupBy("cell").agg(F.sum("v").alias("v")).toPandas()  # the table's size at most
        flat = np.zeros(2 * k + k * k + n * k)
        flat[cells["cell"].to_numpy()] = cells["v"].to_numpy()
        start, within, moves, emits = np.split(flat, [k, 2 * k, 2 * k + k * k])
        emits = emits.reshape(n, k) + _PSEUDO * (unigram[:, None] + 1e-6)
        share = lambda x: (x + _PSEUDO) / (x + _PSEUDO).sum(axis=-1, keepdims=True)
        chain = Chain(share(start), share(within), share(moves.reshape(k, k)), emits / emits.sum(axis=0))
    return chain


def log_likelihoods(chain: Chain, classes: np.ndarray, begin: np.ndarray, size: np.ndarray,
                    segment: int = SCORE_SEGMENT) -> np.ndarray:
    """log10 likelihood of each class sequence, by the scaled forward
    recursion. Later segments of a sequence run once from every state; their
    transfer matrices are applied in order."""
    k = len(chain.start)
    seq, nth, b, s = _segments(begin, size, segment)
    late = np.flatnonzero(nth > 0)
    run_of = np.concatenate([np.flatnonzero(nth == 0), np.repeat(late, k)])
    order, steps = _by_step(classes, b[run_of], s[run_of])
    alpha = np.concatenate([np.tile(chain.start, ((nth == 0).sum(), 1)), np.tile(chain.moves, (len(late), 1))])[order]
    logs = np.zeros(len(order))
    for t, cls in enumerate(steps):
        m = len(cls)
        a = (alpha[:m] if t == 0 else alpha[:m] @ chain.moves) * chain.emits[cls]
        c = a.sum(axis=1)
        logs[:m] += np.log10(c)
        alpha[:m] = a / c[:, None]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    alpha, logs = alpha[back], logs[back]
    heads = int((nth == 0).sum())
    out, state = logs[:heads].copy(), alpha[:heads]
    later_a, later_log = alpha[heads:].reshape(-1, k, k), logs[heads:].reshape(-1, k)
    for i, x in enumerate(late.tolist()):  # in order of the text
        q = seq[x]
        top = later_log[i].max()
        v = (state[q] * 10.0 ** (later_log[i] - top)) @ later_a[i]
        total = v.sum()
        out[q] += top + np.log10(total)
        state[q] = v / total
    return out


def _scored(chain: Chain):
    def run(batches):
        for held, classes, begin, size in _gathered(batches, SCORE_TOKENS):
            ll, at = log_likelihoods(chain, classes, begin, size), 0
            for b in held:
                part = pa.array(ll[at:at + b.num_rows])
                at += b.num_rows
                cols = [c for c in b.schema.names if c != "classes"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), part], names=[*cols, "chain_score"])
    return run


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    (log10 probability of the whole text, its end included) of every row.

    Learns from rows that are not held out. Null text is empty: its end alone;
    a null id hashes as empty text; rows that repeat count and score each; with
    no training rows every token is unseen; an empty table gives no rows."""
    counts = token_counts(spark, docs)
    words = vocabulary(spark, counts)
    seqs = written(spark, keyed(docs).mapInArrow(_sequences(words), _SEQUENCES), "sequences")
    unigram = np.zeros(words.classes)
    used = (seqs.filter("NOT held_out").select(F.explode("classes").alias("c")).groupBy("c").count()).collect()  # classes
    for r in used:
        unigram[r["c"]] = r["count"]
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()
    chain = train(seqs, unigram)
    kept = _SEQUENCES.replace(", classes array<short>, rare array<long>", "")
    rows = written(spark, seqs.drop("rare").mapInArrow(_scored(chain), kept + ", chain_score double"), "scored")
    # tokens outside the known ones: their counts, by a join over the corpus' table
    rare = seqs.select("k1", "k2", F.explode("rare").alias("token"))
    found = (rare.join(counts.select("token", "n"), "token").groupBy("k1", "k2")
             .agg(F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_log")))
    copies = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    found = found.join(copies, ["k1", "k2"])  # rows that repeat have put their tokens in once each
    rows = rows.join(found, ["k1", "k2"], "left")
    extra = F.coalesce(F.col("rare_log") / F.col("copies"), F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce((F.col("rare_known") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + extra).alias("base_score"),
        (F.col("chain_score") + F.col("inner") + extra).alias("score"))
