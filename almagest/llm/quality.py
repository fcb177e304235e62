"""Quality classifier: a weak-label model over heuristic labellers.

Two judgements are made of each document: is it junk (shouting, symbol noise,
tables of fragments, repetition) and is it toxic. For each:

1. Overlapping labellers vote on every document: heuristics over the whole
   text, lexicons induced from all annotated rows, and the annotators
   themselves where they spoke (table ``labels``).
2. Vote patterns are counted over all documents; expectation-maximisation over
   the patterns (at most 3^labellers of them, whatever the corpus size)
   estimates how each labeller votes on bad and on good documents.
3. The posteriors of all documents train a hashed linear scorer: logistic
   regression over hashed words, word beginnings and binned signals.
4. The scorer judges every document by its whole text.

Features of all rows are found once and written. Lexicon counts and gradients
are summed over them in tasks, by blocks of ``BLOCK`` buckets; the driver holds
the ``BUCKETS`` weights and no rows.

The scorer's lasso leaves nearly all weights at zero, so it is fitted on a
working set: a pass over all features of all documents gives every bucket's
gradient; buckets whose gradient the lasso does not hold join the set, the
strongest first; the quasi-Newton steps run on the documents' features of that
set alone; then the next full pass looks for buckets that the lasso does not
hold now. When there are none, the weights are the optimum over all buckets;
the fit also ends when a round lowers the objective by less than LEAST_FALL of
what it was at first.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm.common import (chunks, doc_key, drop, keyed, lean, lower_ascii, mix64, parallelism, shuffles_end, span_hashes,
                                 utf8, word_spans, written)

BUCKETS = 1 << 20
PREFIX_BYTES = 5
#: Buckets that one row of partial sums holds.
BLOCK = 4_096
#: Bytes of partial sums that the driver adds itself; more are added in tasks, by block.
DRIVER_BYTES = 8 << 20
#: A weight is zero unless the documents' errors pull harder than this.
LASSO = 1.5
#: Share of LASSO that a zero weight's pull may exceed it by, and the buckets that join the working set first (each time twice as many).
TOLERANCE = 0.1
JOIN = 256
#: Most passes over a working set, the least fall of the objective (share of the first) for another full
#: pass, the part of it that five steps on a working set must reach to go on, and the steps they keep.
ROUNDS = 200
LEAST_FALL = 1e-3
STEPS_FALL = 0.3
PAIRS = 5
#: Bytes of narrowed features that a task reads.
NARROW_BYTES = 16 << 20
REJECT_AT = 0.35
#: Share of the annotators' judgements that are taken to be right.
ANNOTATORS_RIGHT = 0.95
SIGNALS = ("caps", "symbols", "bangs", "digits", "repeated_words", "repeated_lines", "long_words", "short_text")
_BINS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8])
#: Where a signal's labeller votes "junk".
JUNK_AT = {"caps": 0.4, "symbols": 0.15, "bangs": 0.15, "repeated_words": 0.65, "repeated_lines": 0.3}
JUNK_LABELLERS = tuple(JUNK_AT)

_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_row(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) pairs without repeats, in row order."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


def analyse(data: np.ndarray, offsets: np.ndarray):
    """For the texts of a chunk: signals (rows x SIGNALS), word counts, and
    the (row, feature hash) pairs, each once a row, in row order."""
    n = len(offsets) - 1
    low = lower_ascii(data)
    starts, ends, rows = word_spans(low, offsets, _IS_WORD[low])
    hashes = span_hashes(low, starts, ends)
    words = np.bincount(rows, minlength=n)
    at_least = np.maximum(words, 1)
    r1, h1 = _distinct(rows, hashes, n)
    distinct = np.bincount(r1, minlength=n)
    line_ends = low == 10
    ls, le, lr = word_spans(low, offsets, ~line_ends)
    full = le - ls > 3
    ls, le, lr = ls[full], le[full], lr[full]
    lines = np.bincount(lr, minlength=n)
    lr1, _ = _distinct(lr, span_hashes(low, ls, le), n)
    letters = _per_row(_IS_LETTER[data], offsets)
    caps = _per_row((data >= 65) & (data <= 90), offsets)
    signals = np.stack([
        caps / np.maximum(letters, 1),
        _per_row(_IS_SYMBOL[data], offsets) / at_least,
        _per_row(data == 33, offsets) / at_least,
        _per_row((data >= 48) & (data <= 57), offsets) / np.maximum(np.diff(offsets), 1),
        np.where(words >= 20, 1 - distinct / at_least, 0),
        np.where(lines >= 4, 1 - np.bincount(lr1, minlength=n) / np.maximum(lines, 1), 0),
        np.bincount(rows, weights=(ends - starts > 24), minlength=n) / at_least,
        np.where(words < 5, 1.0, 0.0),
    ], axis=1)
    long = ends - starts > PREFIX_BYTES
    r2, h2 = _distinct(rows[long], mix64(span_hashes(low, starts[long], starts[long] + PREFIX_BYTES) + np.uint64(7)), n)
    bins = np.searchsorted(_BINS, signals)
    sig = mix64((np.arange(len(SIGNALS)) * 64 + bins + 1).astype(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15))
    r3 = np.repeat(np.arange(n), len(SIGNALS))
    r, h = np.concatenate([r1, r2, r3]), np.concatenate([h1, h2, sig])
    order = np.argsort(r, kind="stable")
    return signals, words, r[order], (h[order] & np.uint64(BUCKETS - 1)).astype(np.int64)


def _analysed(batches: Iterator[pa.RecordBatch]):
    """(batch, from row, to row, analysis) for chunks of each batch."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in chunks(off, 1 << 19):
            yield batch, i, j, analyse(data[off[i]:off[j]], off[i:j + 1] - off[i])


def _features(batches):
    """Heuristic votes and features of all rows: rising buckets as differences
    (little-endian 32-bit), which compress well."""
    for batch, i, j, (signals, _, rows, feats) in _analysed(batches):
        feats = np.sort(rows * BUCKETS + feats) % BUCKETS  # by row, then bucket
        first = np.ones(len(rows), bool)
        first[1:] = rows[1:] != rows[:-1]
        feats[1:] -= np.where(first[1:], 0, feats[:-1])
        votes = np.zeros(j - i, np.int64)
        for b, name in enumerate(JUNK_LABELLERS):
            votes |= (signals[:, SIGNALS.index(name)] > JUNK_AT[name]).astype(np.int64) << b
        ends = np.concatenate([[0], 4 * np.cumsum(np.bincount(rows, minlength=j - i))]).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(feats.astype("<i4"))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(i, j - i), pa.array(votes), lists], names=["doc_id", "votes", "feats"])


def _stored(batches):
    """(batch, from row, to row, rows, feats) for chunks of written features."""
    for batch in batches:
        column = batch.column("feats").cast(pa.large_binary())
        if not len(column):
            continue
        off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        for i, j in chunks(off, 1 << 22):
            size = np.diff(off[i:j + 1]) // 4
            total = np.cumsum(data[off[i]:off[j]].view("<i4"), dtype=np.int64)
            ends = np.cumsum(size)
            before = np.concatenate([[0], total])[ends - size]
            yield batch, i, j, np.repeat(np.arange(j - i), size), total - np.repeat(before, size)


_SUMS = "block int, at binary, sums binary"


def _blocks(sums: np.ndarray, first: int = 0):
    """Rows of the sums (2 x whole blocks) that are not zero, by block."""
    at = np.flatnonzero(sums.any(axis=0))
    cuts = np.searchsorted(at, np.arange(0, sums.shape[1] + 1, BLOCK))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        here = at[cuts[k]:cuts[k + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([first + k], pa.int32()), pa.array([(here - k * BLOCK).astype("<u2").tobytes()]),
             pa.array([sums[:, here].tobytes()])], names=["block", "at", "sums"])


def _read_blocks(rows: list[dict]):
    for r in rows:
        yield r["block"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["sums"]).reshape(2, -1)


def _added(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, at, sums in _read_blocks(batch.to_pylist()):
            held.setdefault(block, np.zeros((2, BLOCK)))[:, at] += sums
    for block, sums in held.items():
        yield from _blocks(sums, block)


def _total(spark: SparkSession, seen: DataFrame, run, width: int = BUCKETS + BLOCK) -> np.ndarray:
    """The sum over all tasks of run's sums (2 x width, whole blocks): a row for
    each of two targets; buckets, then what is not of a bucket. There is a task
    for each core, so that the sums shuffled do not grow with the rows."""
    out = np.zeros((2, width))
    tasks = spark.sparkContext.defaultParallelism
    sums = seen.coalesce(tasks).mapInArrow(lean(run), _SUMS)
    if tasks * (out.nbytes + 2 * width) > DRIVER_BYTES:
        sums = sums.repartition(min(parallelism(spark), width // BLOCK), "block").mapInArrow(lean(_added), _SUMS)
    with shuffles_end(spark):  # a shuffle for each round; nothing reads it again
        rows = sums.toArrow().to_pylist()
    for block, at, part in _read_blocks(rows):
        out[:, block * BLOCK + at] += part
    return out


def _labelled(batches):
    """Rows that hold each bucket, and rows, of those called toxic and not."""
    sums = np.zeros((2, BUCKETS + BLOCK))
    for batch, i, j, rows, feats in _stored(batches):
        said = batch.column("said_toxic").slice(i, j - i).to_numpy()
        for k in (0, 1):
            of = said == k + 1
            sums[k, :BUCKETS] += np.bincount(feats[of[rows]], minlength=BUCKETS)
            sums[k, BUCKETS] += of.sum()
    yield from _blocks(sums)


def lexicon(of_bad: np.ndarray, of_good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """Marks the features that are typical of the bad rows: in 199 of 200
    of the rows that hold them (after levelling the classes' sizes), with a log
    likelihood ratio that chance over all buckets does not give."""
    n_bad, n_good = max(1, n_bad), max(1, n_good)
    both, base = np.maximum(of_bad + of_good, 1), n_bad / (n_bad + n_good)
    p = np.clip(of_bad / both, 1e-9, 1 - 1e-9)
    llr = of_bad * np.log(p / base) + of_good * np.log((1 - p) / (1 - base))
    return (of_bad / n_bad > 200 * of_good / n_good) & (llr > np.log(BUCKETS) + 4)


@dataclass
class VoteModel:
    """Shares of the classes (good, then a kind of bad for each heuristic) and
    P(vote | class) of each labeller: [labeller, class, vote]."""

    shares: np.ndarray
    table: np.ndarray

    @property
    def prior(self) -> float:
        return float(1 - self.shares[0])

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """P(class | votes) for rows of votes (rows x labellers)."""
        score = np.tile(np.log(self.shares), (len(votes), 1))
        for k in range(votes.shape[1]):
            score += np.log(self.table[k][:, votes[:, k]]).T
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(bad | votes)."""
        return 1 - self.classes(votes)[:, 0]


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> VoteModel:
    """EM over vote patterns. votes: patterns x labellers, each 0 (silent),
    1 (bad) or 2 (good); counts: documents of each pattern. The annotators are
    the last labeller; their accuracy is held at ANNOTATORS_RIGHT, which ties
    the latent classes to their meaning. A document is good or of a kind of bad
    that starts from one heuristic's votes: kinds of junk that exclude each
    other would not fit one class of independent votes."""
    told, kinds = votes[:, -1], votes.shape[1] - 1
    said = (votes[:, :-1] == 1).astype(float)
    spread = np.where(said.any(axis=1, keepdims=True), said, 1.0)
    spread /= spread.sum(axis=1, keepdims=True)
    bad = np.where(told == 1, ANNOTATORS_RIGHT, np.where(told == 2, 1 - ANNOTATORS_RIGHT, np.where(said.any(axis=1), 0.7, 0.05)))
    post = np.column_stack([1 - bad, spread * bad[:, None]])
    model = VoteModel(np.full(kinds + 1, 1 / (kinds + 1)), np.full((kinds + 1, kinds + 1, 3), 1 / 3))
    for _ in range(rounds if len(votes) else 0):
        weight = (post * counts[:, None]).T
        shares = weight.sum(axis=1) + 1
        table = np.stack([np.stack([np.bincount(votes[:, k], weights=w, minlength=3) for w in weight]) + 0.1
                          for k in range(kinds + 1)])
        table /= table.sum(axis=2, keepdims=True)
        # of those the annotators spoke on; being asked says nothing of the class
        right, wrong = ANNOTATORS_RIGHT / 2, (1 - ANNOTATORS_RIGHT) / 2
        table[-1] = [[0.5, wrong, right]] + [[0.5, right, wrong]] * kinds
        model = VoteModel(shares / shares.sum(), table)
        post = model.classes(votes)
        # where annotators spoke, their word outweighs heuristics that err together
        bad = 1 - post[:, 0]
        held = np.where(told == 1, np.maximum(bad, ANNOTATORS_RIGHT), np.where(told == 2, np.minimum(bad, 1 - ANNOTATORS_RIGHT), bad))
        post[:, 1:] *= (held / np.maximum(bad, 1e-12))[:, None]
        post[:, 0] = 1 - held
    return model


def descend(x: np.ndarray, lasso: np.ndarray, rounds: int, least: float | None = None) -> Generator:
    """Least loss + lasso * |x| by orthant-wise limited-memory quasi-Newton.
    Yields a point, is sent (loss, gradient) there; returns the best point, when
    five steps lower the objective by no more than ``least``."""
    loss, g = yield x
    best = loss + lasso @ np.abs(x)
    were = [best]
    pairs: deque = deque(maxlen=PAIRS)
    while (rounds := rounds - 1) > 0:
        pull = np.where(x == 0, np.sign(g) * np.maximum(np.abs(g) - lasso, 0), g + lasso * np.sign(x))
        d, seen = -pull, []
        for s, y in reversed(pairs):
            seen.append(s @ d / (s @ y))
            d = d - seen[-1] * y
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]))
        for (s, y), c in zip(pairs, reversed(seen), strict=True):
            d = d + (c - y @ d / (s @ y)) * s
        d[d * pull >= 0] = 0
        side = np.where(x == 0, -np.sign(pull), np.sign(x))
        step = 1.0 if pairs else 1 / max(np.sqrt(pull @ pull), 1e-12)
        while rounds > 0 and step > 1e-6:
            to = x + step * d
            to[(lasso > 0) & (np.sign(to) != side)] = 0
            loss, g_to = yield to
            now = loss + lasso @ np.abs(to)
            if now <= best + 1e-4 * (pull @ (to - x)):
                break
            step, rounds = step / 2, rounds - 1
        else:
            return x
        s, y = to - x, g_to - g
        x, g, best = to, g_to, now
        if s @ y > 1e-10:
            pairs.append((s, y))
        were.append(best)
        if len(were) > 5 and were[-6] - best <= (LEAST_FALL * were[0] if least is None else least):
            return x
    return x


def fit_scorer(full: Callable, narrowed: Callable, mean: np.ndarray, lasso: float = LASSO) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions on soft targets, one for each of two targets, whose
    means are ``mean``. full(weights, bias, going) gives, over all documents, the
    sums by bucket, then those of bias and loss, of the targets still going;
    narrowed(buckets) gives such a function for weights of these buckets alone,
    and one that ends it. The lasso keeps features at zero that fewer than some
    two misjudged documents speak for, so words of single documents stay out."""
    weights, bias = np.zeros((2, BUCKETS)), np.log((mean + 1e-3) / (1 - mean + 1e-3))
    going, join, were = [True, True], JOIN, ([], [])
    while True:
        sums, sets = full(weights, bias, going), {}
        for k in (k for k in (0, 1) if going[k]):
            were[k].append(sums[k, BUCKETS + 1] + lasso * np.abs(weights[k]).sum())
            loose = np.abs(sums[k, :BUCKETS]) - lasso * (1 + TOLERANCE)
            loose[weights[k] != 0] = 0
            new = np.flatnonzero(loose > 0)
            going[k] = len(new) > 0 and (len(were[k]) < 2 or were[k][-2] - were[k][-1] > LEAST_FALL * were[k][0])
            if going[k]:
                new = new[np.argsort(-loose[new], kind="stable")[:join]]
                sets[k] = np.union1d(np.flatnonzero(weights[k]), new)
        if not sets:
            return weights.astype(np.float32), bias
        join *= 2
        among = np.unique(np.concatenate(list(sets.values())))
        gradient, end = narrowed(among)
        at = {k: np.searchsorted(among, own) for k, own in sets.items()}
        fits = {k: descend(np.append(weights[k, own], bias[k]), np.append(np.full(len(own), lasso), 0.0), ROUNDS,
                           STEPS_FALL * LEAST_FALL * were[k][0])
                for k, own in sets.items()}
        points = {k: next(f) for k, f in fits.items()}
        while fits:
            w, b = np.zeros((2, len(among))), np.zeros(2)
            for k in fits:
                w[k, at[k]], b[k] = points[k][:-1], points[k][-1]
            sums = gradient(w, b, [k in fits for k in (0, 1)])
            for k in list(fits):
                try:
                    points[k] = fits[k].send((sums[k, len(among) + 1], sums[k, np.append(at[k], len(among))]))
                except StopIteration as done:
                    points[k] = done.value
                    del fits[k]
        end()
        for k, own in sets.items():
            weights[k], bias[k] = 0.0, points[k][-1]
            weights[k, own] = points[k][:-1]


def _chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _gradient(state):
    """Sums of the two targets' errors by bucket, over rows, and of the loss.
    state: a broadcast of weights, bias, which targets to sum, the posterior of
    each vote pattern for both, and the toxic lexicon."""
    def run(batches):
        weights, bias, going, post_junk, post_toxic, typical = state.value
        sums = np.zeros((2, BUCKETS + BLOCK))
        for batch, i, j, rows, feats in _stored(batches):
            votes, junk, toxic = (batch.column(c).slice(i, j - i).to_numpy() for c in ("votes", "said_junk", "said_toxic"))
            for k in (k for k in (0, 1) if going[k]):
                target = post_toxic[_votes(typical, rows, feats, j - i), toxic] if k else post_junk[votes, junk]
                z = np.bincount(rows, weights=weights[k][feats], minlength=j - i) + bias[k]
                err = _chance(z) - target
                sums[k, :BUCKETS] += np.bincount(feats, weights=err[rows], minlength=BUCKETS)
                sums[k, BUCKETS:BUCKETS + 2] += err.sum(), (np.logaddexp(0, z) - target * z).sum()
        yield from _blocks(sums)
    return run


def _narrowed(among: np.ndarray, state):
    """For chunks of rows: places in ``among`` of the features that are there,
    how many of them each row has, and the rows' targets."""
    def run(batches):
        _, _, _, post_junk, post_toxic, typical = state.value
        place = np.full(BUCKETS, -1, np.int32)
        place[among] = np.arange(len(among))
        for batch, i, j, rows, feats in _stored(batches):
            votes, junk, toxic = (batch.column(c).slice(i, j - i).to_numpy() for c in ("votes", "said_junk", "said_toxic"))
            at = place[feats]
            there = at >= 0
            per = np.bincount(rows[there], minlength=j - i)
            targets = post_junk[votes, junk], post_toxic[_votes(typical, rows, feats, j - i), toxic]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (at[there].astype("<i4"), per.astype("<i4"), *targets)],
                                             names=["feats", "per", "junk", "toxic"])
    return run


def _narrow_gradient(state, m: int):
    """As :func:`_gradient`, over narrowed rows and the weights of m buckets."""
    def run(batches):
        weights, bias, going = state.value
        sums = np.zeros((2, -(-(m + 2) // BLOCK) * BLOCK))
        for batch in batches:
            for row in batch.to_pylist():
                feats, per = np.frombuffer(row["feats"], "<i4"), np.frombuffer(row["per"], "<i4")
                rows = np.repeat(np.arange(len(per)), per)
                for k in (k for k in (0, 1) if going[k]):
                    target = np.frombuffer(row["toxic" if k else "junk"])
                    z = np.bincount(rows, weights=weights[k][feats], minlength=len(per)) + bias[k]
                    err = _chance(z) - target
                    sums[k, :m] += np.bincount(feats, weights=err[rows], minlength=m)
                    sums[k, m:m + 2] += err.sum(), (np.logaddexp(0, z) - target * z).sum()
        yield from _blocks(sums)
    return run


def _scored(weights: np.ndarray, bias: np.ndarray):
    def run(batches):
        for batch, i, j, rows, feats in _stored(batches):
            p = [_chance(np.bincount(rows, weights=w[feats], minlength=j - i) + b) for w, b in zip(weights, bias, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, p)],
                                             names=["doc_id", "junk_score", "toxic_score"])
    return run


@dataclass
class Scorer:
    weights: np.ndarray
    bias: np.ndarray
    junk: VoteModel
    toxic: VoteModel


def _annotations(labels: DataFrame) -> DataFrame:
    """k1, quality (0 if any row says so), toxic (1 if any row says so)."""
    return labels.filter("doc_id IS NOT NULL").groupBy(doc_key().alias("k1")).agg(
        F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))


def features(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, said_junk, said_toxic, votes and feats of every row, written. The
    join with the annotations moves features, which are smaller than texts."""
    found = keyed(docs).select("doc_id", "text").mapInArrow(lean(_features), "doc_id long, votes long, feats binary")
    marked = found.withColumn("k1", doc_key()).join(_annotations(labels), "k1", "left").select(
        "doc_id", F.expr("CASE WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 2 ELSE 0 END").alias("said_junk"),
        F.expr("CASE WHEN toxic = 1 THEN 1 WHEN toxic = 0 THEN 2 ELSE 0 END").alias("said_toxic"), "votes", "feats")
    return written(spark, marked, "features")


def fit(spark: SparkSession, seen: DataFrame) -> Scorer:
    """Fit the vote models and the scorer on the features of all documents."""
    # junk: heuristic votes over all documents
    patterns = seen.groupBy("votes", "said_junk").count().toPandas()
    heard = lambda v, said: np.stack([*((v >> b) & 1 for b in range(len(JUNK_LABELLERS))), said], axis=1).astype(int)
    junk = fit_votes(heard(patterns["votes"].to_numpy(), patterns["said_junk"].to_numpy()), patterns["count"].to_numpy())
    post_junk = _posteriors(junk, 1 << len(JUNK_LABELLERS), heard)
    # toxic: two lexicons from halves of the features, then their counts over all documents
    told = _total(spark, seen.select("said_toxic", "feats").filter("said_toxic > 0"), _labelled)
    typical = lexicon(told[0, :BUCKETS], told[1, :BUCKETS], told[0, BUCKETS], told[1, BUCKETS])
    toxic_seen = seen.select("said_toxic", "feats").mapInArrow(lean(_lexicon_votes(typical)), "lex long, said int, n long").groupBy(
        "lex", "said").agg(F.sum("n").alias("count")).toPandas()
    split = lambda lex, said: np.stack([lex & 1, (lex >> 1) & 1, (lex >> 2) & 1, said], axis=1).astype(int)
    toxic = fit_votes(split(toxic_seen["lex"].to_numpy(), toxic_seen["said"].to_numpy()), toxic_seen["count"].to_numpy())
    post_toxic = _posteriors(toxic, 8, split)
    if not len(patterns):
        return Scorer(np.zeros((2, BUCKETS), np.float32), np.full(2, -10.0), junk, toxic)
    mean = np.array([np.average(post_junk[patterns["votes"], patterns["said_junk"]], weights=patterns["count"]),
                     np.average(post_toxic[toxic_seen["lex"], toxic_seen["said"]], weights=toxic_seen["count"])])

    rows = seen.select("votes", "said_junk", "said_toxic", "feats")

    def held(run: Callable, *state):
        """run with a broadcast of state, which then goes."""
        sent = spark.sparkContext.broadcast(state)
        try:
            return run(sent)
        finally:
            sent.destroy()

    def full(w: np.ndarray, b: np.ndarray, going: list[bool]) -> np.ndarray:
        return held(lambda sent: _total(spark, rows, _gradient(sent)), w.astype(np.float32), b, going, post_junk, post_toxic, typical)

    def narrowed(among: np.ndarray) -> tuple[Callable, Callable]:
        few = held(lambda sent: written(spark, rows.mapInArrow(
            lean(_narrowed(among, sent)), "feats binary, per binary, junk binary, toxic binary"), "narrowed"), None, None, None, post_junk, post_toxic, typical)
        size = few.agg(F.sum(F.octet_length("feats") + F.octet_length("junk") * 2)).first()[0] or 0
        parts = few.coalesce(int(-(-size // NARROW_BYTES)) or 1)  # it is read many times
        width = -(-(len(among) + 2) // BLOCK) * BLOCK

        def gradient(w: np.ndarray, b: np.ndarray, going: list[bool]) -> np.ndarray:
            return held(lambda sent: _total(spark, parts, _narrow_gradient(sent, len(among)), width), w, b, going)
        return gradient, lambda: drop(spark, few)

    weights, bias = fit_scorer(full, narrowed, mean)
    return Scorer(weights, bias, junk, toxic)


def _posteriors(model: VoteModel, patterns: int, heard: Callable) -> np.ndarray:
    """P(bad) of each pattern of votes (rows) and what was said (columns)."""
    votes, said = np.divmod(np.arange(patterns * 3), 3)
    return model.posterior(heard(votes, said)).reshape(patterns, 3)


def _votes(typical: np.ndarray, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
    """Three lexicon labellers: a hit among the even buckets, among the odd
    ones, and two hits or more."""
    hit = typical[feats]
    rows, odds = rows[hit], feats[hit] % 2 == 1
    even, odd = np.bincount(rows[~odds], minlength=n), np.bincount(rows[odds], minlength=n)
    return (even > 0) * 1 + (odd > 0) * 2 + (even + odd > 1) * 4


def _lexicon_votes(typical: np.ndarray):
    def run(batches):
        counts = np.zeros((8, 3), np.int64)
        for batch, i, j, rows, feats in _stored(batches):
            said = batch.column("said_toxic").slice(i, j - i).to_numpy()
            np.add.at(counts, (_votes(typical, rows, feats, j - i), said), 1)
        lex, said = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lex), pa.array(said.astype(np.int32)), pa.array(counts[lex, said])],
                                         names=["lex", "said", "n"])
    return run


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, junk_score, toxic_score, kept for every row.

    Null or empty text counts as text without words; an empty table of
    documents gives an empty result, an empty table of labels leaves the
    heuristics alone to teach the scorer; repeated rows get equal scores."""
    seen = features(spark, docs, labels)
    model = fit(spark, seen)
    scores = seen.select("doc_id", "feats").mapInArrow(
        lean(_scored(model.weights, model.bias)), "doc_id long, junk_score double, toxic_score double")
    return scores.withColumn("kept", (F.col("junk_score") < REJECT_AT) & (F.col("toxic_score") < REJECT_AT))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' columns."""
    seen = features(spark, docs, labels)
    model = fit(spark, seen)
    drop(spark, seen)
    cols = [f"`{c}`" for c in docs.columns]
    weights, bias = model.weights, model.bias

    def run(batches):
        for batch, i, j, (_, _, rows, feats) in _analysed(batches):
            logits = [np.bincount(rows, weights=w[feats], minlength=j - i) + b for w, b in zip(weights, bias, strict=True)]
            yield batch.slice(i, j - i).filter(pa.array(np.maximum(*logits) < np.log(REJECT_AT / (1 - REJECT_AT))))

    return docs.withColumn("text", F.col("text").cast("string")).select(*cols).mapInArrow(lean(run), docs.withColumn(
        "text", F.col("text").cast("string")).schema)
