"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, by follow-the-regularised-leader with elastic net, then
calibrated by a temperature.

* Features: n-grams of 1 to 3 characters of the lower-cased text, hashed to
  ``BUCKETS``; weights are log-scaled counts times inverse document frequency,
  scaled to unit length.
* Document frequencies cover all training documents (added up by bucket).
* The regression is fitted on some ``SAMPLE`` training documents of each
  language's different texts, however many there are: all of a rarer one, else
  those that a hash of the text picks at the rate SAMPLE / texts. Of every five
  texts of a language one only sets the temperature, and languages of few
  texts are shown more often. The driver's state grows with the languages.
* Every whole text is scored; nothing but the text enters a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm.common import chunks, utf8

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE = 1500
ROUNDS = 2
#: A language of fewer texts is shown about so many times a round.
LEAST_SHOWN = 8
ALPHA, BETA, LASSO, RIDGE = 0.5, 1.0, 0.02, 1e-4
UNKNOWN = "und"
HELD_OUT = (3, 1)
_LETTER = regex.compile(r"\p{L}")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint32)
        for k, n in enumerate(ORDERS):
            if len(c) < n:
                break
            h = h[:len(c) - n + 1] * np.uint32(31) + c[n - 1:] * _MIX[k]
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((x ^ (x >> np.uint32(12))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    c = np.bincount(grams(text), minlength=BUCKETS) if text else np.zeros(BUCKETS, np.int64)
    nz = np.flatnonzero(c)
    return nz, c[nz]


def weighed(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def _rows(batches):
    """(batch, row, text) of every row; null is empty."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in chunks(off, 1 << 21):
            raw = data[off[i]:off[j]].tobytes()
            for r in range(i, j):
                yield batch, r, raw[off[r] - off[i]:off[r + 1] - off[i]].decode("utf-8", "replace")


def _frequencies(batches):
    df, n = np.zeros(BUCKETS + 1, np.int64), 0
    for _, _, text in _rows(batches):
        if text:
            df[np.flatnonzero(np.bincount(grams(text), minlength=BUCKETS))] += 1
        n += 1
    df[BUCKETS] = n  # the documents
    nz = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(nz.astype(np.int32)), pa.array(df[nz])], names=["bucket", "df"])


def _features(batches):
    for batch, r, text in _rows(batches):
        bucket, count = counted(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang").slice(r, 1), pa.array([int(batch.column("luck")[r].as_py())]),
             pa.array([bucket.astype(np.int32)], pa.list_(pa.int32())), pa.array([count.astype(np.int32)], pa.list_(pa.int32()))],
            names=["lang", "luck", "bucket", "count"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """FTRL-proximal, one example at a time: weights (buckets + bias) x classes.
    z and n are the usual sums; a weight is zero while |z| is within the lasso."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        return np.where(np.abs(z[at]) <= LASSO, 0.0,
                        -(z[at] - np.sign(z[at]) * LASSO) / ((BETA + np.sqrt(n[at])) / ALPHA + RIDGE))

    for r in range(rounds):
        for i in np.random.default_rng(r).permutation(len(rows)).tolist():
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(at)
            err = softmax(x @ w)
            err[target[i]] -= 1
            g = x[:, None] * err
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return np.concatenate([weights(np.arange(a, min(a + 1024, BUCKETS + 1))) for a in range(0, BUCKETS + 1, 1024)])


def fit_temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least negative log likelihood, on a log grid."""
    if not len(target):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        return weighed(count, self.idf[bucket]) @ self.weights[bucket] + self.weights[BUCKETS]


def fit(spark: SparkSession, train: DataFrame) -> Model | None:
    """Fit on rows with doc_id, text and lang; None if none has a language."""
    rows = train.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL")
    text = F.xxhash64("text")
    # distinct texts of each language, to some hundredths: a row for each
    counts = {r["lang"]: max(1, r["texts"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(text, 0.02).alias("texts")).collect()}
    if not counts:
        return None
    sums = rows.select("text").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    df = np.zeros(BUCKETS + 1)
    for r in sums.toArrow().to_pylist():  # a row for each bucket
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    # a text's luck, even over 0..1, against its language's share; a text that repeats teaches once
    share = spark.createDataFrame([(lang, min(1.0, SAMPLE / n)) for lang, n in counts.items()], "lang string, share double")
    sample = (rows.withColumn("luck", text).join(F.broadcast(share), "lang").filter(F.col("luck") / 2.0**64 + 0.5 < F.col("share"))
              .select("lang", "luck", "text").dropDuplicates(["lang", "luck"])
              .mapInArrow(_features, "lang string, luck long, bucket array<int>, count array<int>").toArrow())
    place = {x: i for i, x in enumerate(sorted(counts))}
    target = np.array([place[x] for x in sample.column("lang").to_pylist()], np.int64)
    order = np.lexsort((sample.column("luck").to_numpy(), target))
    target = target[order]
    column = lambda c: [x.values.to_numpy() for x in sample.column(c)]
    buckets, counted_ = column("bucket"), column("count")
    feats = [(buckets[i], weighed(counted_[i], idf[buckets[i]])) for i in order.tolist()]
    # every fifth text of a language is set aside for the temperature; one with fewer keeps all
    nth = np.arange(len(target)) - np.searchsorted(target, target, "left")
    aside = nth % 5 == 4
    # a language of few texts is shown as often as one of LEAST_SHOWN
    own = np.bincount(target[~aside], minlength=len(place))
    shown = np.repeat(np.flatnonzero(~aside), -(-LEAST_SHOWN // np.minimum(np.maximum(own, 1), LEAST_SHOWN))[target[~aside]])
    weights = fit_ftrl([feats[i] for i in shown.tolist()], target[shown], len(place))
    logits = np.array([x @ weights[b] + weights[BUCKETS] for (b, x), a in zip(feats, aside, strict=True) if a])
    return Model(sorted(place), idf, weights, fit_temperature(logits, target[aside]))


def _predicted(model: Model | None):
    def run(batches):
        for batch in batches:
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for _, r, text in _rows([batch]):
                if model is None or not _LETTER.search(text):
                    continue
                p = softmax(model.logits(*counted(text)) / model.temperature)
                best = int(p.argmax())
                lang[r], score[r] = model.languages[best], p[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (calibrated probability of the
    predicted language) of every row; ``und`` with score 0 for a text that is
    null or has no letter, and for all if no row had a language to learn."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learn from rows that are not held out and predict all rows. Rows that
    repeat count each; an empty table gives an empty result."""
    return predict(docs, fit(spark, docs.filter(~held_out())))
