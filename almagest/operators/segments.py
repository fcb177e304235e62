"""Respondent segmentation.

Feature matrix by column expressions over the parsed record; one-hot
domains (top-N nationality / purpose / accommodation) come from a ranked
aggregate joined back by code, so no category value is pulled to the
driver. Model: pyspark.ml Imputer(median), standardisation by one aggregate,
KMeans; K is chosen in 2..8 by silhouette (squared Euclidean, linear in rows,
unlike a pairwise silhouette), then ten seeds are fitted for that K. Fits of
one kind run in step, so that a pass over the rows serves them all, the draws
of first centres included. Clusters are relabelled 0..K-1 by mean spend so ids
are stable.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import Imputer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions import scalars as X
from almagest.operators import sinks as K
from almagest.operators import survey as U
from almagest.sources.canonical import ACTIVITY_KEYS, IMPORTANCE_KEYS

NUMERIC = ["edad", "gasto_euros", "noches", "coste_vuelos_euros", "coste_aloj_euros", "personas"]
# One-hot domain sizes (top-N categories per column).
ONE_HOT = (("nacionalidad", 10), ("proposito", 5), ("aloj_categ", 6))
KEY = ["quarter", "cuestionario"]


def feature_columns() -> list[str]:
    cols = list(NUMERIC)
    cols += [f"imp_{k[len('IMPORTANCIA_'):].lower()}" for k in IMPORTANCE_KEYS]
    cols += [f"act_{k[len('ACTIV_'):].lower()}" for k in ACTIVITY_KEYS]
    cols += ["satisfaccion_n"]
    cols += [f"{c}_top{i}" for c, n in ONE_HOT for i in range(1, n + 1)]
    return cols


def features(micro: DataFrame) -> DataFrame:
    """One row per respondent with ~66 numeric features (NULL where the
    answer is missing; imputation is the model's job). The one-hot ranks are
    attached by broadcast joins of the (<= N row) top-code tables, then every
    feature is built in a single projection."""
    m = U.parse_raw(micro)
    for c, n in ONE_HOT:
        top = U.top_codes(micro, c, n).select(F.col(c).alias(f"_{c}"), F.col("rank").alias(f"_{c}_rank"))
        m = m.join(F.broadcast(top), F.col(c) == F.col(f"_{c}"), "left")  # <= n rows
    cols = [F.col(k) for k in KEY]
    cols += [F.col(c).cast("double").alias(c) for c in NUMERIC if c != "personas"]
    cols += [X.safe_float(F.col("raw.PERSONAS_TOTAL")).alias("personas")]
    cols += [X.importance_score(F.col(f"raw.{k}")).alias(f"imp_{k[len('IMPORTANCIA_'):].lower()}")
             for k in IMPORTANCE_KEYS]
    cols += [X.binary_flag(F.col(f"raw.{k}")).alias(f"act_{k[len('ACTIV_'):].lower()}") for k in ACTIVITY_KEYS]
    cols += [X.safe_float(F.col("satisfaccion")).alias("satisfaccion_n")]
    cols += [F.when(F.col(f"_{c}_rank") == i, 1.0).otherwise(0.0).alias(f"{c}_top{i}")
             for c, n in ONE_HOT for i in range(1, n + 1)]
    return m.select(*cols)


def _whole(c: str) -> bool:
    """Scores, flags and one-hot columns: 0..3."""
    return c.startswith(("imp_", "act_")) or "_top" in c


def narrow(feat: DataFrame) -> DataFrame:
    """The features as they are kept: scores, flags and one-hot columns take a
    byte each instead of eight, so that all rows stay in memory."""
    return feat.select(*KEY, *[F.col(c).cast("tinyint").alias(c) if _whole(c) else c for c in feature_columns()])


def scaled(feat: DataFrame) -> DataFrame:
    """Median imputation + standardisation -> ``features``. ``feat`` is
    read twice (medians; means and deviations) and should be persisted. Flags
    and one-hot columns have no missing values, so no median is sought."""
    cols = feature_columns()
    wide = feat.select(*KEY, *[F.col(c).cast("double").alias(c) for c in cols])
    gaps = [c for c in cols if not (c.startswith("act_") or "_top" in c)]
    model = Imputer(inputCols=gaps, outputCols=[f"{c}__i" for c in gaps], strategy="median").fit(wide)
    imputed = model.transform(wide)
    value = {c: F.col(f"{c}__i" if c in gaps else c) for c in cols}
    # Sums about the median (0 for flags), so that deviations keep their digits.
    middle = dict(zip(gaps, model.surrogateDF.first(), strict=True))
    off = {c: v - F.lit(middle.get(c, 0.0)) for c, v in value.items()}
    sums = imputed.agg(F.count(F.lit(1)), *[F.sum(p) for d in off.values() for p in (d, d * d)]).first()
    if not all(map(math.isfinite, sums[1::2])):
        raise ValueError("features must be finite numbers")
    n, x = sums[0], []
    for c, first, square in zip(cols, sums[1::2], sums[2::2], strict=True):
        deviation = math.sqrt(max(0.0, square - first * first / n) / max(1, n - 1))
        x.append((off[c] - F.lit(first / n)) * F.lit(1.0 / deviation if deviation else 0.0))  # a constant becomes 0
    return imputed.select(*KEY, array_to_vector(F.array(*x)).alias("features"), "gasto_euros", "edad", "noches")


#: Fits whose first centres are drawn side by side; each is a few short jobs.
FITS_AT_ONCE = 4
MAX_ITER, TOL = 300, 1e-4


def _kmeans(k: int, seed: int, max_iter: int = MAX_ITER) -> KMeans:
    return KMeans(k=k, seed=seed, maxIter=max_iter, tol=TOL, featuresCol="features")


def _fit(data: DataFrame, k: int, seed: int) -> KMeansModel:
    return _kmeans(k, seed).fit(data)


#: Rows up to which pyspark.ml draws the first centres from all rows itself.
WHOLE_DRAW = 100_000
#: Rounds of k-means||; each draws twice as many candidates as there are centres.
ROUNDS, OVERSAMPLING = 2, 2


def _first_centres(data: DataFrame, fits: list[tuple[int, int]], blocks=None) -> list[np.ndarray]:
    """First centres (k-means||, over all partitions) for each (k, seed). On
    few rows pyspark.ml draws them, fit by fit, about eight passes each; on
    many the rounds of all fits share their passes over ``blocks``."""
    if blocks is not None and data.count() > WHOLE_DRAW:
        return [_settled(*c, *f) for c, f in zip(_candidates(blocks, fits), fits, strict=True)]
    draw = inheritable_thread_target(data.sparkSession)(lambda f: np.array(_kmeans(*f, max_iter=0).fit(data).clusterCenters()))
    with ThreadPool(FITS_AT_ONCE) as pool:
        return pool.map(draw, fits)


def _candidates(blocks, fits: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """k-means|| of several fits in step: one row at random, then in each round
    rows drawn with chances in proportion to their squared distance from what
    was drawn before. A row's key is an exponential number over its chance, and
    the least keys win, so that a round is one pass. Returns each fit's
    candidates and the numbers of rows nearest to them."""
    found: list[np.ndarray] = []
    for step in range(ROUNDS + 1):
        most = [OVERSAMPLING * k if step else 1 for k, _ in fits]

        def part(index, xs, step=step, most=most, found=tuple(found)):
            rngs, best = [np.random.default_rng([seed, k, step, index]) for k, seed in fits], None
            for x in xs:
                chances = [d for _, d in _nearest(x, found)] if step else [np.ones(len(x))] * len(fits)
                with np.errstate(divide="ignore", invalid="ignore"):
                    keys = [r.standard_exponential(len(x)) / c for r, c in zip(rngs, chances, strict=True)]
                drawn = [_least(key, x, n) for key, n in zip(keys, most, strict=True)]
                best = drawn if best is None else _drawn(best, drawn, most)
            return [] if best is None else [best]
        rounds = blocks.mapPartitionsWithIndex(part).treeReduce(lambda a, b, most=most: _drawn(a, b, most))
        found = [np.concatenate([f, rows]) for f, (_, rows) in zip(found, rounds, strict=True)] if found else [rows for _, rows in rounds]
    return list(zip(found, _totals(blocks, lambda x: [m.sum(axis=0) for m, _ in _nearest(x, found)]), strict=True))


def _settled(rows: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The last step of k-means||, on a few dozen candidates: weighted
    k-means++ and Lloyd's iterations. Fewer candidates than ``k`` all stay."""
    rows, same = np.unique(rows, axis=0, return_inverse=True)
    w, rng = np.maximum(np.bincount(same.ravel(), weights), 1.0), np.random.default_rng(seed)
    if len(rows) <= k:
        return rows
    far = lambda c: ((rows[:, None] - c[None]) ** 2).sum(axis=2)
    c = rows[[rng.choice(len(rows), p=w / w.sum())]]
    while len(c) < k:
        chances = far(c).min(axis=1) * w
        c = np.vstack([c, rows[rng.choice(len(rows), p=chances / chances.sum())]])
    for _ in range(30):
        m = (far(c).argmin(axis=1)[:, None] == np.arange(k)) * w[:, None]
        n = m.sum(axis=0)[:, None]
        c = np.where(n > 0, m.T @ rows / np.maximum(n, 1.0), c)
    return c


def _least(keys: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` least finite keys and their rows."""
    at = np.argsort(keys, kind="stable")[:n] if len(keys) <= 4 * n else np.argpartition(keys, n)[:n]
    at = at[np.isfinite(keys[at])]
    return keys[at], x[at]


def _drawn(a: list, b: list, most: list[int]) -> list:
    return [_least(np.concatenate([i, k]), np.concatenate([x, y]), n) for (i, x), (k, y), n in zip(a, b, most, strict=True)]


def _blocks(data: DataFrame):
    """The features as matrices of some thousand rows, kept once for all fits."""
    def pack(batches):
        for b in batches:
            x = b.column(0).combine_chunks() if hasattr(b.column(0), "combine_chunks") else b.column(0)
            if len(x):
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int32()), "x": pa.array([x.flatten().to_numpy().tobytes()], pa.binary())})
    packed = data.select(vector_to_array("features").alias("x")).mapInArrow(pack, "n int, x binary")
    return packed.rdd.map(lambda r: np.frombuffer(r.x).reshape(r.n, -1)).persist(StorageLevel.MEMORY_AND_DISK)


def _totals(blocks, rows, depth: int = 2):
    """Sum of ``rows(matrix)`` (lists of arrays) over all matrices."""
    def part(xs):
        total = None
        for x in xs:
            found = rows(x)
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        return [] if total is None else [total]
    return blocks.mapPartitions(part).treeReduce(lambda a, b: [x + y for x, y in zip(a, b, strict=True)], depth)


def _nearest(x: np.ndarray, centres: list[np.ndarray]):
    """For each set of centres: the rows' nearest centre (the first of equals)
    as a 0/1 matrix, and the squared distances to it."""
    far = (x * x).sum(axis=1)
    every = np.concatenate(centres)
    dist = (every * every).sum(axis=1) - 2.0 * (x @ every.T)
    at = 0
    for c in centres:
        d = dist[:, at:at + len(c)]
        at += len(c)
        own = d.argmin(axis=1)
        yield (own[:, None] == np.arange(len(c))).astype(float), np.maximum(far + d[np.arange(len(x)), own], 0.0)


def _together(blocks, starts: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Lloyd's iterations of several fits in step: a pass over the rows serves
    all fits that still move. Stops a fit like pyspark.ml (all centres within
    ``TOL`` of the last ones, or ``MAX_ITER``); an empty cluster keeps its
    centre. Returns centres and costs."""
    centres, moving = [c.copy() for c in starts], list(range(len(starts)))
    for _ in range(MAX_ITER):
        if not moving:
            break
        now = [centres[i] for i in moving]
        sums = _totals(blocks, lambda x, now=now: [np.column_stack([m.T @ x, m.sum(axis=0)]) for m, _ in _nearest(x, now)])
        still = []
        for i, s in zip(moving, sums, strict=True):
            n = s[:, -1:]
            new = np.where(n > 0, s[:, :-1] / np.maximum(n, 1), centres[i])
            if (((new - centres[i]) ** 2).sum(axis=1) > TOL * TOL).any():
                still.append(i)
            centres[i] = new
        moving = still
    costs = _totals(blocks, lambda x: [np.array([d.sum() for _, d in _nearest(x, centres)])])[0]
    return centres, costs.tolist()


def _silhouettes(blocks, centres: list[np.ndarray]) -> list[float]:
    """Mean silhouette (squared Euclidean) of each clustering, from the
    clusters' sizes, sums and sums of squares: two passes, linear in rows."""
    def sizes(x):
        far = (x * x).sum(axis=1)
        return [np.column_stack([m.T @ x, m.T @ far, m.sum(axis=0)]) for m, _ in _nearest(x, centres)]
    stats = _totals(blocks, sizes)

    def rows(x):
        far, out = (x * x).sum(axis=1), []
        for (m, _), s in zip(_nearest(x, centres), stats, strict=True):
            n = s[:, -1]
            mean = far[:, None] + (s[:, -2] - 2.0 * (x @ s[:, :-2].T)) / np.maximum(n, 1)
            own, size = (mean * m).sum(axis=1), m @ n
            a = own * size / np.maximum(size - 1, 1)
            b = np.where((m > 0) | (n == 0), np.inf, mean).min(axis=1)
            top = np.maximum(a, b)
            alone = (size <= 1) | ~np.isfinite(b) | (top == 0)
            out.append(np.array([np.where(alone, 0.0, (b - a) / np.where(alone, 1.0, top)).sum(), float(len(x))]))
        return out
    return [float(s / n) for s, n in _totals(blocks, rows)]


class Summary(NamedTuple):
    trainingCost: float


class Segments(NamedTuple):
    """Centres as a model of pyspark.ml, and what they cost over all rows."""
    model: KMeansModel
    summary: Summary

    def clusterCenters(self) -> list[np.ndarray]:
        return self.model.clusterCenters()

    def transform(self, data: DataFrame) -> DataFrame:
        return self.model.transform(data)


def _model(data: DataFrame, centres: np.ndarray) -> KMeansModel:
    """A model of pyspark.ml with given centres: a random start over just these
    rows takes them all, and no iteration moves them."""
    rows = data.sparkSession.createDataFrame([(Vectors.dense(c),) for c in centres], ["features"]).coalesce(1)
    return _kmeans(max(2, len(centres)), 0, max_iter=0).setInitMode("random").fit(rows)


def fit_segments(data: DataFrame, k: int, seed: int = 42, restarts: int = 10, blocks=None) -> Segments:
    """The K-means clustering of least cost of ``restarts`` seeds (the
    first of equals). First centres are drawn over all partitions (k-means||);
    all seeds run in step, and the best becomes a model of pyspark.ml."""
    own = blocks if blocks is not None else _blocks(data)
    try:
        centres, costs = _together(own, _first_centres(data, [(k, seed + r) for r in range(restarts)], own))
    finally:
        if blocks is None:
            own.unpersist()
    best = int(np.argmin(costs))
    return Segments(_model(data, centres[best]), Summary(costs[best]))


def choose(data: DataFrame, k_min: int = 2, k_max: int = 8, seed: int = 42, blocks=None) -> int:
    """The K with the best silhouette (squared Euclidean; the smallest of
    equals) of one fit for each, all in step; K stays below the row count, and
    is 2 for fewer than 3 rows."""
    ks = list(range(k_min, min(k_max, data.count() - 1) + 1)) or [2]
    if len(ks) == 1:
        return ks[0]
    own = blocks if blocks is not None else _blocks(data)
    try:
        centres, _ = _together(own, _first_centres(data, [(k, seed) for k in ks], own))
        scores = _silhouettes(own, centres)
    finally:
        if blocks is None:
            own.unpersist()
    return ks[int(np.argmax(scores))]


def relabel_by_spend(labeled: DataFrame, label: str = "prediction") -> DataFrame:
    """New id = rank of the cluster's mean spend (ties by old id),
    computed on the <= K aggregated rows and joined back by old id."""
    g = labeled.groupBy(label).agg(F.avg("gasto_euros").alias("_spend"))
    w = Window.orderBy(F.col("_spend").asc_nulls_first(), F.col(label).asc())  # <= K rows
    m = g.select(label, (F.row_number().over(w) - 1).alias("cluster_id"))
    return labeled.join(F.broadcast(m), label).drop(label)


def segment(micro: DataFrame, k: int | None = None, seed: int = 42, restarts: int = 10) -> DataFrame:
    """Features -> scaled -> K (auto when None) -> K-means -> stable ids;
    returns (quarter, cuestionario, cluster_id) for every respondent (K06
    joins them back by key, never by position)."""
    kept = narrow(features(micro)).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = own = None
    try:
        data = scaled(kept)
        blocks = _blocks(data)
        model = fit_segments(data, k or choose(data, seed=seed, blocks=blocks), seed, restarts, blocks)
        own = model.transform(data).select(*KEY, "gasto_euros", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
        labels = relabel_by_spend(own).select(*KEY, "cluster_id").checkpoint(eager=True)
    finally:
        for x in (blocks, kept, own):
            if x is not None:
                x.unpersist()
    return labels


def refresh(micro: DataFrame, labels: DataFrame, root: str, code_labels: dict[str, DataFrame] | None = None) -> DataFrame:
    """What follows a training: labels joined back to the respondents by
    key (K06) and the table of profiles written anew as a whole (K05). Returns
    the stored profiles."""
    K.overwrite_table(profiles(K.label_back(coded(micro), labels, KEY), code_labels), f"{root}/profiles")
    return micro.sparkSession.read.parquet(f"{root}/profiles")


# --------------------------------------------------------------------------
# Profiles (M18, Q14, A10-A16, F11)
# --------------------------------------------------------------------------

#: Dimensions whose most frequent answers a profile names, and how many.
TOP_ANSWERS = {"nacionalidad": 5, "aloj_categ": 5, "proposito": 1}
_MEANS = {"avg_age": "edad", "avg_spend": "gasto_euros", "avg_nights": "noches"}


def coded(micro: DataFrame) -> DataFrame:
    """What profiles are made of, a narrow row for each respondent (scores and
    flags as small numbers), to be joined and shuffled instead of the record."""
    m = U.parse_raw(micro)
    numbers = {n: F.col(c) for n, c in _MEANS.items()}
    numbers |= {"avg_satisfaction": X.safe_float("satisfaccion"), "avg_personas": X.safe_float(F.col("raw.PERSONAS_TOTAL"))}
    numbers |= {k: X.safe_float(F.col(f"raw.{k}")) for k in U.SPENDING_KEYS}
    numbers |= {k: X.importance_score(F.col(f"raw.{k}")).cast("tinyint") for k in IMPORTANCE_KEYS}
    numbers |= {k: X.binary_flag(F.col(f"raw.{k}")).cast("tinyint") for k in ACTIVITY_KEYS}
    return m.select(*[c for c in (*KEY, "cluster_id") if c in m.columns], *[F.col(c).cast("string").alias(c) for c in TOP_ANSWERS],
                    *[v.alias(n) for n, v in numbers.items()])


def answers(micro_labeled: DataFrame) -> DataFrame:
    """(cluster_id, dimension, value) -> n, and sums and counts of all numeric
    answers in the row of dimension ''. Respondents (as they are, or ``coded``)
    are unpivoted once, to one row for themselves and one for each categorical
    answer, and aggregated once, map-side first. Numbers become exact before
    that, once a respondent."""
    m = micro_labeled if IMPORTANCE_KEYS[0] in micro_labeled.columns else coded(micro_labeled)
    scores, flags = [*IMPORTANCE_KEYS], [*ACTIVITY_KEYS]
    numbers = [*_MEANS, "avg_satisfaction", "avg_personas", *U.SPENDING_KEYS]
    m = m.filter(F.col("cluster_id").isNotNull()).select("cluster_id", *TOP_ANSWERS, *[X.exact(n).alias(n) for n in numbers], *scores, *flags)
    item = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    rows = F.explode(F.array(item("", F.lit("")), *[item(c, F.col(c)) for c in TOP_ANSWERS]))
    m = (m.select("cluster_id", rows.alias("a"), *numbers, *scores, *flags)
          .filter((F.col("a.dimension") == "") | (F.col("a.value").isNotNull() & ~F.col("a.value").isin(*X.PLACEHOLDER_CODES))))
    own = F.col("a.dimension") == ""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name in [*numbers, *scores]:
        aggs += [F.sum(F.when(own, F.col(name))).alias(f"s_{name}"), F.count(F.when(own, F.col(name))).alias(f"c_{name}")]
    aggs += [F.sum(F.when(own, F.col(name))).alias(f"s_{name}") for name in flags]
    return m.groupBy("cluster_id", "a.dimension", "a.value").agg(*aggs)


def profiles(micro_labeled: DataFrame, code_labels: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per segment: name, size and its share, mean age,
    spend, nights, satisfaction and party size, commonest purpose, top
    nationalities and accommodations with % of the answers, activities that
    more than 30 % did, top-5 motivations, mean spending by category.
    ``code_labels``: labels (code, label) by dimension (J04); a code without
    one stands for itself. All of it follows from one aggregate of respondents,
    a few dozen rows for each segment."""
    table = answers(micro_labeled).checkpoint(eager=True)
    own = table.filter("dimension = ''")
    mean = lambda name, digits: X.round2(F.col(f"s_{name}").cast("double") / F.nullif(F.col(f"c_{name}"), F.lit(0)), digits)
    raw = {n: mean(n, 4) for n in _MEANS}
    named = F.when(raw["avg_spend"].isNull() | raw["avg_age"].isNull() | raw["avg_nights"].isNull(),
                   F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).otherwise(
                       X.segment_name(raw["avg_spend"], raw["avg_age"], raw["avg_nights"]))
    share = lambda k: F.col(f"s_{k}") / F.col("n")
    done = F.filter(F.array(*[F.when(share(k) > 0.3, F.lit(U.X_name(k))) for k in ACTIVITY_KEYS]), lambda x: x.isNotNull())
    score = lambda k: F.col(f"s_{k}").cast("double") / F.nullif(F.col(f"c_{k}"), F.lit(0))
    scores = F.filter(F.array(*[F.struct((-score(k)).alias("s"), F.lit(U.X_name(k)).alias("name")) for k in IMPORTANCE_KEYS]),
                      lambda x: x["s"].isNotNull())
    spent = F.filter(F.array(*[F.struct(F.lit(U.X_name(k)).alias("category"), mean(k, 2).alias("amount")) for k in U.SPENDING_KEYS]),
                     lambda x: x["amount"].isNotNull())
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each segment
    stats = own.select(
        "cluster_id", named.alias("cluster_name"), F.col("n").alias("size"), X.round2(F.col("n") / total * 100.0, 1).alias("size_pct"),
        mean("avg_age", 1).alias("avg_age"), mean("avg_spend", 0).alias("avg_spend"), mean("avg_nights", 1).alias("avg_nights"),
        mean("avg_satisfaction", 2).alias("avg_satisfaction"), mean("avg_personas", 2).alias("avg_personas"),
        done.alias("top_activities"), F.slice(F.transform(F.array_sort(scores), lambda x: x["name"]), 1, 5).alias("top_motivations"),
        spent.alias("spending_breakdown"))
    for dimension, column in (("nacionalidad", "top_nationalities"), ("aloj_categ", "top_accommodations"), ("proposito", "_purpose")):
        stats = stats.join(_top(table, dimension, column, (code_labels or {}).get(dimension)), "cluster_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<struct<value:string,percentage:double>>")).alias(c)
    return stats.select("cluster_id", "cluster_name", "size", "size_pct", *[c for c in stats.columns if c.startswith("avg_")],
                        F.get("_purpose", F.lit(0))["value"].alias("purpose"), empty("top_nationalities"), empty("top_accommodations"),
                        "top_activities", "top_motivations", "spending_breakdown")


def _top(table: DataFrame, dimension: str, column: str, labels: DataFrame | None) -> DataFrame:
    """The most frequent values of a dimension with % of its answers (ties by
    value), as an array in that order."""
    w = Window.partitionBy("cluster_id")
    rows = (table.filter(F.col("dimension") == dimension)
                 .withColumn("percentage", X.round2(F.col("n") / F.sum("n").over(w) * 100.0, 1))
                 .withColumn("rank", F.row_number().over(w.orderBy(F.col("n").desc(), "value")))
                 .filter(F.col("rank") <= TOP_ANSWERS[dimension]))
    if labels is not None:
        rows = U.with_labels(rows, labels, "value", "value_label").withColumn("value", F.col("value_label"))
    return rows.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "percentage"))),
                                                      lambda r: F.struct(r["value"].alias("value"), r["percentage"].alias("percentage"))).alias(column))


#: Columns of the list of segments; a single one shows all.
SUMMARY = ["cluster_id", "cluster_name", "size_pct", "avg_age", "avg_spend", "avg_nights", "top_nationalities", "top_accommodations",
           "top_activities", "top_motivations", "avg_satisfaction", "spending_breakdown"]


def summary(stored: DataFrame) -> DataFrame:
    """The list of segments, in order of their ids."""
    return stored.select(*SUMMARY).orderBy("cluster_id")


def detail(stored: DataFrame, cluster_id: int) -> DataFrame:
    """one segment with everything known of it; no row if there is none."""
    return K.point(stored, cluster_id=cluster_id)
