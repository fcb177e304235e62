"""Survey (respondent) operators over ``microdata`` (A01-A05, A10-A16, A28,
A30, A34, W14, W15, J04, J12, J15).

Pattern used throughout: aggregate first (partial aggregation on the map
side, so a nationality holding a third of all respondents costs one small
partial row per task), then rank / share / pivot the *aggregated* rows. A
global window or broadcast only ever touches rows whose count is bounded
by the number of distinct categories, never by the number of respondents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions import period as P
from almagest.functions import scalars as X
from almagest.sources.canonical import (ACTIVITY_KEYS, IMPORTANCE_KEYS, RAW_SCHEMA,
                                        SPENDING_KEYS)


def avg_exact(c, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return X.round2(F.sum(X.exact(c)).cast("double") / F.count(c), digits)


def _share(count_col: str, total_col: str, digits: int = 1) -> Column:
    return X.round2(F.col(count_col) / F.col(total_col) * 100.0, digits)


def quarter_range(micro: DataFrame, from_q: str | None = None, to_q: str | None = None) -> DataFrame:
    """inclusive quarter range, '2025-Q1' and '2025Q1' spellings alike."""
    q = P.normalise_quarter(F.col("quarter"))
    if from_q:
        micro = micro.filter(q >= from_q.replace("-", "").upper())
    if to_q:
        micro = micro.filter(q <= to_q.replace("-", "").upper())
    return micro


def with_labels(df: DataFrame, labels: DataFrame, code_col: str, out: str = "label") -> DataFrame:
    """Code -> label with the code itself as default.

    ``labels`` is a code dimension (one row per category); adaptive execution
    broadcasts it if it turns out small.
    """
    lab = labels.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    return (df.join(lab, F.col(code_col) == F.col("_code"), "left")
              .withColumn(out, F.coalesce(F.col("_label"), F.col(code_col)))
              .drop("_code", "_label"))


def nationality_profile(micro: DataFrame, from_q=None, to_q=None, limit: int = 50, labels: DataFrame | None = None) -> DataFrame:
    """Respondents, mean spend and mean nights per nationality,
    largest first (ties by code), top ``limit``, with labels if given (J04)."""
    m = quarter_range(micro.filter(F.col("nacionalidad").isNotNull()), from_q, to_q)
    g = m.groupBy("nacionalidad").agg(
        F.count(F.lit(1)).alias("count"),
        avg_exact("gasto_euros", 2).alias("avg_spend"),
        avg_exact("noches", 1).alias("avg_nights"))
    top = g.orderBy(F.col("count").desc(), F.col("nacionalidad").asc()).limit(limit)
    return top if labels is None else with_labels(top, labels, "nacionalidad")


def top_markets(micro: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` nationalities with their % of all respondents
    whose nationality is known. The share window runs on the aggregated rows
    (one per nationality)."""
    g = (micro.filter(F.col("nacionalidad").isNotNull())
              .groupBy("nacionalidad").agg(F.count(F.lit(1)).alias("count")))
    total = g.agg(F.sum("count")).scalar()  # scalar subquery
    return (_top_n(g, [F.col("count").desc(), F.col("nacionalidad").asc()], n)
            .withColumn("total", total)
            .withColumn("pct", _share("count", "total", 1)))


def _top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """Top ``n`` rows by ``order`` with a 1-based rank: a distributed top-k
    (sort + limit = TakeOrderedAndProject, each task keeps n rows), then a
    rank over the n survivors only."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_codes(micro: DataFrame, col: str, n: int) -> DataFrame:
    """W14 / J12 helper: the ``n`` most frequent non-null codes with rank."""
    g = micro.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("total"))
    return _top_n(g, [F.col("total").desc(), F.col(col).asc()], n)


def nationality_trends(micro: DataFrame, n: int = 5, nationality: str | None = None) -> DataFrame:
    """A02 + J12 / Q17: (quarter, nationality) count and means, restricted to
    the top ``n`` nationalities (semi-join on a broadcast of at most n rows)."""
    if nationality:
        top = micro.sparkSession.createDataFrame([(nationality, 1)], "nacionalidad string, rank int")
    else:
        top = top_codes(micro, "nacionalidad", n).select("nacionalidad", "rank")
    m = micro.join(F.broadcast(top), "nacionalidad", "inner")
    return m.groupBy("nacionalidad", "rank", "quarter").agg(
        F.count(F.lit(1)).alias("count"),
        avg_exact("gasto_euros", 2).alias("avg_spend"),
        avg_exact("noches", 1).alias("avg_nights"))


def trends_nested(trends: DataFrame) -> DataFrame:
    """One row per nationality, its quarters as an ordered array
    (bounded by the number of quarters)."""
    return (trends.groupBy("nacionalidad", "rank")
                  .agg(F.array_sort(F.collect_list(F.struct("quarter", "count", "avg_spend",
                                                            "avg_nights"))).alias("data")))


def crosstab(micro: DataFrame, n: int = 5) -> DataFrame:
    """Quarter x top-``n`` nationality counts, missing cell = 0.

    Columns are the rank positions (``n_rank1``..), so no category value has
    to be pulled to the driver to name a column.
    """
    t = nationality_trends(micro, n)
    piv = t.groupBy("quarter").pivot("rank", list(range(1, n + 1))).agg(F.first("count"))
    for r in range(1, n + 1):
        piv = piv.withColumnRenamed(str(r), f"n_rank{r}")
    return piv.na.fill(0, [f"n_rank{r}" for r in range(1, n + 1)])


def qoq_direction(micro: DataFrame, n: int = 5) -> DataFrame:
    """Per top nationality and quarter, direction versus the previous
    quarter *of the quarter list*: up / down / none (none when either count
    is missing or the current one is 0)."""
    t = nationality_trends(micro, n)
    # The quarter list: distinct quarters of the aggregated cells (bounded).
    q_ord = (t.select("quarter").distinct()
              .withColumn("q_idx", F.dense_rank().over(Window.orderBy("quarter"))))
    cells = t.join(F.broadcast(q_ord), "quarter")
    w = Window.partitionBy("nacionalidad").orderBy("q_idx").rangeBetween(-1, -1)
    cells = cells.withColumn("prev_count", F.first("count").over(w))
    d = (F.when(F.col("count").isNull() | F.col("prev_count").isNull() | (F.col("count") == 0), F.lit("none"))
          .when(F.col("count") > F.col("prev_count"), F.lit("up"))
          .when(F.col("count") < F.col("prev_count"), F.lit("down"))
          .otherwise(F.lit("none")))
    return cells.select("nacionalidad", "rank", "quarter", "q_idx",
                        F.coalesce("count", F.lit(0)).alias("count"), "prev_count",
                        d.alias("direction"))


def flows(micro: DataFrame, min_count: int = 10, top_countries: int = 6,
          top_accoms: int = 4, from_q=None, to_q=None) -> DataFrame:
    """A03 + A04 + J15 / Q16: country -> accommodation links.

    Stage 1 counts (nationality, accommodation) pairs with HAVING; no
    arbitrary LIMIT (trap T03). Stage 2 keeps the top countries, folds
    accommodations outside the top into '_O' and re-sums. Both rankings run
    on aggregated pairs (bounded by categories).
    """
    m = quarter_range(micro.filter(F.col("nacionalidad").isNotNull() & F.col("aloj_categ").isNotNull()),
                      from_q, to_q)
    pairs = (m.groupBy("nacionalidad", "aloj_categ").agg(F.count(F.lit(1)).alias("count"))
              .filter(F.col("count") >= min_count))
    nat_tot = pairs.groupBy("nacionalidad").agg(F.sum("count").alias("nt"))
    nat_top = nat_tot.orderBy(F.col("nt").desc(), "nacionalidad").limit(top_countries).select("nacionalidad")
    acc_tot = pairs.groupBy("aloj_categ").agg(F.sum("count").alias("at"))
    acc_top = (acc_tot.orderBy(F.col("at").desc(), "aloj_categ").limit(top_accoms)
                      .select(F.col("aloj_categ").alias("top_acc")))
    kept = (pairs.join(F.broadcast(nat_top), "nacionalidad", "left_semi")
                 .join(F.broadcast(acc_top), F.col("aloj_categ") == F.col("top_acc"), "left"))
    acc = F.when(F.col("top_acc").isNotNull(), F.col("aloj_categ")).otherwise(F.lit("_O"))
    links = kept.groupBy("nacionalidad", acc.alias("accom")).agg(F.sum("count").alias("value"))
    return links.select(F.concat(F.lit("country_"), "nacionalidad").alias("source"),
                        F.concat(F.lit("accom_"), "accom").alias("target"),
                        F.col("value").cast("bigint").alias("value"))


def flow_nodes(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """nodes = distinct link ends (orphans cannot appear), with
    their labels (J04: kind country or accom, code, label) if given."""
    ends = links.select(F.col("source").alias("id")).union(links.select(F.col("target").alias("id")))
    nodes = ends.distinct().withColumn("code", F.regexp_extract("id", r"^[a-z]+_(.*)$", 1))
    if labels is None:
        return nodes
    named = labels.select(F.concat_ws("_", "kind", "code").alias("code"), "label")
    return with_labels(nodes, named, "id").withColumn("label", F.when(F.col("label") == F.col("id"), F.col("code")).otherwise(F.col("label")))


# --------------------------------------------------------------------------
# raw_json based segment statistics
# --------------------------------------------------------------------------

def parse_raw(micro: DataFrame) -> DataFrame:
    """The record as a struct (malformed JSON -> NULL fields). A stored
    table already carries it parsed (``raw``); otherwise it is parsed here."""
    if "raw" in micro.columns:
        return micro
    return micro.withColumn("raw", F.from_json("raw_json", RAW_SCHEMA, {"mode": "PERMISSIVE"}))


def spending_by_cluster(micro: DataFrame) -> DataFrame:
    """Mean of each spending key per cluster, % of the cluster's
    total (from unrounded means, T21), zero amounts dropped.

    One aggregate per cluster with a (sum, count) pair per key: no row
    explosion before the shuffle; the 8-way unpivot runs on the result.
    """
    m = parse_raw(micro.filter(F.col("cluster_id").isNotNull())).filter(F.col("raw").isNotNull())
    aggs = []
    for k in SPENDING_KEYS:
        v = X.safe_float(F.col(f"raw.{k}"))
        aggs += [F.sum(X.exact(v)).alias(f"s_{k}"), F.count(v).alias(f"c_{k}")]
    g = m.groupBy("cluster_id").agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(X_name(k)).alias("category"),
                 F.when(F.col(f"c_{k}") > 0, F.col(f"s_{k}").cast("double") / F.col(f"c_{k}"))
                  .otherwise(F.lit(0.0)).alias("mean"))
        for k in SPENDING_KEYS]))
    long = g.select("cluster_id", rows.alias("r")).select("cluster_id", "r.*")
    w = Window.partitionBy("cluster_id")
    total = F.sum(X.exact(F.col("mean"))).over(w).cast("double")
    return (long.withColumn("total", total)
                .withColumn("amount", X.round2(F.col("mean"), 2))
                .withColumn("pct", F.when(F.col("total") > 0,
                                          X.round2(F.col("mean") / F.col("total") * 100.0, 1))
                                     .otherwise(F.lit(0.0)))
                .filter(F.col("amount") > 0)
                .select("cluster_id", "category", "amount", "pct"))


def X_name(key: str) -> str:
    """X18 on a fixed key (driver-side constant): prefix off, '_' -> ' ', title."""
    return key.split("_", 1)[1].replace("_", " ").title()


def activities_by_cluster(micro: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Activities done (answer 1) by more than ``threshold`` of a cluster;
    NULL counts as not done."""
    m = parse_raw(micro.filter(F.col("cluster_id").isNotNull()))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(X.binary_flag(F.col(f"raw.{k}")).cast("long")).alias(k) for k in ACTIVITY_KEYS]
    g = m.groupBy("cluster_id").agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(X_name(k)).alias("activity"),
                                        (F.col(k) / F.col("n")).alias("share"))
                               for k in ACTIVITY_KEYS]))
    long = g.select("cluster_id", rows.alias("r")).select("cluster_id", "r.*")
    return (long.filter(F.col("share") > threshold)
                .select("cluster_id", "activity", X.round2(F.col("share"), 4).alias("share")))


def motivations_by_cluster(micro: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` importance items per cluster by mean ordinal score."""
    m = parse_raw(micro.filter(F.col("cluster_id").isNotNull()))
    aggs = []
    for k in IMPORTANCE_KEYS:
        s = X.importance_score(F.col(f"raw.{k}"))
        aggs += [F.sum(s).alias(f"s_{k}"), F.count(s).alias(f"c_{k}")]
    g = m.groupBy("cluster_id").agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(X_name(k)).alias("motivation"),
                                        (F.col(f"s_{k}") / F.col(f"c_{k}")).alias("score"))
                               for k in IMPORTANCE_KEYS]))
    long = (g.select("cluster_id", rows.alias("r")).select("cluster_id", "r.*")
             .filter(F.col("score").isNotNull()))
    w = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), F.col("motivation").asc())
    return (long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
                .select("cluster_id", "rank", "motivation", X.round2(F.col("score"), 4).alias("score")))


def top_values_by_cluster(micro: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Top ``n`` values of ``col`` per cluster with % of the cluster's
    non-placeholder answers (ties by value)."""
    m = micro.filter(F.col("cluster_id").isNotNull() & F.col(col).isNotNull()
                     & ~F.col(col).isin(*X.PLACEHOLDER_CODES))
    g = m.groupBy("cluster_id", F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    w_all = Window.partitionBy("cluster_id")
    w = Window.partitionBy("cluster_id").orderBy(F.col("count").desc(), F.col("value").asc())
    return (g.withColumn("total", F.sum("count").over(w_all))
             .withColumn("rank", F.row_number().over(w))
             .filter(F.col("rank") <= n)
             .select("cluster_id", "rank", "value", "count",
                     _share("count", "total", 1).alias("percentage")))


def cluster_stats(micro: DataFrame) -> DataFrame:
    """A12 + A15-style means per cluster and the X13 name."""
    g = micro.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        avg_exact("edad", 4).alias("avg_age"),
        avg_exact("gasto_euros", 4).alias("avg_spend"),
        avg_exact("noches", 4).alias("avg_nights"))
    name = F.when(F.col("avg_spend").isNull() | F.col("avg_age").isNull() | F.col("avg_nights").isNull(),
                  F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))) \
            .otherwise(X.segment_name(F.col("avg_spend"), F.col("avg_age"), F.col("avg_nights")))
    return g.withColumn("cluster_name", name)
