"""Registered survey queries: Spark plan + DuckDB oracle text for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.functions import scalars as X
from almagest.operators import sinks as K
from almagest.operators import survey as U
from almagest.plans import oracle_base as O
from almagest.sources import canonical as C
from almagest.sources.tables import read

QRANGE = ("1996-Q1", "1999-Q4")
N_TOP = 5
N_CLUSTERS = 4


def _micro(spark, sf, raw=False):
    return C.microdata(spark, sf, with_raw=raw)


def _clustered(spark, sf, raw=True):
    """Respondents with a fixed label (cuestionario mod 4) so segment
    statistics can be checked independently of K-means."""
    return _micro(spark, sf, raw).withColumn("cluster_id", (F.col("cuestionario") % N_CLUSTERS).cast("int"))


MC = f"mc AS (SELECT CAST(cuestionario % {N_CLUSTERS} AS INTEGER) AS cluster_id, * FROM micro)"


# ---- A01 / Q15, F08 ------------------------------------------------------------
def a01_nationality(spark, sf):
    return U.nationality_profile(_micro(spark, sf))


def f08_quarter_range(spark, sf):
    return U.nationality_profile(_micro(spark, sf), *QRANGE)


def _a01_sql(where=""):
    return O.with_(O.MICRO) + f"""
SELECT nacionalidad, count(*) AS count, {O.avg_exact('gasto_euros', 2)} AS avg_spend,
       {O.avg_exact('noches', 1)} AS avg_nights
FROM micro WHERE nacionalidad IS NOT NULL {where}
GROUP BY nacionalidad ORDER BY count DESC, nacionalidad LIMIT 50"""


F08_WHERE = (f"AND replace(quarter, '-', '') >= '{QRANGE[0].replace('-', '')}' "
             f"AND replace(quarter, '-', '') <= '{QRANGE[1].replace('-', '')}'")


# ---- A05 / Q03 -------------------------------------------------------------------
def a05_markets(spark, sf):
    return U.top_markets(_micro(spark, sf), N_TOP)


A05_SQL = O.with_(O.MICRO, """g AS (SELECT nacionalidad, count(*) AS count FROM micro
  WHERE nacionalidad IS NOT NULL GROUP BY nacionalidad)""") + f"""
SELECT * FROM (
  SELECT nacionalidad, count, sum(count) OVER () AS total,
         {O.round2('count / (sum(count) OVER ()) * 100.0', 1)} AS pct,
         CAST(row_number() OVER (ORDER BY count DESC, nacionalidad) AS INTEGER) AS rank
  FROM g) WHERE rank <= {N_TOP}"""

_TOP = f"""top AS (
  SELECT nacionalidad, CAST(row_number() OVER (ORDER BY total DESC, nacionalidad) AS INTEGER) AS rank
  FROM (SELECT nacionalidad, count(*) AS total FROM micro WHERE nacionalidad IS NOT NULL
        GROUP BY nacionalidad)
  QUALIFY rank <= {N_TOP})"""

_TRENDS = f"""tr AS (
  SELECT m.nacionalidad, top.rank, m.quarter, count(*) AS count,
         {O.avg_exact('m.gasto_euros', 2)} AS avg_spend, {O.avg_exact('m.noches', 1)} AS avg_nights
  FROM micro m JOIN top ON m.nacionalidad = top.nacionalidad
  GROUP BY m.nacionalidad, top.rank, m.quarter)"""


# ---- A02 / Q17 -------------------------------------------------------------------
def a02_trend(spark, sf):
    return U.nationality_trends(_micro(spark, sf), N_TOP)


A02_SQL = O.with_(O.MICRO, _TOP, _TRENDS) + "SELECT * FROM tr"


# ---- A34 crosstab -------------------------------------------------------------------
def a34_crosstab(spark, sf):
    return U.crosstab(_micro(spark, sf), N_TOP)


A34_SQL = O.with_(O.MICRO, _TOP, _TRENDS) + "SELECT quarter, " + ", ".join(
    f"coalesce(max(CASE WHEN rank = {r} THEN count END), 0) AS n_rank{r}" for r in range(1, N_TOP + 1)
) + " FROM tr GROUP BY quarter"


# ---- W15 qoq ------------------------------------------------------------------------
def w15_qoq(spark, sf):
    return U.qoq_direction(_micro(spark, sf), N_TOP)


W15_SQL = O.with_(O.MICRO, _TOP, _TRENDS, """qo AS (
  SELECT quarter, CAST(dense_rank() OVER (ORDER BY quarter) AS INTEGER) AS q_idx
  FROM (SELECT DISTINCT quarter FROM tr))""", """c AS (
  SELECT tr.nacionalidad, tr.rank, tr.quarter, qo.q_idx, tr.count,
         first_value(tr.count) OVER (PARTITION BY tr.nacionalidad ORDER BY qo.q_idx
                                     RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev_count
  FROM tr JOIN qo ON tr.quarter = qo.quarter)""") + """
SELECT nacionalidad, rank, quarter, q_idx, coalesce(count, 0) AS count, prev_count,
       CASE WHEN count IS NULL OR prev_count IS NULL OR count = 0 THEN 'none'
            WHEN count > prev_count THEN 'up' WHEN count < prev_count THEN 'down'
            ELSE 'none' END AS direction
FROM c"""


# ---- A04 / Q16 flows --------------------------------------------------------------------
def a04_flows(spark, sf):
    return U.flows(_micro(spark, sf))


A04_SQL = O.with_(O.MICRO, """pairs AS (
  SELECT nacionalidad, aloj_categ, count(*) AS count FROM micro
  WHERE nacionalidad IS NOT NULL AND aloj_categ IS NOT NULL
  GROUP BY nacionalidad, aloj_categ HAVING count(*) >= 10)""", """nt AS (
  SELECT nacionalidad FROM (SELECT nacionalidad, sum(count) AS nt FROM pairs GROUP BY nacionalidad)
  QUALIFY row_number() OVER (ORDER BY nt DESC, nacionalidad) <= 6)""", """acc_top AS (
  SELECT aloj_categ FROM (SELECT aloj_categ, sum(count) AS acc_total FROM pairs GROUP BY aloj_categ)
  QUALIFY row_number() OVER (ORDER BY acc_total DESC, aloj_categ) <= 4)""") + """
SELECT 'country_' || p.nacionalidad AS source,
       'accom_' || CASE WHEN acc_top.aloj_categ IS NOT NULL THEN p.aloj_categ ELSE '_O' END AS target,
       CAST(sum(p.count) AS BIGINT) AS value
FROM pairs p LEFT JOIN acc_top ON p.aloj_categ = acc_top.aloj_categ
WHERE p.nacionalidad IN (SELECT nacionalidad FROM nt)
GROUP BY 1, 2"""


# ---- labels, flow nodes, nested trends, labels joined back (J04, J15, A28, K06) --------------
def j04_market_labels(spark, sf):
    """Top markets with labels; every third nation has none and keeps its code."""
    n = read(spark, sf, "nation").filter(F.col("n_nationkey") % 3 != 0)
    labels = n.select(F.col("n_name").alias("code"), X.display_name("n_name").alias("label"))
    return U.with_labels(U.top_markets(_micro(spark, sf), N_TOP), labels, "nacionalidad")


J04_SQL = f"""WITH mk AS ({A05_SQL}),
lb AS (SELECT n_name AS code, 'Nation ' || substr(n_name, 8) AS label FROM nation WHERE n_nationkey % 3 <> 0)
SELECT mk.*, coalesce(lb.label, mk.nacionalidad) AS label FROM mk LEFT JOIN lb ON lb.code = mk.nacionalidad"""


def j15_nodes(spark, sf):
    return U.flow_nodes(U.flows(_micro(spark, sf)))


J15_SQL = f"""WITH fl AS ({A04_SQL})
SELECT DISTINCT id, regexp_extract(id, '^[a-z]+_(.*)$', 1) AS code
FROM (SELECT source AS id FROM fl UNION ALL SELECT target FROM fl)"""


def _nation_labels(spark, sf):
    """Labels of nations; every third has none."""
    n = read(spark, sf, "nation").filter(F.col("n_nationkey") % 3 != 0)
    return n.select(F.col("n_name").alias("code"), X.display_name("n_name").alias("label"))


_LB = "lb AS (SELECT n_name AS code, 'Nation ' || substr(n_name, 8) AS label FROM nation WHERE n_nationkey % 3 <> 0)"


def q15_labelled(spark, sf):
    """Nationality profiles with labels."""
    return U.nationality_profile(_micro(spark, sf), labels=_nation_labels(spark, sf))


def q16_nodes(spark, sf):
    """Flow nodes with labels of countries and of the accommodations' rest."""
    rest = spark.createDataFrame([("accom", "_O", "Other")], "kind string, code string, label string")
    labels = _nation_labels(spark, sf).withColumn("kind", F.lit("country")).unionByName(rest)
    return U.flow_nodes(U.flows(_micro(spark, sf)), labels)


Q15_SQL = f"""WITH pr AS ({_a01_sql()}), {_LB}
SELECT pr.*, coalesce(lb.label, nacionalidad) AS label FROM pr LEFT JOIN lb ON lb.code = nacionalidad"""
Q16_SQL = f"""WITH nd AS ({J15_SQL}), {_LB}
SELECT nd.*, CASE WHEN nd.id = 'accom__O' THEN 'Other' WHEN nd.id LIKE 'country_%' THEN coalesce(lb.label, nd.code) ELSE nd.code END AS label
FROM nd LEFT JOIN lb ON lb.code = nd.code"""


# ---- K02: respondents merged by key ------------------------------------------------------
def k02_upsert(spark, sf):
    """A later delivery corrects the spending of every third respondent, sends
    every fifth again and brings some new ones, each twice."""
    m = _micro(spark, sf).select("quarter", "cuestionario", "nacionalidad", "gasto_euros", F.lit(1).alias("delivery"))
    k = F.col("cuestionario")
    later = (m.filter((k % 3 == 0) | (k % 5 == 0)).withColumn("gasto_euros", F.when(k % 3 == 0, F.col("gasto_euros") + 1).otherwise(F.col("gasto_euros")))
              .unionByName(m.filter((k % 7 == 0) & (k != 0)).withColumn("cuestionario", -k)).withColumn("delivery", F.lit(2)))
    twice = later.withColumn("seq", F.lit(1)).unionByName(later.withColumns({"seq": F.lit(2), "gasto_euros": F.lit(-1.0)}))
    return K.upsert(m, twice, ["quarter", "cuestionario"], order="seq").drop("seq")


K02_SQL = O.with_(O.MICRO, """later AS (
  SELECT quarter, cuestionario, nacionalidad, CASE WHEN cuestionario % 3 = 0 THEN gasto_euros + 1 ELSE gasto_euros END AS gasto_euros, 2 AS delivery
  FROM micro WHERE cuestionario % 3 = 0 OR cuestionario % 5 = 0
  UNION ALL SELECT quarter, -cuestionario, nacionalidad, gasto_euros, 2 FROM micro WHERE cuestionario % 7 = 0 AND cuestionario <> 0)""") + """
SELECT quarter, cuestionario, nacionalidad, gasto_euros, 1 AS delivery FROM micro m
WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.quarter = m.quarter AND l.cuestionario = m.cuestionario)
UNION ALL SELECT * FROM later"""


def a28_nested(spark, sf):
    """Nested trends; the array of quarters is shown as text."""
    nested = U.trends_nested(U.nationality_trends(_micro(spark, sf), N_TOP))
    point = lambda d: F.concat(d["quarter"], F.lit("|"), d["count"].cast("string"))
    return nested.select("nacionalidad", "rank", F.size("data").cast("long").alias("quarters"),
                         F.array_join(F.transform("data", point), ",").alias("series"))


A28_SQL = O.with_(O.MICRO, _TOP, _TRENDS) + """
SELECT nacionalidad, rank, count(*) AS quarters,
       string_agg(quarter || '|' || CAST(count AS VARCHAR), ',' ORDER BY quarter) AS series
FROM tr GROUP BY nacionalidad, rank"""


def k06_label_back(spark, sf):
    """Labels of four in five respondents, joined back by key and counted."""
    m = _micro(spark, sf)
    key = ["quarter", "cuestionario"]
    labels = m.filter("cuestionario % 5 <> 0").select(*key, (F.col("cuestionario") % 4).cast("int").alias("cluster_id"))
    return K.label_back(m, labels, key).groupBy("cluster_id", "quarter").agg(F.count(F.lit(1)).alias("n"))


K06_SQL = O.with_(O.MICRO) + """
SELECT CASE WHEN cuestionario % 5 <> 0 THEN CAST(cuestionario % 4 AS INTEGER) END AS cluster_id, quarter, count(*) AS n
FROM micro GROUP BY 1, 2"""


# ---- raw_json based (A10, A12, A13, A14, A16) ---------------------------------------------
def _title(key: str) -> str:
    return f"'{U.X_name(key)}'"


def a16_spending(spark, sf):
    return U.spending_by_cluster(_clustered(spark, sf))


def _a16_sql():
    sums = ", ".join(f"CAST(sum({O.exact(k)}) AS DOUBLE) AS s_{k}, count({k}) AS c_{k}"
                     for k in C.SPENDING_KEYS)
    long = " UNION ALL ".join(
        f"SELECT cluster_id, {_title(k)} AS category, CASE WHEN c_{k} > 0 THEN s_{k} / c_{k} ELSE 0.0 END AS mean FROM g"
        for k in C.SPENDING_KEYS)
    return O.with_(O.MICRO_RAW, MC, f"g AS (SELECT cluster_id, {sums} FROM mc GROUP BY cluster_id)",
                   f"long AS ({long})",
                   f"tot AS (SELECT cluster_id, CAST(sum({O.exact('mean')}) AS DOUBLE) AS total "
                   "FROM long GROUP BY cluster_id)") + f"""
SELECT l.cluster_id, l.category, {O.round2('l.mean', 2)} AS amount,
       CASE WHEN tot.total > 0 THEN {O.round2('l.mean / tot.total * 100.0', 1)} ELSE 0.0 END AS pct
FROM long l JOIN tot ON l.cluster_id = tot.cluster_id
WHERE {O.round2('l.mean', 2)} > 0"""


def a13_activities(spark, sf):
    return U.activities_by_cluster(_clustered(spark, sf))


def _a13_sql():
    sums = ", ".join(f"sum(CASE WHEN {k} = '1' THEN 1 ELSE 0 END) AS {k}" for k in C.ACTIVITY_KEYS)
    long = " UNION ALL ".join(f"SELECT cluster_id, {_title(k)} AS activity, {k} / n AS share FROM g"
                              for k in C.ACTIVITY_KEYS)
    return O.with_(O.MICRO_RAW, MC, f"g AS (SELECT cluster_id, count(*) AS n, {sums} FROM mc GROUP BY cluster_id)",
                   f"long AS ({long})") + f"""
SELECT cluster_id, activity, {O.round2('share', 4)} AS share FROM long WHERE share > 0.3"""


def a14_motivations(spark, sf):
    return U.motivations_by_cluster(_clustered(spark, sf), N_TOP)


def _a14_sql():
    def score(k):
        return (f"CASE {k} WHEN 'NADA' THEN 0.0 WHEN 'ALGO' THEN 1.0 WHEN 'BASTANTE' THEN 2.0 "
                f"WHEN 'MUCHO' THEN 3.0 END")
    sums = ", ".join(f"sum({score(k)}) AS s_{k}, count({score(k)}) AS c_{k}" for k in C.IMPORTANCE_KEYS)
    long = " UNION ALL ".join(
        f"SELECT cluster_id, {_title(k)} AS motivation, s_{k} / c_{k} AS score FROM g"
        for k in C.IMPORTANCE_KEYS)
    return O.with_(O.MICRO_RAW, MC, f"g AS (SELECT cluster_id, {sums} FROM mc GROUP BY cluster_id)",
                   f"long AS ({long})") + f"""
SELECT cluster_id, rank, motivation, {O.round2('score', 4)} AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, motivation) AS INTEGER) AS rank
  FROM long WHERE score IS NOT NULL) WHERE rank <= {N_TOP}"""


def a10_top_pct(spark, sf):
    return U.top_values_by_cluster(_clustered(spark, sf, raw=False), "nacionalidad", N_TOP)


A10_SQL = O.with_(O.MICRO, MC, """g AS (
  SELECT cluster_id, nacionalidad AS value, count(*) AS count FROM mc
  WHERE nacionalidad IS NOT NULL AND nacionalidad NOT IN ('_Z', '_U', '_N', '_Y', '')
  GROUP BY cluster_id, nacionalidad)""") + f"""
SELECT cluster_id, rank, value, count, pct AS percentage FROM (
  SELECT cluster_id, value, count,
         CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, value) AS INTEGER) AS rank,
         {O.round2('count / (sum(count) OVER (PARTITION BY cluster_id)) * 100.0', 1)} AS pct
  FROM g) WHERE rank <= {N_TOP}"""


def a12_cluster_stats(spark, sf):
    return U.cluster_stats(_clustered(spark, sf, raw=False))


A12_SQL = O.with_(O.MICRO, MC, f"""g AS (
  SELECT cluster_id, count(*) AS size, {O.avg_exact('edad', 4)} AS avg_age,
         {O.avg_exact('gasto_euros', 4)} AS avg_spend, {O.avg_exact('noches', 4)} AS avg_nights
  FROM mc GROUP BY cluster_id)""") + """
SELECT *, CASE WHEN avg_spend IS NULL OR avg_age IS NULL OR avg_nights IS NULL
               THEN 'Cluster ' || CAST(cluster_id AS VARCHAR)
          ELSE (CASE WHEN avg_spend < 500 THEN 'Budget' WHEN avg_spend <= 1000 THEN 'Mid-spend' ELSE 'Premium' END)
               || ' / ' || (CASE WHEN avg_age < 35 THEN 'Young' WHEN avg_age <= 55 THEN 'Mid-age' ELSE 'Older' END)
               || ' / ' || (CASE WHEN avg_nights < 5 THEN 'Short-stay' WHEN avg_nights <= 10 THEN 'Medium-stay'
                                 ELSE 'Long-stay' END) END AS cluster_name
FROM g"""


QUERIES = {
    "a01_nationality": a01_nationality,
    "f08_quarter_range": f08_quarter_range,
    "a05_markets": a05_markets,
    "a02_trend": a02_trend,
    "a34_crosstab": a34_crosstab,
    "w15_qoq": w15_qoq,
    "a04_flows": a04_flows,
    "j04_market_labels": j04_market_labels,
    "j15_nodes": j15_nodes,
    "q15_labelled": q15_labelled,
    "q16_nodes": q16_nodes,
    "k02_upsert": k02_upsert,
    "a28_nested": a28_nested,
    "k06_label_back": k06_label_back,
    "a16_spending": a16_spending,
    "a13_activities": a13_activities,
    "a14_motivations": a14_motivations,
    "a10_top_pct": a10_top_pct,
    "a12_cluster_stats": a12_cluster_stats,
}

ORACLE = {
    "a01_nationality": _a01_sql(),
    "f08_quarter_range": _a01_sql(F08_WHERE),
    "a05_markets": A05_SQL,
    "a02_trend": A02_SQL,
    "a34_crosstab": A34_SQL,
    "w15_qoq": W15_SQL,
    "a04_flows": A04_SQL,
    "j04_market_labels": J04_SQL,
    "j15_nodes": J15_SQL,
    "q15_labelled": Q15_SQL,
    "q16_nodes": Q16_SQL,
    "k02_upsert": K02_SQL,
    "a28_nested": A28_SQL,
    "k06_label_back": K06_SQL,
    "a16_spending": _a16_sql(),
    "a13_activities": _a13_sql(),
    "a14_motivations": _a14_sql(),
    "a10_top_pct": A10_SQL,
    "a12_cluster_stats": A12_SQL,
}
