"""Canonical fact tables derived from the driver's TPC-H-like tables
(SURVEY 7.4). Every query starts from these; the same definitions exist as
DuckDB SQL in ``almagest.plans.oracle_base`` so each result can be checked.

Scale notes
* ``nation`` (25 rows) and ``region`` (5 rows) are fixed-size dimensions at
  every scale factor: they are the only sides broadcast here.
* ``customer`` / ``supplier`` grow with the data: joined by shuffle (AQE
  may still pick broadcast at run time when the measured size is small).
* Facts are aggregated with map-side partial aggregation, so a hot region
  or month does not concentrate raw rows in one task.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import inspect
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.functions import period as P
from almagest.session import ensure_checkpoint_dir, path_exists, publish
from almagest.sources.tables import read

# The reference's survey record keys (spending breakdown,
# activities answered 1 = yes / 6 = no, importance on a 4-level scale).
SPENDING_KEYS = (
    "DESGLOSE_RESTAURANT", "DESGLOSE_EXCURS_ORGANIZ", "DESGLOSE_ALQ_VEHIC",
    "DESGLOSE_ALIM_SUPER", "DESGLOSE_DEPORTES", "DESGLOSE_PARQUES_OCIO",
    "DESGLOSE_SOUVENIRS", "DESGLOSE_EXTRA_ALOJ",
)
ACTIVITY_KEYS = (
    "ACTIV_PLAYA", "ACTIV_PISCINA", "ACTIV_PASEAR", "ACTIV_ISLA",
    "ACTIV_EXCURS_ORGANIZ", "ACTIV_EXCURS_MAR", "ACTIV_ASTRONOMIA",
    "ACTIV_MUSEOS", "ACTIV_GASTRONOMIA_CANARIA", "ACTIV_PARQUES_OCIO",
    "ACTIV_OCIO", "ACTIV_BELLEZA", "ACTIV_SENDERISMO",
    "ACTIV_OTRAS_NATURALEZA", "ACTIV_BUCEO", "ACTIV_NADAR",
    "ACTIV_SURF", "ACTIV_CICLISMO", "ACTIV_GOLF",
)
IMPORTANCE_KEYS = (
    "IMPORTANCIA_CLIMA", "IMPORTANCIA_PLAYAS", "IMPORTANCIA_MAR",
    "IMPORTANCIA_PAISAJES", "IMPORTANCIA_ENTORNO_AMBIENTAL",
    "IMPORTANCIA_RED_SENDEROS", "IMPORTANCIA_OFERTA_ALOJATIVA",
    "IMPORTANCIA_PATRIMONIO_HISTORICO", "IMPORTANCIA_OFERTA_CULTURAL",
    "IMPORTANCIA_DIVERSION", "IMPORTANCIA_OCIO_NOCTURNO",
    "IMPORTANCIA_OFERTA_COMERCIAL", "IMPORTANCIA_GASTRONOMIA",
    "IMPORTANCIA_VIAJE_SENCILLO", "IMPORTANCIA_SEGURIDAD",
    "IMPORTANCIA_TRANQUILIDAD", "IMPORTANCIA_PRECIO",
    "IMPORTANCIA_EXOTISMO", "IMPORTANCIA_AUTENTICIDAD",
)
IMPORTANCE_LEVELS = ("NADA", "ALGO", "BASTANTE", "MUCHO")

# The record keys as a struct of strings: parsed once, Parquet nested-schema
# pruning then reads only the keys a query touches.
RAW_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in
                           SPENDING_KEYS + ACTIVITY_KEYS + IMPORTANCE_KEYS + ("PERSONAS_TOTAL",)])

TS_COLUMNS = ["source", "indicator", "geo_level", "geo_code", "period", "measure",
              "value", "fetched_at", "freq", "t", "period_start"]


def money(x) -> F.Column:
    """Exact cents as decimal(18,2): half-up rounding to cents in double
    (floor(x*100+0.5)/100, identical in every IEEE engine), then an exact
    decimal so sums do not depend on the summation order."""
    return (F.floor(x * 100.0 + 0.5).cast("double") / 100.0).cast("decimal(18,2)")


def geo_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> (nation name, region name); 25 rows at every scale."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return F.broadcast(
        n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
         .select("n_nationkey", "n_name", "r_name"))


#: Bytes of input for each partition of a build's shuffles.
PART_BYTES = 8 << 20


def _dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by their keys: over ``parts`` partitions, or as many as
    the session has (which adaptive execution may draw together)."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def build_time_series(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Long fact ``time_series``: one row per (source, indicator, geo, period, measure).

    orders -> indicators orders / revenue / buyers, by region at M, Q and A
    and by nation at M; lineitem -> shipped
    quantity by supplier region at M.
    """
    geo = geo_dim(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # Distinct buyers without an Expand: orders are dealt out once by customer
    # (a hot region or month spreads over tasks), and all that is counted by
    # customer follows without another shuffle: the customer's months first,
    # then (level, place, period, customer), narrow rows with no texts but the
    # place. Per period key count(*) is then the distinct count.
    base = (_dealt(o, parts, "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey")))
    months = base.groupBy("o_custkey", "r_name", "n_name", P.month_ordinal("o_orderdate").alias("tm")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money(F.col("o_totalprice"))).alias("rev"),
        F.max("o_orderdate").alias("fetched_at"))
    tm = F.col("tm")
    y = F.floor(tm / 12).cast("int")
    key = lambda lvl, g, t: F.struct(F.lit(lvl).alias("lvl"), F.col(g).alias("geo_code"), t.alias("t"))
    keys = F.array(key(0, "r_name", tm), key(1, "r_name", y * 4 + F.floor(F.pmod(tm, F.lit(12)) / 3).cast("int")),
                   key(2, "r_name", y), key(3, "n_name", tm))
    x = months.select(F.explode(keys).alias("k"), "o_custkey", "n", "rev", "fetched_at").select("k.*", "o_custkey", "n", "rev", "fetched_at")
    gk = ["lvl", "geo_code", "t"]
    per_cust = x.groupBy(*gk, "o_custkey").agg(F.sum("n").alias("n"), F.sum("rev").alias("rev"), F.max("fetched_at").alias("fetched_at"))
    agg = per_cust.groupBy(*gk).agg(
        F.sum("n").alias("n"), F.sum("rev").alias("rev"), F.count(F.lit(1)).alias("b"),
        F.max("fetched_at").alias("fetched_at"))
    lvl, t = F.col("lvl"), F.col("t")
    agg = (agg.withColumn("geo_level", F.when(lvl == 3, "nation").otherwise("region"))
              .withColumn("freq", F.when(lvl == 1, "Q").when(lvl == 2, "A").otherwise("M"))
              .withColumn("period", F.when(t.isNotNull(), P.ordinal_to_period("freq", t))))
    o_long = agg.select(
        F.lit("orders").alias("source"), "geo_level", "geo_code", "freq", "period", "t",
        "fetched_at",
        F.explode(F.array(
            F.struct(F.lit("orders").alias("indicator"), F.col("n").cast("double").alias("value")),
            F.struct(F.lit("revenue").alias("indicator"), F.col("rev").cast("double").alias("value")),
            F.struct(F.lit("buyers").alias("indicator"), F.col("b").cast("double").alias("value")),
        )).alias("iv")).select("*", "iv.*").drop("iv")

    # lineitem: pre-aggregate per (supplier, ship month) before the join.
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_shipdate")
    li = (li.groupBy("l_suppkey", P.month_ordinal("l_shipdate").alias("t"))
            .agg(F.sum(money(F.col("l_quantity"))).alias("qty"),
                 F.max("l_shipdate").alias("fetched_at")))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    l_long = (li.join(s, li.l_suppkey == s.s_suppkey)
                .join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
                .groupBy(F.col("r_name").alias("geo_code"), "t")
                .agg(F.sum("qty").cast("double").alias("value"),
                     F.max("fetched_at").alias("fetched_at"))
                .select(F.lit("lineitem").alias("source"), F.lit("region").alias("geo_level"),
                        "geo_code", F.lit("M").alias("freq"),
                        P.ordinal_to_month_period(F.col("t")).alias("period"), "t",
                        "fetched_at", F.lit("quantity").alias("indicator"), "value"))
    ts = o_long.unionByName(l_long)
    return ts.select(
        "source", "indicator", "geo_level", "geo_code", "period",
        F.lit("ABSOLUTE").alias("measure"), "value", "fetched_at", "freq",
        F.col("t").cast("int").alias("t"), P.period_start("period").alias("period_start"))


def monthly(ts: DataFrame, geo_level: str | None = None) -> DataFrame:
    """Monthly ABSOLUTE rows (optionally one geo level)."""
    out = ts.filter((F.col("freq") == "M") & (F.col("measure") == "ABSOLUTE"))
    if geo_level:
        out = out.filter(F.col("geo_level") == geo_level)
    return out


SERIES_KEY = ["source", "indicator", "geo_code", "measure"]


def respondents(spark: SparkSession, sf_dir: str, with_raw: bool = True, parts: int | None = None) -> DataFrame:
    """What the survey records follow from, one narrow row per order: keys,
    codes, amounts and (``with_raw``) the spending from the order's line items.
    This is all that is shuffled and sorted; ``survey_record`` makes the answers
    of it row by row, wherever the row has come to lie."""
    geo = geo_dim(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    m = o.join(c, o.o_custkey == c.c_custkey)
    if with_raw:
        amount = money(F.col("l_extendedprice") * (1 - F.col("l_discount")))
        li = read(spark, sf_dir, "lineitem").select(
            "l_orderkey", ((F.col("l_linenumber") - 1) % len(SPENDING_KEYS)).alias("slot"), amount.alias("amount"))
        if parts:
            li = _dealt(li, parts, "l_orderkey")
        spend = li.groupBy("l_orderkey").agg(*[
            F.sum(F.when(F.col("slot") == i, F.col("amount"))).alias(name)
            for i, name in enumerate(SPENDING_KEYS)])
        m = m.join(spend, m.o_orderkey == F.col("l_orderkey"), "left")
    d = F.col("o_orderdate")
    return m.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"),
        F.col("o_orderkey").alias("cuestionario"), F.col("r_name").alias("isla"), "o_custkey",
        F.col("n_name").alias("nacionalidad"), F.col("o_orderpriority").alias("proposito"),
        F.col("c_mktsegment").alias("aloj_categ"), F.col("o_totalprice").alias("gasto_euros"),
        *(SPENDING_KEYS if with_raw else ()))


def survey_record(m: DataFrame, with_raw: bool = True) -> DataFrame:
    """The survey record of ``respondents``: typed columns and the record's
    answers as one struct ``raw``, whose unread keys a scan leaves out."""
    k, spent = F.col("cuestionario"), F.col("gasto_euros")
    cols = [
        "quarter", k, "isla",
        F.when(F.col("o_custkey") % 2 == 0, F.lit("1")).otherwise(F.lit("6")).alias("sexo"),
        (F.col("o_custkey") % 70 + 18).cast("int").alias("edad"),
        "nacionalidad", F.col("nacionalidad").alias("pais_residencia"), "proposito",
        (k % 14 + 1).cast("int").alias("noches"),
        "aloj_categ", spent,
        (spent * 0.3).alias("coste_vuelos_euros"),
        (spent * 0.4).alias("coste_aloj_euros"),
        (k % 11).cast("string").alias("satisfaccion"),
    ]
    if not with_raw:
        return m.select(*cols)
    answers = {name: F.col(name).cast("string") for name in SPENDING_KEYS}
    for i, name in enumerate(ACTIVITY_KEYS):
        answers[name] = F.when((k * (2 * i + 3)) % 7 < 3, F.lit("1")).otherwise(F.lit("6"))
    lvl = F.array(*[F.lit(v) for v in IMPORTANCE_LEVELS])
    for i, name in enumerate(IMPORTANCE_KEYS):  # a placeholder answer is no answer
        answers[name] = F.when((k + i) % 13 != 0, F.element_at(lvl, ((k + i) % 4 + 1).cast("int")))
    answers["PERSONAS_TOTAL"] = (k % 5 + 1).cast("string")
    return m.select(*cols, F.struct(*[answers[f.name].alias(f.name) for f in RAW_SCHEMA]).alias("raw"))


def raw_json() -> F.Column:
    """The whole record as JSON text (nulls are left out)."""
    return F.to_json("raw").alias("raw_json")


def build_microdata(spark: SparkSession, sf_dir: str, with_raw: bool = True) -> DataFrame:
    """Survey fact ``microdata``: one respondent per order.

    Typed columns follow the reference's survey record; placeholders are
    already NULL. ``raw_json`` carries the whole record as JSON text with
    spending from the order's line items, activity and importance answers.
    """
    m = survey_record(respondents(spark, sf_dir, with_raw), with_raw)
    return m.select("*", raw_json()) if with_raw else m


# Calendar of notable events used by the event queries
# (a small dimension, as in the reference's seeded calendar).
TOURISM_EVENTS = [
    (1, "Winter carnival", "Street carnival", "festival", _dt.date(1996, 2, 10), _dt.date(1996, 2, 20), "high", "EUROPE", "system"),
    (2, "Spring trade fair", "Trade fair", "business", _dt.date(1997, 4, 3), _dt.date(1997, 4, 6), "medium", "ASIA", "system"),
    (3, "Summer music festival", "Open-air concerts", "festival", _dt.date(1998, 7, 15), _dt.date(1998, 8, 15), "high", "AMERICA", "system"),
    (4, "Marathon", "City marathon", "sports", _dt.date(1999, 11, 21), None, "medium", "AFRICA", "system"),
    (5, "Year-end celebrations", "New year events", "festival", _dt.date(1999, 12, 20), _dt.date(2000, 1, 10), "high", "EUROPE", "system"),
    (6, "Sailing regatta", "Regatta week", "sports", _dt.date(2000, 6, 1), _dt.date(2000, 6, 7), "low", "MIDDLE EAST", "system"),
    (7, "Film festival", "International films", "culture", _dt.date(2000, 9, 8), _dt.date(2000, 9, 17), "medium", "EUROPE", "system"),
    (8, "Harvest fair", "Local produce fair", "culture", _dt.date(2001, 3, 1), _dt.date(2001, 5, 31), "low", "ASIA", "user"),
    (9, "Tech summit", "Conference", "business", _dt.date(2001, 7, 30), None, "medium", "AMERICA", "user"),
    (10, "Launch week", "Event before any data", "business", _dt.date(1990, 5, 1), _dt.date(1990, 5, 3), "low", "EUROPE", "user"),
]

EVENTS_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("category", T.StringType(), False),
    T.StructField("start_date", T.DateType(), False),
    T.StructField("end_date", T.DateType(), True),
    T.StructField("impact_estimate", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("source", T.StringType(), False),
])


def tourism_events(spark: SparkSession) -> DataFrame:
    """The event calendar (a fixed dimension of 10 rows)."""
    return spark.createDataFrame(TOURISM_EVENTS, EVENTS_SCHEMA)


# --------------------------------------------------------------------------
# Materialised canonical tables
# --------------------------------------------------------------------------

def _listed(spark: SparkSession, sf_dir: str, tables: list[str]):
    """Number, digest and bytes of the input files (path, modification time,
    length), listed with the binaryFile source (contents are not read)."""
    files = None
    for t in tables:
        f = (spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/{t}.parquet")
                  .select("path", "modificationTime", "length"))
        files = f if files is None else files.unionByName(f)
    # Order-free digest computed by Spark: one row reaches the driver however
    # many files the tables have.
    h = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    return files.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"), F.sum("length").alias("bytes")).first()


def input_fingerprint(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """Fingerprint of the input files."""
    r = _listed(spark, sf_dir, tables)
    return hashlib.sha256(f"{r.n}|{r.s}".encode()).hexdigest()[:16]


def partitions(spark: SparkSession, sf_dir: str, tables: list[str]) -> int | None:
    """Partitions of a build's shuffles, in proportion to its input, so that a
    task's memory does not grow with it; none (the session's own number) for
    input that one round of tasks can hold."""
    n = (_listed(spark, sf_dir, tables).bytes or 0) // PART_BYTES
    return n if n > spark.sparkContext.defaultParallelism else None


def materialised(spark: SparkSession, sf_dir: str, name: str, build, inputs: list[str],
                 partition_by: list[str], sort_by: list[str], builders=(), finish=None) -> DataFrame:
    """Derive a canonical table once per input snapshot and read it back.

    The table is written under the shared checkpoint folder, partitioned
    (directory pruning) and sorted inside files (row-group min/max skipping
    for series filters). Each build writes a folder of its own and publishes it
    by one rename: sessions that build at the same time do not touch each
    other's files, and a build that died half way is never seen.
    ``build(parts)`` gives the rows to lay out (``parts``: see ``partitions``);
    ``finish`` adds columns that follow from a row alone once it lies in its
    place, so that they are neither shuffled nor sorted.
    """
    key = input_fingerprint(spark, sf_dir, inputs)
    # The derivation code is part of the key: a changed builder never reuses
    # a snapshot written by an older one.
    # So are the constants that they read.
    fixed = repr((SPENDING_KEYS, ACTIVITY_KEYS, IMPORTANCE_KEYS, IMPORTANCE_LEVELS, RAW_SCHEMA.json(), TS_COLUMNS))
    code = hashlib.sha256("".join([*(inspect.getsource(f) for f in builders), fixed]).encode()).hexdigest()[:8]
    path = os.path.join(ensure_checkpoint_dir(spark), "canonical", f"{name}-{key}-{code}")
    if not path_exists(spark, path):
        parts = partitions(spark, sf_dir, inputs)
        df = build(parts)
        draft = f"{path}-{uuid.uuid4().hex}"
        # Range partitioning on (partition columns, sort key): a hot partition
        # value is split over many tasks by sampled key ranges, and each task
        # writes few, sorted files.
        laid = (df.repartitionByRange(*([parts] if parts else []), *partition_by, *sort_by)
                  .sortWithinPartitions(*partition_by, *sort_by))
        (finish(laid) if finish else laid).write.partitionBy(*partition_by).parquet(draft)
        publish(spark, draft, path)
    return spark.read.parquet(path)


TS_INPUTS = ["orders", "customer", "nation", "region", "lineitem", "supplier"]
MICRO_INPUTS = ["orders", "customer", "nation", "region", "lineitem"]


def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``time_series`` fact (see ``build_time_series``), materialised:
    partitioned by (freq, geo_level), sorted by series key and period."""
    df = materialised(spark, sf_dir, "time_series", lambda n: build_time_series(spark, sf_dir, n), TS_INPUTS,
                      ["freq", "geo_level"], ["source", "indicator", "geo_code", "t"],
                      builders=(build_time_series, geo_dim, money, _dealt, P))
    return df.select(*TS_COLUMNS)


MICRO_TYPED = ["quarter", "cuestionario", "isla", "sexo", "edad", "nacionalidad", "pais_residencia",
               "proposito", "noches", "aloj_categ", "gasto_euros", "coste_vuelos_euros",
               "coste_aloj_euros", "satisfaccion"]


def microdata(spark: SparkSession, sf_dir: str, with_raw: bool = True) -> DataFrame:
    """The ``microdata`` fact (see ``build_microdata``), materialised once with
    the record as a struct; partitioned by quarter, sorted by nationality.
    ``raw_json`` (``with_raw``) is made of the struct where it is read."""
    df = materialised(spark, sf_dir, "microdata", lambda n: respondents(spark, sf_dir, parts=n), MICRO_INPUTS,
                      ["quarter"], ["nacionalidad", "cuestionario"],
                      builders=(respondents, survey_record, geo_dim, money, _dealt), finish=survey_record)
    return df.select(*MICRO_TYPED, *([raw_json(), "raw"] if with_raw else []))
