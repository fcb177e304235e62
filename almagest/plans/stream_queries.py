"""Registered streaming queries: each lands files derived from the given
tables, runs the stream to completion (availableNow) and returns the final
state, which the oracle computes directly."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from almagest.operators import quality as V
from almagest.plans import oracle_base as O
from almagest.plans import quality_queries as QQ
from almagest.sources import batches as B
from almagest.sources import canonical as C
from almagest.sources.tables import read
from almagest.streaming import ingest as S

KEY = ["source", "indicator", "geo_code", "measure", "freq"]


def r01_incremental(spark, sf):
    landing_df = B.ts_landing(C.time_series(spark, sf)).withColumn("_part", (F.col("ingest_seq") / 10).cast("long"))
    work = S.workspace(spark, "r01")
    landing = S.land(landing_df, os.path.join(work, "landing"), "_part", 3)
    schema = landing_df.drop("_part").schema
    table = S.incremental_ingest(
        spark, landing, schema,
        lambda b: V.validate_timeseries(b, QQ.AS_OF_YEAR, QQ.SOURCES)[0], V.TS_KEY, work)
    return table.read()


def r02_dedup(spark, sf):
    ev = read(spark, sf, "events")
    again = ev.filter(F.col("event_id") % 7 == 0)
    df = ev.withColumn("_part", F.lit(0)).unionByName(again.withColumn("_part", F.lit(1)))
    work = S.workspace(spark, "r02")
    landing = S.land(df, os.path.join(work, "landing"), "_part", 2)
    return S.dedup_stream(spark, landing, ev.schema, ["event_id"], "1 day", work)


# Deliveries of r03: all facts, then corrections and repeats, then revisions older than what is there.
def r03_latest(spark, sf):
    ts = C.time_series(spark, sf).select(*KEY, "period", "value", "t")
    corrected = ts.filter("t % 3 = 0").withColumns({"value": F.col("value") + 1, "revision": F.lit(2)})
    repeated = ts.filter("t % 7 = 1").withColumn("revision", F.lit(1))
    outdated = ts.filter("t % 5 = 0").withColumns({"value": F.col("value") - 1, "revision": F.lit(0)})
    first = ts.withColumn("revision", F.lit(1))
    parts = [(first, F.col("t") % 4), (corrected, F.lit(4)), (repeated, F.lit(5)), (outdated, F.lit(6))]
    df = None
    for rows, part in parts:
        rows = rows.withColumn("_part", part.cast("int"))
        df = rows if df is None else df.unionByName(rows)
    work = S.workspace(spark, "r03")
    landing = S.land(df, os.path.join(work, "landing"), "_part", 7)
    return S.latest_state(spark, landing, df.drop("_part").schema, KEY, work, order="revision", max_files_per_trigger=16)


R03_SQL = O.with_(O.TIME_SERIES, "now AS (SELECT * REPLACE (CASE WHEN t % 3 = 0 THEN value + 1 ELSE value END AS value) FROM time_series)") + """
SELECT source, indicator, geo_code, measure, freq,
       arg_max(struct_pack(p := period, v := value), t).p AS latest_period,
       arg_max(struct_pack(p := period, v := value), t).v AS latest_value,
       min(period) AS first_period, max(period) AS last_period, count(*) AS n_points
FROM now GROUP BY source, indicator, geo_code, measure, freq"""

QUERIES = {
    "r01_incremental": r01_incremental,
    "r02_dedup": r02_dedup,
    "r03_latest": r03_latest,
}

ORACLE = {
    "r01_incremental": QQ.V01_SQL,
    "r02_dedup": "SELECT * FROM events",
    "r03_latest": R03_SQL,
}
