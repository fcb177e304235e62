"""Landing batches derived from the canonical tables, with faults injected
by fixed rules on the keys (the same rules exist as SQL in the oracle), so
validation, de-duplication, upsert and versioning run on data that grows
with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.functions import scalars as X

# Moduli that select the records receiving each fault.
TS_FAULTS = dict(null_value=37, upper_indicator_copy=41, duplicate=43, old_year=47,
                 not_numeric=53, negative=59, slash_period=61, upper_source=67)
MICRO_FAULTS = dict(no_quarter=101, no_id=103, odd_quarter=107, old_age=109,
                    long_stay=113, negative_spend=127, duplicate=131)

# Moduli that select the missing periods.
GAP_MONTHS, GAP_QUARTERS = 19, 7


def ts_landing(ts: DataFrame) -> DataFrame:
    """Raw time-series records as a source would deliver them (value as text)."""
    f = TS_FAULTS
    t = F.col("t")
    copies = F.array_compact(F.array(F.lit(0), F.when(t % f["duplicate"] == 0, F.lit(1)),
                                     F.when(t % f["upper_indicator_copy"] == 0, F.lit(2))))
    r = ts.select("*", F.explode(copies).alias("copy"))
    value_txt = (F.when(t % f["null_value"] == 0, F.lit(None).cast("string"))
                  .when(t % f["not_numeric"] == 0, F.lit("n/a"))
                  .when(t % f["negative"] == 0, (-F.col("value")).cast("string"))
                  .otherwise(F.col("value").cast("string")))
    period = (F.when(t % f["old_year"] == 0, F.concat(F.lit("1985"), F.substring("period", 5, 10)))
               .when(t % f["slash_period"] == 0, F.regexp_replace("period", "-", "/"))
               .otherwise(F.col("period")))
    return r.select(
        F.when(t % f["upper_source"] == 0, F.upper("source")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("copy") == 2, F.upper("indicator")).otherwise(F.col("indicator")).alias("indicator"),
        "geo_code", period.alias("period"), "measure", value_txt.alias("value"),
        (t.cast("bigint") * 10 + F.col("copy")).alias("ingest_seq"))


def micro_landing(micro: DataFrame) -> DataFrame:
    """Raw survey records with missing keys, odd quarters, out-of-range
    answers and duplicate deliveries."""
    f = MICRO_FAULTS
    k = F.col("cuestionario")
    copies = F.array_compact(F.array(F.lit(0), F.when(k % f["duplicate"] == 0, F.lit(1))))
    m = micro.select("*", F.explode(copies).alias("copy"))
    quarter = (F.when(k % f["no_quarter"] == 0, F.lit(None).cast("string"))
                .when(k % f["odd_quarter"] == 0, F.lower(F.regexp_replace("quarter", "Q", "-Q")))
                .when(F.col("copy") == 1, F.lower("quarter"))
                .otherwise(F.col("quarter")))
    return m.select(
        quarter.alias("quarter"),
        F.when(k % f["no_id"] == 0, F.lit(None).cast("bigint")).otherwise(k).alias("cuestionario"),
        F.when(k % f["old_age"] == 0, F.lit(150)).otherwise(F.col("edad")).alias("edad"),
        F.when(k % f["long_stay"] == 0, F.lit(400)).otherwise(F.col("noches")).alias("noches"),
        F.when(k % f["negative_spend"] == 0, -F.col("gasto_euros")).otherwise(F.col("gasto_euros")).alias("gasto_euros"),
        "coste_vuelos_euros", "coste_aloj_euros", "nacionalidad",
        (k * 10 + F.col("copy")).alias("ingest_seq"))


def upsert_batches(ts: DataFrame):
    """Two overlapping deliveries of the facts: the second revises revenue
    (+10 %) and re-sends two of every three periods."""
    cols = ["source", "indicator", "geo_code", "period", "measure"]
    b1 = ts.filter(F.col("t") % 3 != 0).select(*cols, "value", F.lit(1).alias("batch"),
                                               (F.col("t").cast("bigint") * 10 + 1).alias("id"))
    rev = F.when(F.col("indicator") == "revenue", X.round2(F.col("value") * 1.1, 2)).otherwise(F.col("value"))
    b2 = ts.filter(F.col("t") % 3 != 1).select(*cols, rev.alias("value"), F.lit(2).alias("batch"),
                                               (F.col("t").cast("bigint") * 10 + 2).alias("id"))
    return b1, b2


def with_gaps(ts: DataFrame) -> DataFrame:
    """The facts without some nation-months and region-quarters, as a source
    with missing deliveries gives them (for U03, W07, M02)."""
    place = F.length("geo_code") + F.col("t")
    month = (F.col("geo_level") == "nation") & (F.col("freq") == "M") & (place % GAP_MONTHS == 0)
    quarter = (F.col("freq") == "Q") & (place % GAP_QUARTERS == 0)
    return ts.filter(~(month | quarter))
