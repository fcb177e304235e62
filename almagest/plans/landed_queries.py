"""Round trips of the facts through landed files: written the way sources
deliver them, read back by the readers, compared with the facts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from almagest.plans import oracle_base as O
from almagest.session import ensure_checkpoint_dir
from almagest.sources import canonical as C
from almagest.sources import landed as L


def _folder(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "landed", f"{name}-{uuid.uuid4().hex}")


def s01_indicator_csv(spark, sf):
    """All facts as indicator CSV files; every seventh value is unreadable."""
    folder = _folder(spark, "s01")
    value = F.when(F.col("t") % 7 != 0, F.col("value").cast("string")).otherwise(F.lit("n/a"))
    (C.time_series(spark, sf).select("indicator", "geo_code", F.col("period").alias("time"), "measure", value.alias("value"))
     .write.option("header", True).csv(folder))
    return L.read_indicator_csv(spark, f"{folder}/*.csv")


S01_SQL = O.with_(O.TIME_SERIES) + """
SELECT 'istac' AS source, indicator, geo_code, period, measure, value FROM time_series WHERE t % 7 <> 0"""


#: Landed files are named by the writer; their indicator is in a folder's name.
BY_FOLDER = "indicator=([^/]+)"


def s15_open_data_csv(spark, sf):
    """All facts as open-data CSV files of two spellings of the header."""
    folder = _folder(spark, "s15")
    ts = C.time_series(spark, sf)
    (ts.filter("t % 2 = 0").select("indicator", F.col("geo_code").alias("TERRITORIO_CODE"), F.col("period").alias("TIME_PERIOD_CODE"),
                                   F.col("measure").alias("MEDIDAS_CODE"), F.col("value").alias("OBS_VALUE"))
     .write.option("header", True).partitionBy("indicator").csv(f"{folder}/a"))
    (ts.filter("t % 2 = 1").select("indicator", "geo_code", "period", "measure", "value")
     .write.option("header", True).partitionBy("indicator").csv(f"{folder}/b"))
    return L.read_open_data_csv(spark, f"{folder}/*/*/*.csv", name_re=BY_FOLDER)


S15_SQL = O.with_(O.TIME_SERIES) + """
SELECT 'cabildo' AS source, indicator, geo_code, period, measure, value FROM time_series"""


def s04_sdmx_csv(spark, sf):
    """All facts as SDMX files of two headers, one without measures; beside
    them files that have no observations."""
    folder = _folder(spark, "s04")
    ts = C.time_series(spark, sf).select("indicator", "t", F.col("period").alias("TIME_PERIOD_CODE"), F.col("geo_code").alias("TERRITORIO_CODE"),
                                         F.col("measure").alias("MEDIDAS_CODE"), F.col("value").alias("OBS_VALUE"))
    for name, rows in (("a", ts.filter("t % 2 = 0").drop("t")), ("b", ts.filter("t % 2 = 1").drop("t", "MEDIDAS_CODE")),
                       ("c", ts.select("indicator", "t", "TERRITORIO_CODE"))):
        rows.write.option("header", True).partitionBy("indicator").csv(f"{folder}/{name}")
    return L.read_sdmx_csv(spark, f"{folder}/*/*/*.csv", name_re=BY_FOLDER)


S04_SQL = O.with_(O.TIME_SERIES) + """
SELECT 'istac' AS source, indicator, geo_code, period, CASE WHEN t % 2 = 0 THEN measure ELSE 'ABSOLUTE' END AS measure, value
FROM time_series"""


def s02_series_bundles(spark, sf):
    """All facts as bundles of series with a registry of names; every fifth
    series is unregistered and named by its description. Years have no period
    code in such files: they land under one that readers skip."""
    folder = _folder(spark, "s02")
    ts = C.time_series(spark, sf).withColumn("series_id", F.concat_ws("-", "indicator", "geo_code", "freq"))
    year, code = F.col("t"), F.lit(28)
    for freq, steps, base in (("M", 12, 1), ("Q", 4, 19)):
        year = F.when(F.col("freq") == freq, F.floor(F.col("t") / steps)).otherwise(year)
        code = F.when(F.col("freq") == freq, F.col("t") % steps + base).otherwise(code)
    record = F.struct(year.cast("int").alias("Anyo"), code.cast("int").alias("FK_Periodo"), F.col("value").alias("Valor"))
    series = ts.groupBy("series_id", "indicator", "geo_code").agg(F.collect_list(record).alias("records"))
    info = F.struct(F.concat(F.col("indicator"), F.lit(" of "), F.col("geo_code"), F.lit(".")).alias("description"), "records")
    (series.groupBy(F.pmod(F.xxhash64("series_id"), F.lit(4)).alias("file"))
     .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("series_id", info)))).alias("text"))
     .select("text").repartition(4).write.text(folder))
    registry = (series.filter(F.length("series_id") % 5 != 0)
                .select("series_id", F.col("indicator").alias("name"), "geo_code"))
    return L.read_series_bundles(spark, f"{folder}/part-*", registry)


S02_SQL = O.with_(O.TIME_SERIES, "known AS (SELECT *, length(indicator || '-' || geo_code || '-' || freq) % 5 <> 0 AS named FROM time_series)") + """
SELECT 'ine' AS source, CASE WHEN named THEN indicator ELSE replace(lower(indicator || ' of ' || geo_code), ' ', '_') END AS indicator,
       CASE WHEN named THEN geo_code ELSE 'ES709' END AS geo_code, period, 'ABSOLUTE' AS measure, value
FROM known WHERE freq IN ('M', 'Q')"""


def s05_cubes(spark, sf):
    """All facts as cubes, a file for each indicator and place (bounded by its periods):
    observations as a list (S05) for one half of the indicators, as a map of
    index keys (S06) for the other."""
    folder = _folder(spark, "s05")
    ts = C.time_series(spark, sf)
    cell = ts.select("indicator", "geo_code", "period", "value")
    dims = cell.groupBy("indicator", "geo_code").agg(F.sort_array(F.collect_set("period")).alias("times")).withColumn("geos", F.array(F.lit("other"), "geo_code"))
    entry = lambda codes: F.struct(F.struct(F.transform(codes, lambda c, i: F.struct(c.alias("id"), i.alias("order"))).alias("value")).alias("dimensionValues"))
    at = cell.join(dims, ["indicator", "geo_code"]).select("indicator", "geo_code", "times", "geos", "value", (F.array_position("times", F.col("period")) - 1).alias("ti"),
                                             (F.array_position("geos", F.col("geo_code")) - 1).alias("gi"))
    obs = at.groupBy("indicator", "geo_code", "times", "geos").agg(
        F.collect_list(F.struct(F.col("ti").alias("timeIndex"), F.col("gi").alias("geographicalIndex"), F.lit(0).alias("measureIndex"), "value")).alias("list"),
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "ti", "gi", F.lit("0")), "value"))).alias("keyed"))
    head = lambda o: F.to_json(F.struct(F.struct(entry(F.col("times")).alias("TIME"), entry(F.col("geos")).alias("GEOGRAPHICAL"),
                                                 entry(F.array(F.lit("ABSOLUTE"))).alias("MEASURE")).alias("dimension"), F.col(o).alias("observation")))
    text = F.when(F.col("indicator") < "p", head("list")).otherwise(head("keyed"))
    obs.select("indicator", "geo_code", text.alias("text")).write.partitionBy("indicator", "geo_code").text(folder)
    return L.read_cube_json(spark, f"{folder}/*/*/part-*", name_re=BY_FOLDER)


S05_SQL = O.with_(O.TIME_SERIES) + """
SELECT 'istac' AS source, indicator, geo_code, period, 'ABSOLUTE' AS measure, value FROM time_series"""

QUERIES = {"s01_indicator_csv": s01_indicator_csv, "s04_sdmx_csv": s04_sdmx_csv, "s02_series_bundles": s02_series_bundles, "s05_cubes": s05_cubes,
           "s15_open_data_csv": s15_open_data_csv}
ORACLE = {"s01_indicator_csv": S01_SQL, "s04_sdmx_csv": S04_SQL, "s02_series_bundles": S02_SQL, "s05_cubes": S05_SQL, "s15_open_data_csv": S15_SQL}
