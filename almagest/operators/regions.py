"""Region intensity map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions import period as P
from almagest.functions import scalars as X
from almagest.operators import series as S

# Estimation factor per zone (share of the period's maximum)
# and the default for an unknown zone.
ZONE_FACTORS = {"south": 0.60, "north": 0.30, "west": 0.40, "metro": 0.25}
DEFAULT_FACTOR = 0.25

# Intensities where there is no data at all, per zone of the test data, and for an unknown zone.
FALLBACK_INTENSITIES = {"south": 80, "north": 40, "west": 50, "metro": 35}
DEFAULT_INTENSITY = 25

# Zone of each test-data region (our mapping of the TPC-H regions onto zones;
# MIDDLE EAST has none and takes the default factor).
REGION_ZONES = {"AFRICA": "south", "AMERICA": "west", "ASIA": "north", "EUROPE": "metro"}


def _map_expr(d: dict, key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)


def intensity_map(ts: DataFrame, geo: DataFrame, indicator: str = "orders", ahead: int = 0) -> DataFrame:
    """Q05 for every period: each nation's intensity 0..100, by the first layer
    that has an answer (``source``): ``real``, its value relative to the
    period's maximum; ``estimated``, the zone's share of that maximum;
    ``fallback``, the zone's fixed intensity where nobody was observed in the
    period (``data_available`` is false).

    J10: every region in every period from the first to the last one observed
    anywhere and ``ahead`` months more; without any observation the regions
    have one row without period.
    """
    m = S.monthly_only(ts.filter((F.col("geo_level") == "nation") & (F.col("freq") == "M")
                                 & (F.col("indicator") == indicator)))
    periods = F.sequence(m.agg(F.min("t")).scalar(), m.agg(F.max("t") + ahead).scalar())
    grid = geo.select(F.col("n_name").alias("geo_code"), "r_name", F.explode_outer(periods).alias("t"))  # 25 nations
    cells = (grid.join(m.select("geo_code", "t", "value"), ["geo_code", "t"], "left")
             .withColumn("period", F.when(F.col("t").isNotNull(), P.ordinal_to_month_period(F.col("t")))))
    zone = _map_expr(REGION_ZONES, F.col("r_name"))
    factor = F.coalesce(_map_expr(ZONE_FACTORS, zone), F.lit(DEFAULT_FACTOR))
    mx = F.max("value").over(Window.partitionBy("period"))
    real = F.when(F.col("max_value") > 0,
                  F.least(X.round2(F.col("value") / F.col("max_value") * 100.0, 0), F.lit(100.0))) \
            .otherwise(F.lit(0.0))
    fallback = F.coalesce(_map_expr(FALLBACK_INTENSITIES, zone), F.lit(DEFAULT_INTENSITY))
    there = F.col("max_value").isNotNull()
    out = (cells.withColumn("max_value", mx)
                .withColumn("zone", zone)
                .withColumn("source", F.when(F.col("value").isNotNull(), F.lit("real")).when(there, F.lit("estimated"))
                                       .otherwise(F.lit("fallback")))
                .withColumn("intensity", F.when(F.col("value").isNotNull(), real).when(there, X.round2(factor * 100.0, 0))
                                          .otherwise(fallback).cast("int")))
    return out.select("period", "geo_code", "zone", "value", "max_value", "intensity", "source",
                      there.alias("data_available"), X.intensity_class(F.col("intensity")).alias("color_class"))


def polygons_with_intensity(features: DataFrame, intensities: DataFrame) -> DataFrame:
    """Polygon attributes left-joined to computed intensity, falling back
    to the polygon's own attribute, then 0."""
    return (features.join(intensities.select("code", F.col("intensity").alias("api_intensity")), "code", "left")
                    .withColumn("intensity", F.coalesce("api_intensity", "tourism_intensity", F.lit(0)))
                    .drop("api_intensity"))
