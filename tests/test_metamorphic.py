"""Metamorphic checks: results do not depend on row order or partitioning,
and aggregates over a union equal the union of the aggregates."""

from pyspark.sql import functions as F

from almagest.operators import quality as V
from almagest.operators import series as S
from almagest.operators import survey as U
from almagest.sources import batches as B
from almagest.sources import canonical as C


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_repartitioning_does_not_change_results(spark, sf_dir):
    ts = C.time_series(spark, sf_dir)
    micro = C.microdata(spark, sf_dir, with_raw=True)
    ts2 = ts.repartition(7, "period").orderBy(F.rand(5))
    micro2 = micro.repartition(5).orderBy(F.rand(7))
    assert _rows(S.yoy_matrix(ts)) == _rows(S.yoy_matrix(ts2))
    assert _rows(S.gaps(ts)) == _rows(S.gaps(ts2))
    assert _rows(U.nationality_profile(micro)) == _rows(U.nationality_profile(micro2))
    lab = lambda m: m.withColumn("cluster_id", (F.col("cuestionario") % 4).cast("int"))
    assert _rows(U.spending_by_cluster(lab(micro))) == _rows(U.spending_by_cluster(lab(micro2)))
    land = B.ts_landing(ts)
    v1, _ = V.validate_timeseries(land, 2001, ("orders", "lineitem"))
    v2, _ = V.validate_timeseries(land.repartition(3).orderBy(F.rand(1)), 2001, ("orders", "lineitem"))
    assert _rows(v1) == _rows(v2)


def test_sum_over_union_equals_union_of_sums(spark, sf_dir):
    ts = C.time_series(spark, sf_dir).filter((F.col("freq") == "M") & (F.col("geo_level") == "nation"))
    a = ts.filter(F.col("geo_code") < "NATION_5")
    b = ts.filter(F.col("geo_code") >= "NATION_5")
    prof = lambda d: S.seasonal_profile(d).select(*S.SERIES_KEY, "month_number", "avg_value")
    assert _rows(prof(a.unionByName(b))) == sorted(_rows(prof(a)) + _rows(prof(b)))
