"""Forecast invariants (the reference asserts invariants, not golden numbers)."""

import math

import pytest
from pyspark.sql import functions as F

from almagest.operators import forecast as M
from almagest.operators import sinks as K
from almagest.sources import canonical as C

KEY = ["source", "indicator", "geo_code", "measure"]


def _synthetic(spark, n=72, with_gap=False):
    rows = []
    seasonal = [0.8, 0.85, 0.95, 1.0, 1.05, 1.1, 1.25, 1.3, 1.1, 1.0, 0.85, 0.75]
    for i in range(n):
        t = 2015 * 12 + i
        v = round(1000.0 * seasonal[i % 12] * (1 + 0.02 * (i // 12)), 2)
        if with_gap and i == 30:
            continue
        rows.append(("s", "arrivals", "G1", "ABSOLUTE", "nation", t, f"{t // 12:04d}-{t % 12 + 1:02d}", v, "M"))
    df = spark.createDataFrame(rows, "source string, indicator string, geo_code string, measure string, "
                                     "geo_level string, t int, period string, value double, freq string")
    return df


def _check_bands(rows):
    for r in rows:
        assert r.ci_lower_95 <= r.ci_lower_80 <= r.value_predicted <= r.ci_upper_80 <= r.ci_upper_95, r
        assert r.ci_lower_95 >= 0


@pytest.fixture(scope="module")
def train(spark):
    return M.training_series(_synthetic(spark, with_gap=True), None, None, geo_level="nation")


def test_training_series_fills_gap(train):
    rows = train.orderBy("t").collect()
    assert len(rows) == 72 and all(r.value_filled is not None for r in rows)
    assert sum(r.value is None for r in rows) == 1


def test_seasonal_naive_repeats_last_year(spark, train):
    fc = M.seasonal_naive(train, 12).orderBy("h").collect()
    last = train.orderBy(F.col("t").desc()).limit(12).orderBy("t").collect()
    assert [r.value_predicted for r in fc] == [round(r.value_filled, 2) for r in last]
    assert [r.t for r in fc] == list(range(last[-1].t + 1, last[-1].t + 13))
    _check_bands(fc)
    widths = [r.ci_upper_95 - r.ci_lower_95 for r in fc]
    assert widths == sorted(widths)


def test_naive_short_series_cycles(spark):
    tr = M.training_series(_synthetic(spark, n=5), None, None)
    fc = M.seasonal_naive(tr, 12).orderBy("h").collect()
    vals = [r.value_predicted for r in fc]
    assert vals[:5] == vals[5:10] and len(vals) == 12


def test_holt_winters_tracks_seasonal_series(train):
    fc = M.holt_winters(train, 12).orderBy("h").collect()
    assert len(fc) == 12
    _check_bands(fc)
    seasonal = [0.8, 0.85, 0.95, 1.0, 1.05, 1.1, 1.25, 1.3, 1.1, 1.0, 0.85, 0.75]
    truth = [1000.0 * seasonal[(72 + h - 1) % 12] * (1 + 0.02 * 6) for h in range(1, 13)]
    err = sum(abs(a.value_predicted - b) / b for a, b in zip(fc, truth)) / 12
    assert err < 0.05, err


def test_seasonal_arma_invariants(train):
    fc = M.seasonal_arma(train, 12).orderBy("h").collect()
    assert len(fc) == 12 and all(math.isfinite(r.value_predicted) for r in fc)
    _check_bands(fc)
    seasonal = [0.8, 0.85, 0.95, 1.0, 1.05, 1.1, 1.25, 1.3, 1.1, 1.0, 0.85, 0.75]
    truth = [1000.0 * seasonal[(72 + h - 1) % 12] * (1 + 0.02 * 6) for h in range(1, 13)]
    err = sum(abs(a.value_predicted - b) / b for a, b in zip(fc, truth)) / 12
    assert err < 0.15, err


def test_ensemble_weights_and_renormalisation(spark):
    cols = "model string, source string, indicator string, geo_code string, measure string, h int, t int, " \
           "period string, value_predicted double, ci_lower_80 double, ci_upper_80 double, " \
           "ci_lower_95 double, ci_upper_95 double"
    base = ("s", "i", "g", "ABSOLUTE")
    sa = spark.createDataFrame([("seasonal_arma", *base, 1, 1, "p1", 100.0, 90.0, 110.0, 80.0, 120.0),
                                ("seasonal_arma", *base, 4, 4, "p4", 100.0, 90.0, 110.0, 80.0, 120.0)], cols)
    hw = spark.createDataFrame([("holt_winters", *base, 1, 1, "p1", 200.0, 0.0, 0.0, 0.0, 0.0)], cols)
    nv = spark.createDataFrame([("seasonal_naive", *base, 1, 1, "p1", 300.0, 0.0, 0.0, 0.0, 0.0),
                                ("seasonal_naive", *base, 4, 4, "p4", 300.0, 0.0, 0.0, 0.0, 0.0)], cols)
    out = {r.h: r for r in M.ensemble(sa, hw, nv).collect()}
    assert out[1].value_predicted == pytest.approx(140.0)
    assert out[4].value_predicted == pytest.approx((0.5 * 100 + 0.2 * 300) / 0.7, abs=0.01)
    assert out[1].ci_lower_80 == pytest.approx(90.0 * 1.4)


def test_metrics_fixture(spark):
    fc = spark.createDataFrame([("m", "s", "i", "g", "ABSOLUTE", 1, 10.0), ("m", "s", "i", "g", "ABSOLUTE", 2, 22.0)],
                               "model string, source string, indicator string, geo_code string, measure string, "
                               "t int, value_predicted double")
    act = spark.createDataFrame([("s", "i", "g", "ABSOLUTE", 1, 12.0), ("s", "i", "g", "ABSOLUTE", 2, 20.0)],
                                "source string, indicator string, geo_code string, measure string, t int, actual double")
    r = M.metrics(fc, act).collect()[0]
    assert (r.rmse, r.mae, r.mape, r.test_size) == (2.0, 2.0, round((2 / 12 + 2 / 20) / 2 * 100, 2), 2)


def test_versioning(spark):
    b = spark.createDataFrame([("m", "x", 1.0)], "model string, period string, v double")
    h1 = K.versioned_append(None, b, ["model"])
    h2 = K.versioned_append(h1, b, ["model"])
    h3 = K.versioned_append(h2, b, ["model"]).orderBy("version").collect()
    assert [r.version for r in h3] == [1, 2, 3]
    assert [r.is_current for r in h3] == [False, False, True]


def test_fleet_on_driver_tables(spark, sf_dir):
    tr = M.training_series(C.time_series(spark, sf_dir), "2001-07", ("1998-03", "1999-06"))
    out = M.all_models(tr, 12)
    counts = {r.model: r["count"] for r in out.groupBy("model").count().collect()}
    assert set(counts) == {"seasonal_naive", "holt_winters", "seasonal_arma", "ensemble"}
    _check_bands(out.collect())
