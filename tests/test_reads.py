"""Reads that fall back by layers, and KPIs of mixed frequencies."""

from pyspark.sql import functions as F

from almagest.operators import regions as G
from almagest.operators import series as S

TS = ("source string, indicator string, geo_code string, measure string, geo_level string, freq string, t int, period string, "
      "value double, fetched_at string")


def month(t):
    return f"{t // 12:04d}-{t % 12 + 1:02d}"


def facts(spark, rows):
    """rows: (indicator, geo, freq, t, period, value[, fetched_at])."""
    full = [("s", r[0], r[1], "ABSOLUTE", "nation", *r[2:6], r[6] if len(r) > 6 else "2024-01-01") for r in rows]
    return spark.createDataFrame(full, TS).withColumn(
        "period_start", F.when(F.col("freq") == "M", F.to_date(F.concat("period", F.lit("-01")))))


def test_kpis_of_mixed_frequencies(spark):
    t = 2020 * 12
    ts = facts(spark, [("a", "X", "M", t + 12, month(t + 12), 110.0), ("a", "X", "M", t, month(t), 100.0),
                       ("a", "X", "M", t + 11, month(t + 11), 5.0),
                       ("b", "X", "Q", 2021 * 4 + 1, "2021-Q2", 30.0), ("b", "X", "Q", 2020 * 4 + 1, "2020-Q2", 20.0),
                       ("b", "X", "M", t + 12, month(t + 12), 999.0), ("c", "X", "A", 2021, "2021", 4.0), ("c", "X", "A", 2020, "2020", 8.0),
                       ("c", "Y", "A", 2021, "2021", 1.0), ("z", "Z", "M", t, month(t), 1.0, "2024-09-09")])
    kpis = {"a": ("a", "M"), "b": ("b", "Q"), "c": ("c", "A")}
    got = {r.geo_code: r for r in S.kpi_snapshot(ts, kpis).collect()}
    assert set(got) == {"X", "Y"}
    x, y = got["X"], got["Y"]
    assert (x.a_value, x.a_period, x.a_yoy, x.b_value, x.b_yoy, x.c_value, x.c_yoy) == (110.0, "2021-01", 10.0, 30.0, 50.0, 4.0, -50.0)
    assert x.data_available and x.reason is None and x.last_updated == "2024-09-09"
    assert not y.data_available and y.reason == "no_data_available" and y.c_value == 1.0 and y.c_yoy is None
    of = S.kpi_snapshot(ts, kpis, period="2020-12").collect()
    assert [(r.geo_code, r.a_value, r.a_yoy, r.b_value) for r in of] == [("X", 5.0, None, None)]


def test_prior_year_uses_one_window(spark):
    plan = S.with_prior_year(facts(spark, [("a", "X", "M", 0, "0000-01", 1.0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1


def test_outlook_layers(spark):
    t = 2020 * 12
    rows = [("a", g, "M", t + m, month(t + m), 100.0 + m) for g, n in (("FULL", 24), ("PART", 4), ("FC", 24)) for m in range(n)]
    fc = spark.createDataFrame([("s", "a", "FC", "ABSOLUTE", t + 24 + m, 500.0) for m in (3, 4)],
                               "source string, indicator string, geo_code string, measure string, t int, value_predicted double")
    got = {r.geo_code: r for r in S.seasonal_position(facts(spark, rows), 3, fc).collect()}
    assert got["FULL"].outlook_layers == "history,history,history"
    assert got["PART"].outlook_layers == "history,overall,overall"
    assert got["FC"].outlook_layers == "forecast,forecast" and got["FC"].next_3_months == "High"
    assert got["PART"].monthly_averages == "January=100,February=101,March=102,April=103"
    assert got["FULL"].next_months == "April,May,June"
    alone = S.seasonal_position(facts(spark, rows), 3).collect()
    assert {r.outlook_layers for r in alone} == {"history,history,history", "history,overall,overall"}


def test_map_layers_and_an_empty_table(spark):
    t = 2020 * 12
    geo = spark.createDataFrame([("SPAIN", "EUROPE"), ("EGYPT", "MIDDLE EAST")], "n_name string, r_name string")
    ts = facts(spark, [("orders", "SPAIN", "M", t, month(t), 10.0), ("orders", "EGYPT", "M", t, month(t), 5.0),
                       ("orders", "SPAIN", "M", t + 1, month(t + 1), 8.0)])
    got = {(r.period, r.geo_code): (r.source, r.intensity, r.data_available) for r in G.intensity_map(ts, geo, ahead=1).collect()}
    assert got == {(month(t), "SPAIN"): ("real", 100, True), (month(t), "EGYPT"): ("real", 50, True),
                   (month(t + 1), "SPAIN"): ("real", 100, True), (month(t + 1), "EGYPT"): ("estimated", 25, True),
                   (month(t + 2), "SPAIN"): ("fallback", 35, False), (month(t + 2), "EGYPT"): ("fallback", 25, False)}
    none = G.intensity_map(ts.limit(0), geo).collect()
    assert {(r.period, r.geo_code, r.source, r.data_available) for r in none} == {(None, "SPAIN", "fallback", False), (None, "EGYPT", "fallback", False)}
