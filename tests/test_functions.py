"""Scalar and period functions on tiny hand-made rows (reference parsers and
validators are tested the same way)."""

from pyspark.sql import functions as F

from almagest.functions import period as P
from almagest.functions import scalars as X


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_safe_float_rejects_suffixes_and_placeholders(spark):
    vals = ["5", " 5 ", "5d", "5f", "_Z", "", "1e3", "-2.5", "nan", "1_000", None, "abc"]
    out = _one(spark, [(v,) for v in vals], "x string", X.safe_float("x"))
    assert out == [5.0, 5.0, None, None, None, None, 1000.0, -2.5, None, None, None, None]


def test_safe_int_truncates(spark):
    out = _one(spark, [("7.9",), ("-3.2",), ("_U",)], "x string", X.safe_int("x"))
    assert out == [7, -3, None]


def test_finite_or_default(spark):
    out = _one(spark, [(1.5,), (None,), (float("nan"),), (float("inf"),)], "x double", X.finite_or("x", 0.0))
    assert out == [1.5, 0.0, 0.0, 0.0]


def test_pct_change_guards(spark):
    rows = [(110.0, 100.0), (5.0, 0.0), (5.0, None), (1.0, 3.0)]
    out = _one(spark, rows, "c double, p double", X.pct_change(F.col("c"), F.col("p")))
    assert out == [10.0, None, None, -66.67]


def test_measure_and_reasonable(spark):
    rows = [("alojatur_ocupacion",), ("hotel_adr",), ("turistas",)]
    assert _one(spark, rows, "i string", X.measure_of("i")) == ["PERCENTAGE_RATE", "RATE", "ABSOLUTE"]
    rows = [(150.0, "RATE"), (250.0, "RATE"), (-1.0, "ABSOLUTE")]
    assert _one(spark, rows, "v double, m string", X.is_reasonable("v", "m")) == [True, False, False]


def test_classify_position(spark):
    rows = [(110.0, 100.0), (90.0, 100.0), (100.0, 100.0), (5.0, 0.0)]
    out = _one(spark, rows, "v double, a double", X.classify_position("v", "a"))
    assert out == ["High", "Low", "Moderate", "Moderate"]


def test_segment_name(spark):
    rows = [(400.0, 30.0, 3.0), (1000.0, 55.0, 10.0), (1500.0, 60.0, 12.0)]
    out = _one(spark, rows, "s double, a double, n double", X.segment_name("s", "a", "n"))
    assert out == ["Budget / Young / Short-stay", "Mid-spend / Mid-age / Medium-stay",
                   "Premium / Older / Long-stay"]


def test_importance_and_flags(spark):
    rows = [("NADA",), ("mucho",), ("_Z",), (None,)]
    assert _one(spark, rows, "x string", X.importance_score("x")) == [0.0, 3.0, None, None]
    rows = [("1",), ("6",), (None,)]
    assert _one(spark, rows, "x string", X.binary_flag("x")) == [1.0, 0.0, 0.0]


def test_display_name_and_slug(spark):
    assert _one(spark, [("DESGLOSE_ALQ_VEHIC",)], "x string", X.display_name("x", "DESGLOSE_")) == ["Alq Vehic"]
    assert _one(spark, [("Tourists. Total Arrivals",)], "x string", X.slug("x")) == ["tourists_total_arrivals"]


def test_intensity_class(spark):
    rows = [(0,), (30,), (50,), (70,), (85,), (100,)]
    assert _one(spark, rows, "x int", X.intensity_class("x")) == [0, 1, 2, 3, 4, 4]


def test_period_grammar(spark):
    rows = [("2025-03",), ("2025-Q1",), ("2025Q4",), ("2025",), ("2025-13",), ("25-01",)]
    df = spark.createDataFrame(rows, "p string")
    out = df.select(P.freq("p"), P.ordinal("p"), P.period_start("p").cast("string")).collect()
    assert [tuple(r) for r in out] == [
        ("M", 2025 * 12 + 2, "2025-03-01"), ("Q", 2025 * 4, "2025-01-01"),
        ("Q", 2025 * 4 + 3, "2025-10-01"), ("A", 2025, "2025-01-01"),
        (None, None, None), (None, None, None)]
    assert _one(spark, rows, "p string", P.is_valid_period("p")) == [True, True, True, True, True, False]


def test_source_period_codes(spark):
    rows = [(2024, 3), (2024, 19), (2024, 22), (2024, 99)]
    out = _one(spark, rows, "y int, c int", P.quarter_from_source_code("y", "c"))
    assert out == ["2024-03", "2024-Q1", "2024-Q4", None]


def test_quarter_from_text(spark):
    rows = [("Microdatos 2024Q3",), ("egt 2024-q2",), ("Encuesta T1 2023",),
            ("3er trimestre 2022",), ("sin trimestre",)]
    out = _one(spark, rows, "x string", P.quarter_from_text("x"))
    assert out == ["2024Q3", "2024Q2", "2023Q1", "2022Q3", None]


def test_months_of_range_and_shift(spark):
    import datetime as dt
    rows = [(dt.date(2023, 11, 20), dt.date(2024, 2, 1)), (dt.date(2024, 5, 5), None)]
    out = _one(spark, rows, "s date, e date", P.months_of_range("s", "e"))
    assert out == [["2023-11", "2023-12", "2024-01", "2024-02"], ["2024-05"]]
    assert _one(spark, [("2024-03",), ("2024-Q2",)], "p string", P.shift_year("p", -1)) == ["2023-03", "2023-Q2"]


def test_month_names(spark):
    out = _one(spark, [(12,)], "m int", P.next_months("m"))
    assert out == [[1, 2, 3]]
    assert _one(spark, [(1,)], "m int", P.month_name("m")) == ["January"]


def test_rounding_keeps_small_large_and_negative_values(spark):
    import duckdb

    from almagest.operators import series as S
    from almagest.plans import oracle_base as O

    values = [0.004, -2.5, 2.5, 1.005, 5e17, -5e17, 1e22, 0.0, 123456.785]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    con = duckdb.connect()
    con.execute("CREATE TABLE x AS SELECT unnest(?::DOUBLE[]) AS v", [values])
    for d in (0, 1, 2):
        got = [r[0] for r in df.select(X.round2("v", d)).collect()]
        assert got == [r[0] for r in con.sql(f"SELECT {O.round2('v', d)} FROM x").fetchall()]
    assert [r[0] for r in df.select(X.round2("v", 0)).collect()][1:3] == [-3.0, 3.0]
    assert [r[0] for r in df.select(X.round2("v", 2)).collect()][4] == 5e17
    small = spark.createDataFrame([(0.004,), (0.004,)], "v double")
    assert small.agg(S.avg_exact("v")).first()[0] == 0.004


def test_change_of_small_and_offsetting_values_is_seen(spark):
    from almagest.operators import quality as V

    cols = "k string, t int, value double"
    before = spark.createDataFrame([("a", 1, 0.004), ("b", 1, 5.0), ("b", 2, 4.0), ("c", 1, None), ("d", 1, 1.0)], cols)
    after = spark.createDataFrame([("a", 1, 0.001), ("b", 1, 3.0), ("b", 2, 5.0), ("c", 1, None), ("e", 1, 1.0)], cols)
    got = {r.k: r.status for r in V.changed_series(before, after, ["k"]).collect()}
    assert got == {"a": "changed", "b": "changed", "d": "gone", "e": "new"}


def test_flags_of_odd_texts(spark):
    texts = ["1", "6", "0", " ", "", None, "x", "１", " 1", "01", "1.0", "10", "_Z", "1e0"]
    assert _one(spark, [(t,) for t in texts], "x string", X.binary_flag("x")) == [1.0] + [0.0] * 7 + [1.0] * 3 + [0.0] * 2 + [1.0]
    plan = spark.range(1).select(X.binary_flag(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "length(" in plan  # a single letter is settled without parsing
