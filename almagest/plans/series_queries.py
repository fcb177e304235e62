"""Registered series queries: Spark plan + DuckDB oracle text for each."""

from __future__ import annotations


from almagest.operators import series as S
from almagest.plans import forecast_queries as FQ
from almagest.plans import oracle_base as O
from almagest.sources import batches as B
from almagest.sources import canonical as C

KEY = "source, indicator, geo_code, measure"
PAGE = dict(indicator="revenue", geo="EUROPE", from_period="1996-01", to_period="2000-12",
            page_no=2, page_size=12)
AS_OF_MONTH = 3
PAIR = dict(indicator="revenue", geo_a="EUROPE", geo_b="ASIA", periods=24)
EXCLUDE = ("1998-03", "1999-06")
TS_COLS = ["source", "indicator", "geo_level", "geo_code", "period", "measure", "value",
           "fetched_at", "freq", "t", "period_start"]


def _ts(spark, sf):
    return C.time_series(spark, sf)


def _key_eq(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in ("source", "indicator", "geo_code", "measure"))


# ---- q08_yoy -------------------------------------------------------------
def q08_yoy(spark, sf):
    return S.yoy_matrix(_ts(spark, sf))


Q08_SQL = O.with_(O.TIME_SERIES, "m AS (SELECT * FROM time_series WHERE freq = 'M' AND value IS NOT NULL)") + f"""
SELECT a.source, a.indicator, a.geo_code, a.measure,
       CAST(year(a.period_start) AS INTEGER) AS year,
       CAST(month(a.period_start) - 1 AS INTEGER) AS month,
       a.value, {O.pct_change('a.value', 'b.value')} AS yoy_change
FROM m a LEFT JOIN m b ON {_key_eq('a', 'b')} AND b.t = a.t - 12"""


# ---- w01_latest ------------------------------------------------------------
def w01_latest(spark, sf):
    return S.latest_per_series(_ts(spark, sf))


W01_SQL = O.with_(O.TIME_SERIES) + f"""
SELECT {KEY}, freq, r.period AS latest_period, r.value AS latest_value, r.t AS t,
       r.fetched_at AS fetched_at
FROM (SELECT {KEY}, freq,
             arg_max(struct_pack(period := period, value := value, t := t, fetched_at := fetched_at), t) AS r
      FROM time_series GROUP BY ALL)"""


# ---- q01_kpis, j02_prior ---------------------------------------------------------
KPIS = {"orders": ("orders", "M"), "revenue": ("revenue", "Q"), "buyers": ("buyers", "A"), "shipped": ("quantity", "M")}


def q01_kpis(spark, sf):
    return S.kpi_snapshot(_ts(spark, sf), KPIS)


def j02_prior(spark, sf):
    """Prior-year value of every point of months, quarters and years."""
    ts = _ts(spark, sf).select(*KEY.split(", "), "freq", "period", "t", "value")
    return S.with_prior_year(ts)


_STEPS = "CASE a.freq WHEN 'M' THEN 12 WHEN 'Q' THEN 4 ELSE 1 END"
J02_SQL = O.with_(O.TIME_SERIES) + f"""
SELECT a.source, a.indicator, a.geo_code, a.measure, a.freq, a.period, a.t, a.value, b.value AS prev_value
FROM time_series a LEFT JOIN time_series b ON {_key_eq('a', 'b')} AND b.freq = a.freq AND b.t = a.t - {_STEPS}"""


def _q01_sql():
    wanted = " OR ".join(f"(a.indicator = '{i}' AND a.freq = '{f}')" for i, f in KPIS.values())
    piv = []
    for name, (i, f) in KPIS.items():
        sel = f"indicator = '{i}' AND freq = '{f}'"
        piv += [f"max(CASE WHEN {sel} THEN latest_value END) AS {name}_value",
                f"max(CASE WHEN {sel} THEN latest_period END) AS {name}_period",
                f"max(CASE WHEN {sel} THEN yoy END) AS {name}_yoy"]
    first = f"max(CASE WHEN indicator = '{KPIS['orders'][0]}' AND freq = '{KPIS['orders'][1]}' THEN latest_value END)"
    return O.with_(O.TIME_SERIES, f"""base AS (
  SELECT a.*, b.value AS prev_value FROM time_series a
  LEFT JOIN time_series b ON {_key_eq('a', 'b')} AND b.freq = a.freq AND b.t = a.t - {_STEPS}
  WHERE {wanted})""", f"""lat AS (
  SELECT {KEY}, freq, r.period AS latest_period, r.value AS latest_value,
         {O.pct_change('r.value', 'r.prev_value')} AS yoy
  FROM (SELECT {KEY}, freq, arg_max(struct_pack(period := period, value := value, prev_value := prev_value), t) AS r
        FROM base GROUP BY ALL))""") + f"""
SELECT geo_code, measure, {', '.join(piv)}, (SELECT max(fetched_at) FROM time_series) AS last_updated,
       {first} IS NOT NULL AS data_available, CASE WHEN {first} IS NULL THEN 'no_data_available' END AS reason
FROM lat GROUP BY geo_code, measure"""


# ---- w02_last_n ----------------------------------------------------------------
def w02_last_n(spark, sf):
    return S.last_n(_ts(spark, sf), 24).select(*TS_COLS, "pos")


W02_SQL = O.with_(O.TIME_SERIES) + f"""
SELECT {', '.join(TS_COLS)}, CAST(25 - rn AS INTEGER) AS pos
FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}, freq ORDER BY t DESC) AS rn
      FROM time_series)
WHERE rn <= 24"""


# ---- q06_series --------------------------------------------------------------
def q06_series(spark, sf):
    return S.page(_ts(spark, sf), **PAGE)


Q06_SQL = O.with_(O.TIME_SERIES, f"""s AS (
  SELECT period, value FROM time_series
  WHERE indicator = '{PAGE["indicator"]}' AND geo_code = '{PAGE["geo"]}' AND measure = 'ABSOLUTE'
    AND freq = 'M' AND period >= '{PAGE["from_period"]}' AND period <= '{PAGE["to_period"]}'
    AND value IS NOT NULL)""") + f"""
SELECT p.period, p.value, t.total, {PAGE['page_no']} AS page, {PAGE['page_size']} AS page_size,
       CAST(ceil(t.total / {PAGE['page_size']}.0) AS BIGINT) AS total_pages
FROM (SELECT * FROM s ORDER BY period LIMIT {PAGE['page_size']}
      OFFSET {(PAGE['page_no'] - 1) * PAGE['page_size']}) p
CROSS JOIN (SELECT count(*) AS total FROM s) t"""


# ---- a06_catalogue ------------------------------------------------------------
def a06_catalogue(spark, sf):
    return S.catalogue(_ts(spark, sf))


A06_SQL = O.with_(O.TIME_SERIES) + """
SELECT indicator, source, freq, min(period) AS available_from, max(period) AS available_to,
       count(*) AS total_points, max(fetched_at) AS last_updated
FROM time_series GROUP BY indicator, source, freq"""


# ---- a20_forecastable ---------------------------------------------------------
def a20_forecastable(spark, sf):
    return S.forecastable(_ts(spark, sf), 36)


A20_SQL = O.with_(O.TIME_SERIES) + f"""
SELECT {KEY}, count(*) AS n_obs FROM time_series
WHERE freq = 'M' AND value IS NOT NULL GROUP BY {KEY} HAVING count(*) >= 36"""


# ---- a07_seasonal ---------------------------------------------------------------
def a07_seasonal(spark, sf):
    return S.seasonal_profile(_ts(spark, sf))


_PROFILE = f"""prof AS (
  SELECT {KEY}, CAST(month(period_start) AS INTEGER) AS month_number,
         {O.avg_exact('value')} AS avg_value, count(*) AS n_years
  FROM time_series WHERE freq = 'M' AND value IS NOT NULL
  GROUP BY {KEY}, month(period_start))"""

A07_SQL = O.with_(O.TIME_SERIES, _PROFILE) + "SELECT * FROM prof"


# ---- q04_position ------------------------------------------------------------
def q04_position(spark, sf):
    """Outlook from the stored forecasts of a fleet in which some series could
    not be fitted: those fall back to their history, or to the overall mean."""
    store = FQ.faulty_store(spark, sf)
    stored = store.current("points").filter("model = 'ensemble'")
    return S.seasonal_position(FQ.faulty_facts(spark, sf), AS_OF_MONTH, stored)


def _q04_sql(m=AS_OF_MONTH):
    nxt = [((m - 1 + i) % 12) + 1 for i in range(1, 4)]

    def cls(v):
        return (f"CASE WHEN per.overall_avg IS NULL OR per.overall_avg <= 0 THEN 'Moderate' "
                f"WHEN ({v}) / per.overall_avg >= 1.10 THEN 'High' "
                f"WHEN ({v}) / per.overall_avg <= 0.90 THEN 'Low' ELSE 'Moderate' END")

    def mv(mm):
        return f"max(CASE WHEN p.month_number = {mm} THEN p.avg_value END)"

    past = f"(0.0 + {' + '.join(f'coalesce({mv(x)}, per.overall_avg)' for x in nxt)}) / 3.0"
    names = " || ',' || ".join(f"monthname(make_date(2000, {x}, 1))" for x in nxt)
    layers = " || ',' || ".join(f"CASE WHEN {mv(x)} IS NULL THEN 'overall' ELSE 'history' END" for x in nxt)
    return O.with_(O.TIME_SERIES, *FQ.FAULTY_RUN, _PROFILE.replace("FROM time_series", "FROM faulty"), f"""per AS (
  SELECT {KEY}, CAST(sum(CAST(avg_value AS DECIMAL(38,4))) AS DOUBLE) / count(*) AS overall_avg,
         first(month_number ORDER BY avg_value DESC, month_number) AS peak_month_number,
         string_agg(monthname(make_date(2000, month_number, 1)) || '=' || CAST({O.round2('avg_value', 0)} AS BIGINT), ','
                    ORDER BY month_number) AS monthly_averages
  FROM prof GROUP BY {KEY})""", f"""ahead AS (
  SELECT {KEY}, (0.0 + sum(CAST(v AS DECIMAL(38,4)))) / count(*) AS avg_ahead, string_agg('forecast', ',') AS layers
  FROM (SELECT {KEY}, t % 12 + 1 AS month_number, {O.avg_exact('value_predicted')} AS v FROM faulty_four
        WHERE model = 'ensemble' AND t % 12 + 1 IN ({', '.join(map(str, nxt))}) GROUP BY ALL) GROUP BY {KEY})""") + f"""
SELECT per.source, per.indicator, per.geo_code, per.measure, per.peak_month_number,
       monthname(make_date(2000, per.peak_month_number, 1)) AS peak_month,
       {O.round2('per.overall_avg', 4)} AS overall_avg,
       monthname(make_date(2000, {m}, 1)) AS current_month,
       {cls(f'coalesce({mv(m)}, per.overall_avg)')} AS current_position,
       {cls(f'coalesce(max(a.avg_ahead), {past})')} AS next_3_months,
       {names} AS next_months, coalesce(max(a.layers), {layers}) AS outlook_layers, per.monthly_averages
FROM per JOIN prof p ON {_key_eq('per', 'p')} LEFT JOIN ahead a ON {_key_eq('a', 'per')}
GROUP BY per.source, per.indicator, per.geo_code, per.measure, per.peak_month_number, per.overall_avg, per.monthly_averages"""


# ---- u03_gaps -------------------------------------------------------------------
def u03_gaps(spark, sf):
    return S.gaps(B.with_gaps(_ts(spark, sf)))


#: The facts without some nation-months and region-quarters (``batches.with_gaps``).
_GAPS = f"""gappy AS (SELECT * FROM time_series
  WHERE NOT (geo_level = 'nation' AND freq = 'M' AND (length(geo_code) + t) % {B.GAP_MONTHS} = 0)
    AND NOT (freq = 'Q' AND (length(geo_code) + t) % {B.GAP_QUARTERS} = 0))"""

U03_SQL = O.with_(O.TIME_SERIES, _GAPS, f"""b AS (SELECT {KEY}, freq, min(t) AS lo, max(t) AS hi FROM gappy GROUP BY {KEY}, freq),
sp AS (SELECT {KEY}, freq, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS t FROM b)""") + f"""
SELECT sp.source, sp.indicator, sp.geo_code, sp.measure, sp.freq, sp.t,
       CASE sp.freq WHEN 'M' THEN printf('%04d-%02d', sp.t // 12, sp.t % 12 + 1)
                    WHEN 'Q' THEN printf('%04d-Q%d', sp.t // 4, sp.t % 4 + 1) ELSE printf('%04d', sp.t) END AS missing_period
FROM sp WHERE NOT EXISTS (
  SELECT 1 FROM gappy m WHERE m.freq = sp.freq AND {_key_eq('m', 'sp')} AND m.t = sp.t)"""


# ---- window operators over all monthly series (W03, W04, W06, W07, M02) ---------
def _months(spark, sf):
    return C.monthly(_ts(spark, sf)).select(*S.SERIES_KEY, "t", "period", "value")


def w03_lags(spark, sf):
    return S.with_lags(_months(spark, sf))


_NATION = f"""nm AS (SELECT {KEY}, t, period, value FROM time_series
  WHERE freq = 'M' AND measure = 'ABSOLUTE')"""


def _w(lo, hi):
    return f"OVER (PARTITION BY {KEY} ORDER BY t RANGE BETWEEN {lo} AND {hi})"


W03_SQL = O.with_(O.TIME_SERIES, _NATION) + f"""
SELECT {KEY}, t, period, value,
       first_value(value) {_w('1 PRECEDING', '1 PRECEDING')} AS lag_1,
       first_value(value) {_w('3 PRECEDING', '3 PRECEDING')} AS lag_3,
       first_value(value) {_w('6 PRECEDING', '6 PRECEDING')} AS lag_6,
       first_value(value) {_w('12 PRECEDING', '12 PRECEDING')} AS lag_12
FROM nm"""


def w04_rolling(spark, sf):
    return S.with_rolling_mean(_months(spark, sf))


def _roll(k):
    w = _w(f"{k - 1} PRECEDING", "CURRENT ROW")
    return (f"CASE WHEN count(value) {w} = {k} THEN "
            f"CAST(sum({O.exact('value')}) {w} AS DOUBLE) / {k} END AS roll_{k}")


W04_SQL = O.with_(O.TIME_SERIES, _NATION) + f"""
SELECT {KEY}, t, period, value, {_roll(3)}, {_roll(12)} FROM nm"""


def w06_seasonal_diff(spark, sf):
    return S.seasonal_difference(_months(spark, sf))


W06_SQL = O.with_(O.TIME_SERIES, _NATION) + f"""
SELECT {KEY}, t, period, value,
       value - first_value(value) {_w('12 PRECEDING', '12 PRECEDING')} AS seasonal_diff
FROM nm"""


def _interp_spark(df):
    spine = S.monthly_spine(df)
    return S.interpolate(spine).select(*S.SERIES_KEY, "t", "period", "value", "value_filled")


def w07_interpolate(spark, sf):
    return _interp_spark(C.monthly(B.with_gaps(_ts(spark, sf))))


def m02_exclude(spark, sf):
    m = C.monthly(B.with_gaps(_ts(spark, sf)))
    return _interp_spark(S.exclude_window(m, *EXCLUDE))


def _interp_sql(value_expr: str) -> str:
    rows_p = f"OVER (PARTITION BY {KEY} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows_n = f"OVER (PARTITION BY {KEY} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return O.with_(O.TIME_SERIES, _GAPS, f"""nm AS (SELECT {KEY}, t, {value_expr} AS value FROM gappy
  WHERE freq = 'M' AND measure = 'ABSOLUTE')""", f"""b AS (SELECT {KEY}, min(t) AS lo, max(t) AS hi FROM nm GROUP BY {KEY}),
sp AS (SELECT {KEY}, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS t FROM b)""", f"""j AS (
  SELECT sp.source, sp.indicator, sp.geo_code, sp.measure, sp.t,
         printf('%04d-%02d', sp.t // 12, sp.t % 12 + 1) AS period, nm.value
  FROM sp LEFT JOIN nm ON {_key_eq('sp', 'nm')} AND nm.t = sp.t)""", f"""f AS (
  SELECT *, last_value(value IGNORE NULLS) {rows_p} AS pv,
         last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) {rows_p} AS pt,
         first_value(value IGNORE NULLS) {rows_n} AS nv,
         first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) {rows_n} AS nt
  FROM j)""") + f"""
SELECT {KEY}, t, period, value,
       CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
            ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END AS value_filled
FROM f"""


W07_SQL = _interp_sql("value")
M02_SQL = _interp_sql(f"CASE WHEN period BETWEEN '{EXCLUDE[0]}' AND '{EXCLUDE[1]}' THEN NULL ELSE value END")


# ---- q19_compare ----------------------------------------------------------------
def q19_compare(spark, sf):
    return S.compare_pair(_ts(spark, sf), **PAIR)


def _q19_sql(p=PAIR):
    n = p["periods"]
    return O.with_(O.TIME_SERIES, f"""base AS (
  SELECT a.geo_code, a.period, a.t, a.value, {O.pct_change('a.value', 'b.value')} AS yoy
  FROM time_series a LEFT JOIN time_series b ON {_key_eq('a', 'b')} AND b.freq = a.freq AND b.t = a.t - 12
  WHERE a.indicator = '{p['indicator']}' AND a.measure = 'ABSOLUTE' AND a.freq = 'M'
    AND a.geo_code IN ('{p['geo_a']}', '{p['geo_b']}'))""", f"""r AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY geo_code ORDER BY t DESC) AS rn FROM base)
  WHERE rn <= {n})""", f"""a AS (SELECT period, value AS value_a, yoy AS yoy_a FROM r WHERE geo_code = '{p['geo_a']}')""",
                     f"""b AS (SELECT period, value AS value_b, yoy AS yoy_b FROM r WHERE geo_code = '{p['geo_b']}')""") + f"""
SELECT coalesce(a.period, b.period) AS period, value_a, value_b, value_a - value_b AS difference,
       {O.round2('CASE WHEN value_b <> 0 THEN value_a / value_b END * 100.0', 2)} AS ratio_pct,
       yoy_a, yoy_b,
       CASE WHEN value_a > value_b THEN '{p['geo_a']}' WHEN value_b > value_a THEN '{p['geo_b']}' END AS leader
FROM a FULL OUTER JOIN b ON a.period = b.period"""


SIDES = dict(side_a=("buyers", "EUROPE"), side_b=("orders", "EUROPE"), periods=24)


def q20_ratio(spark, sf):
    return S.compare_sides(_ts(spark, sf), **SIDES)


def _q20_sql(p=SIDES):
    (ia, ga), (ib, gb), n = p["side_a"], p["side_b"], p["periods"]
    def side(ind, geo, tag):
        return (f"{tag} AS (SELECT period, value AS value_{tag} FROM (SELECT *, row_number() OVER (ORDER BY t DESC) AS rn "
                f"FROM time_series WHERE indicator = '{ind}' AND geo_code = '{geo}' AND measure = 'ABSOLUTE' "
                f"AND freq = 'M') WHERE rn <= {n})")
    return O.with_(O.TIME_SERIES, side(ia, ga, "a"), side(ib, gb, "b")) + f"""
SELECT coalesce(a.period, b.period) AS period, value_a, value_b,
       {O.round2('CASE WHEN value_b <> 0 THEN value_a / value_b END * 100.0', 2)} AS ratio_pct,
       {O.round2('CASE WHEN value_a + value_b <> 0 THEN value_a / (value_a + value_b) END * 100.0', 1)} AS share_a_pct
FROM a FULL OUTER JOIN b ON a.period = b.period"""


ALIGN = [("orders", "EUROPE"), ("orders", "ASIA"), ("quantity", "AMERICA")]


def j16_align(spark, sf):
    return S.align(_ts(spark, sf), ALIGN, 12)


def _j16_sql():
    cases = " ".join(f"WHEN indicator = '{i}' AND geo_code = '{g}' THEN 's{k}'" for k, (i, g) in enumerate(ALIGN, 1))
    conds = " OR ".join(f"(indicator = '{i}' AND geo_code = '{g}')" for i, g in ALIGN)
    cols = ", ".join(f"max(CASE WHEN side = 's{k}' THEN value END) AS s{k}" for k in range(1, len(ALIGN) + 1))
    return O.with_(O.TIME_SERIES, f"""r AS (SELECT period, value, CASE {cases} END AS side FROM time_series
  WHERE ({conds}) AND measure = 'ABSOLUTE' AND freq = 'M')""") + f"""
SELECT period, {cols} FROM r GROUP BY period ORDER BY period DESC LIMIT 12"""


QUERIES = {
    "j16_align": j16_align,
    "q20_ratio": q20_ratio,
    "q08_yoy": q08_yoy,
    "w01_latest": w01_latest,
    "q01_kpis": q01_kpis,
    "j02_prior": j02_prior,
    "w02_last_n": w02_last_n,
    "q06_series": q06_series,
    "a06_catalogue": a06_catalogue,
    "a20_forecastable": a20_forecastable,
    "a07_seasonal": a07_seasonal,
    "q04_position": q04_position,
    "u03_gaps": u03_gaps,
    "w03_lags": w03_lags,
    "w04_rolling": w04_rolling,
    "w06_seasonal_diff": w06_seasonal_diff,
    "w07_interpolate": w07_interpolate,
    "m02_exclude": m02_exclude,
    "q19_compare": q19_compare,
}

ORACLE = {
    "j16_align": _j16_sql(),
    "q20_ratio": _q20_sql(),
    "q08_yoy": Q08_SQL,
    "w01_latest": W01_SQL,
    "q01_kpis": _q01_sql(),
    "j02_prior": J02_SQL,
    "w02_last_n": W02_SQL,
    "q06_series": Q06_SQL,
    "a06_catalogue": A06_SQL,
    "a20_forecastable": A20_SQL,
    "a07_seasonal": A07_SQL,
    "q04_position": _q04_sql(),
    "u03_gaps": U03_SQL,
    "w03_lags": W03_SQL,
    "w04_rolling": W04_SQL,
    "w06_seasonal_diff": W06_SQL,
    "w07_interpolate": W07_SQL,
    "m02_exclude": M02_SQL,
    "q19_compare": _q19_sql(),
}
