"""Registered validation, merge, versioning and health queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.functions import scalars as X
from almagest.operators import quality as V
from almagest.operators import sinks as K
from almagest.operators import training as R
from almagest.operators.versions import appended
from almagest.plans import forecast_queries as FQ
from almagest.plans import oracle_base as O
from almagest.sources import batches as B
from almagest.sources import canonical as C

AS_OF_YEAR = 2001
AS_OF = "2001-12-31"
SOURCES = ("orders", "lineitem")
SERIES = ["source", "indicator", "geo_code", "measure"]

_NUM_RE = X._NUMBER_RE


def _safe_float_sql(x: str) -> str:
    return (f"CASE WHEN trim({x}) NOT IN ('_Z','_U','_N','_Y','') AND regexp_matches(trim({x}), '{_NUM_RE}') "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END")


f = B.TS_FAULTS
TS_LAND = f"""r AS (SELECT * FROM time_series),
rc AS (SELECT *, 0 AS copy FROM r UNION ALL SELECT *, 1 FROM r WHERE t % {f['duplicate']} = 0
       UNION ALL SELECT *, 2 FROM r WHERE t % {f['upper_indicator_copy']} = 0),
land AS (
  SELECT CASE WHEN t % {f['upper_source']} = 0 THEN upper(source) ELSE source END AS source,
         CASE WHEN copy = 2 THEN upper(indicator) ELSE indicator END AS indicator, geo_code,
         CASE WHEN t % {f['old_year']} = 0 THEN '1985' || substr(period, 5, 10)
              WHEN t % {f['slash_period']} = 0 THEN replace(period, '-', '/') ELSE period END AS period,
         measure,
         CASE WHEN t % {f['null_value']} = 0 THEN NULL WHEN t % {f['not_numeric']} = 0 THEN 'n/a'
              WHEN t % {f['negative']} = 0 THEN CAST(-value AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value,
         CAST(t AS BIGINT) * 10 + copy AS ingest_seq
  FROM rc)"""

_SRC = ", ".join(f"'{s}'" for s in SOURCES)
_MISSING = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in V.TS_FIELDS)
_VALID_PERIOD = ("(regexp_matches(period, '^[0-9]{4}-[0-9]{2}$') OR regexp_matches(period, '^[0-9]{4}-Q[1-4]$') "
                 "OR regexp_matches(period, '^[0-9]{4}Q[1-4]$') OR regexp_matches(period, '^[0-9]{4}$'))")
_REASONABLE = ("CASE WHEN measure IN ('PERCENTAGE_RATE', 'ANNUAL_PERCENTAGE_RATE', 'RATE') "
               "THEN value_n BETWEEN -100.0 AND 200.0 ELSE value_n >= 0 END")

TS_CHECK = TS_LAND + f""",
c1 AS (SELECT *, lower(source) AS source_n, lower(indicator) AS indicator_n,
              {_safe_float_sql('value')} AS value_n, {_MISSING} AS n_missing,
              CASE WHEN regexp_extract(period, '^([0-9]{{4}})', 1) <> ''
                   THEN CAST(regexp_extract(period, '^([0-9]{{4}})', 1) AS INTEGER) END AS yr
       FROM land),
c2 AS (SELECT *, n_missing = 0 AND value_n IS NULL AS e_type, n_missing = 0 AND value_n IS NOT NULL AS ok1 FROM c1),
c3 AS (SELECT *, ok1 AND yr IS NOT NULL AND (yr < 1990 OR yr > {AS_OF_YEAR + 5}) AS e_year FROM c2),
chk AS (SELECT *, ok1 AND NOT e_year AS is_valid,
               n_missing + CAST(e_type AS INTEGER) + CAST(e_year AS INTEGER) AS n_err,
               CAST(ok1 AND source_n NOT IN ({_SRC}) AS INTEGER)
               + CAST(ok1 AND NOT {_VALID_PERIOD} AS INTEGER)
               + CAST(ok1 AND NOT e_year AND NOT ({_REASONABLE}) AS INTEGER) AS n_warn
        FROM c3)"""


def _ts(spark, sf):
    return C.time_series(spark, sf)


def v01_validate(spark, sf):
    valid, _ = V.validate_timeseries(B.ts_landing(_ts(spark, sf)), AS_OF_YEAR, SOURCES)
    return valid


V01_SQL = O.with_(O.TIME_SERIES, TS_CHECK) + """
SELECT source_n AS source, indicator_n AS indicator, geo_code, period, measure,
       arg_min(value_n, ingest_seq) AS value
FROM chk WHERE is_valid GROUP BY source_n, indicator_n, geo_code, period, measure"""


def a26_counters(spark, sf):
    _, checked = V.validate_timeseries(B.ts_landing(_ts(spark, sf)), AS_OF_YEAR, SOURCES)
    return V.counters(checked, ["source_n", "indicator_n", "geo_code", "period", "measure"])


A26_SQL = O.with_(O.TIME_SERIES, TS_CHECK, """k AS (
  SELECT count(*) AS records_checked,
         count(DISTINCT CASE WHEN is_valid THEN source_n || '|' || indicator_n || '|' || geo_code || '|'
                                              || period || '|' || measure END) AS records_valid,
         CAST(sum(CAST(is_valid AS INTEGER)) AS BIGINT) AS n_valid_pre,
         CAST(sum(n_err) AS BIGINT) AS error_count, CAST(sum(n_warn) AS BIGINT) AS warning_count
  FROM chk)""") + """
SELECT records_checked, records_valid, n_valid_pre - records_valid AS duplicates_removed,
       records_checked - n_valid_pre AS records_dropped, error_count, warning_count
FROM k"""


def a26_issues(spark, sf):
    _, checked = V.validate_timeseries(B.ts_landing(_ts(spark, sf)), AS_OF_YEAR, SOURCES)
    return V.issues_by_field(checked)


def _a26_issues_sql():
    parts = [f"SELECT '{c}' AS field, 'error' AS severity FROM chk WHERE {c} IS NULL" for c in V.TS_FIELDS]
    parts += ["SELECT 'value', 'error' FROM chk WHERE e_type",
              f"SELECT 'source', 'warning' FROM chk WHERE ok1 AND source_n NOT IN ({_SRC})",
              f"SELECT 'period', 'warning' FROM chk WHERE ok1 AND NOT {_VALID_PERIOD}",
              "SELECT 'period', 'error' FROM chk WHERE e_year",
              f"SELECT 'value', 'warning' FROM chk WHERE ok1 AND NOT e_year AND NOT ({_REASONABLE})"]
    return O.with_(O.TIME_SERIES, TS_CHECK, "iss AS (" + " UNION ALL ".join(parts) + ")") + \
        "SELECT field, severity, count(*) AS n FROM iss GROUP BY field, severity"


mf = B.MICRO_FAULTS
MICRO_LAND = f"""mc0 AS (SELECT *, 0 AS copy FROM micro UNION ALL SELECT *, 1 FROM micro WHERE cuestionario % {mf['duplicate']} = 0),
mland AS (
  SELECT CASE WHEN cuestionario % {mf['no_quarter']} = 0 THEN NULL
              WHEN cuestionario % {mf['odd_quarter']} = 0 THEN lower(replace(quarter, 'Q', '-Q'))
              WHEN copy = 1 THEN lower(quarter) ELSE quarter END AS quarter,
         CASE WHEN cuestionario % {mf['no_id']} = 0 THEN NULL ELSE cuestionario END AS cuestionario,
         CASE WHEN cuestionario % {mf['old_age']} = 0 THEN 150 ELSE edad END AS edad,
         CASE WHEN cuestionario % {mf['long_stay']} = 0 THEN 400 ELSE noches END AS noches,
         CASE WHEN cuestionario % {mf['negative_spend']} = 0 THEN -gasto_euros ELSE gasto_euros END AS gasto_euros,
         coste_vuelos_euros, coste_aloj_euros, nacionalidad, cuestionario * 10 + copy AS ingest_seq
  FROM mc0),
mchk AS (SELECT *, upper(quarter) AS quarter_n,
                (quarter IS NOT NULL AND quarter <> '') AND cuestionario IS NOT NULL AS is_valid FROM mland)"""


def v02_validate(spark, sf):
    valid, _ = V.validate_microdata(B.micro_landing(C.microdata(spark, sf, with_raw=False)))
    return valid


_MCOLS = ["edad", "noches", "gasto_euros", "coste_vuelos_euros", "coste_aloj_euros", "nacionalidad"]
V02_SQL = O.with_(O.MICRO, MICRO_LAND) + f"""
SELECT quarter, cuestionario, {', '.join(f'r.{c} AS {c}' for c in _MCOLS)}
FROM (SELECT quarter_n AS quarter, cuestionario,
             arg_min(struct_pack({', '.join(f'{c} := {c}' for c in _MCOLS)}), ingest_seq) AS r
      FROM mchk WHERE is_valid GROUP BY quarter_n, cuestionario)"""


def k01_upsert(spark, sf):
    b1, b2 = B.upsert_batches(_ts(spark, sf))
    return K.upsert(b1, b2, V.TS_KEY, order="id").drop("id")


_BATCHES = """r AS (SELECT * FROM time_series),
b1 AS (SELECT source, indicator, geo_code, period, measure, value, 1 AS batch, CAST(t AS BIGINT) * 10 + 1 AS id
       FROM r WHERE t % 3 <> 0),
b2 AS (SELECT source, indicator, geo_code, period, measure,
              CASE WHEN indicator = 'revenue' THEN """ + O.round2("value * 1.1", 2) + """ ELSE value END AS value,
              2 AS batch, CAST(t AS BIGINT) * 10 + 2 AS id
       FROM r WHERE t % 3 <> 1)"""
_KEYJ = " AND ".join(f"b1.{k} = b2.{k}" for k in V.TS_KEY)

K01_SQL = O.with_(O.TIME_SERIES, _BATCHES) + f"""
SELECT source, indicator, geo_code, period, measure, value, batch FROM b1
WHERE NOT EXISTS (SELECT 1 FROM b2 WHERE {_KEYJ})
UNION ALL SELECT source, indicator, geo_code, period, measure, value, batch FROM b2"""


def k13_keep_newest(spark, sf):
    b1, b2 = B.upsert_batches(_ts(spark, sf))
    return K.keep_newest(b1.unionByName(b2), V.TS_KEY, "id")


K13_SQL = O.with_(O.TIME_SERIES, _BATCHES) + """
SELECT source, indicator, geo_code, period, measure, r.value AS value, r.batch AS batch, r.id AS id
FROM (SELECT source, indicator, geo_code, period, measure,
             arg_max(struct_pack(value := value, batch := batch, id := id), id) AS r
      FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2)
      GROUP BY source, indicator, geo_code, period, measure)"""


def k03_versions(spark, sf):
    batches = [b.drop("id", "batch") for b in B.upsert_batches(_ts(spark, sf))]
    return appended(spark, K.snapshot_path(spark, "versions"), SERIES, batches)


K03_SQL = O.with_(O.TIME_SERIES, _BATCHES, """v AS (
  SELECT source, indicator, geo_code, period, measure, value, 1 AS version FROM b1
  UNION ALL
  SELECT b2.source, b2.indicator, b2.geo_code, b2.period, b2.measure, b2.value,
         CAST(coalesce(mv.v, 0) + 1 AS INTEGER) AS version
  FROM b2 LEFT JOIN (SELECT source, indicator, geo_code, measure, max(1) AS v FROM b1 GROUP BY ALL) mv
    ON b2.source = mv.source AND b2.indicator = mv.indicator AND b2.geo_code = mv.geo_code
   AND b2.measure = mv.measure)""") + """
SELECT *, version = max(version) OVER (PARTITION BY source, indicator, geo_code, measure) AS is_current FROM v"""


def a27_fingerprint(spark, sf):
    return V.table_fingerprint(_ts(spark, sf))


A27_SQL = O.with_(O.TIME_SERIES, """g AS (SELECT count(*) AS n, max(period_start) AS max_period_start,
  max(fetched_at) AS max_fetched,
  CAST(sum(CAST('0x' || substr(md5(concat_ws('|', source, indicator, geo_code, period, measure,
           coalesce(CAST(CAST(round(value * 10000) AS BIGINT) AS VARCHAR), 'null'))), 1, 12) AS BIGINT)) AS VARCHAR) AS content
  FROM time_series)""") + """
SELECT n, max_period_start, max_fetched,
       substr(sha256(concat_ws('|', CAST(n AS VARCHAR), strftime(max_period_start, '%Y-%m-%d'),
                               strftime(max_fetched, '%Y-%m-%d %H:%M:%S'), content)), 1, 16) AS fingerprint
FROM g"""


def v10_changed(spark, sf):
    ts = _ts(spark, sf)
    revised = (ts.filter((F.col("indicator") == "revenue") & (F.col("geo_code") == "EUROPE"))
                 .withColumn("value", X.round2(F.col("value") * 1.1, 2)))
    added = (ts.filter((F.col("indicator") == "orders") & (F.col("geo_code") == "EUROPE"))
               .withColumn("geo_code", F.lit("EUROPE_ADJ")))
    after = K.upsert(ts, revised.unionByName(added), V.TS_KEY, order="t")
    return V.changed_series(ts, after, [*SERIES, "freq"])


V10_SQL = O.with_(O.TIME_SERIES, "ts AS (SELECT source, indicator, geo_code, period, measure, freq, value, t FROM time_series)",
                  """upd AS (
  SELECT source, indicator, geo_code, period, measure, freq, """ + O.round2("value * 1.1", 2) + """ AS value, t
  FROM ts WHERE indicator = 'revenue' AND geo_code = 'EUROPE'
  UNION ALL
  SELECT source, indicator, 'EUROPE_ADJ', period, measure, freq, value, t FROM ts
  WHERE indicator = 'orders' AND geo_code = 'EUROPE')""", """aft AS (
  SELECT * FROM ts
  WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.source = ts.source AND u.indicator = ts.indicator
                    AND u.geo_code = ts.geo_code AND u.period = ts.period AND u.measure = ts.measure)
  UNION ALL SELECT * FROM upd)""", """d AS (
  SELECT *, 'a' AS side FROM (SELECT * FROM ts EXCEPT ALL SELECT * FROM aft)
  UNION ALL SELECT *, 'b' FROM (SELECT * FROM aft EXCEPT ALL SELECT * FROM ts))""",
                  "k AS (SELECT DISTINCT source, indicator, geo_code, measure, freq FROM d)") + """
SELECT source, indicator, geo_code, measure, freq,
       CASE WHEN NOT EXISTS (SELECT 1 FROM ts WHERE (ts.source, ts.indicator, ts.geo_code, ts.measure, ts.freq)
                             = (k.source, k.indicator, k.geo_code, k.measure, k.freq)) THEN 'new'
            WHEN NOT EXISTS (SELECT 1 FROM aft WHERE (aft.source, aft.indicator, aft.geo_code, aft.measure, aft.freq)
                             = (k.source, k.indicator, k.geo_code, k.measure, k.freq)) THEN 'gone'
            ELSE 'changed' END AS status
FROM k"""


def v08_health(spark, sf):
    return V.health(_ts(spark, sf), C.microdata(spark, sf, with_raw=False), AS_OF)


V08_SQL = O.with_(O.TIME_SERIES, O.MICRO.split(",\n", 1)[1], f"""h AS (
  SELECT 'time_series' AS table_name, count(*) AS n_rows,
         max(CASE WHEN freq = 'M' THEN period END) AS latest_period, max(fetched_at) AS latest_fetch,
         count(DISTINCT (source, indicator, geo_code, measure)) AS n_keys FROM time_series
  UNION ALL
  SELECT 'microdata', count(*), max(quarter), CAST(NULL AS TIMESTAMP), count(DISTINCT nacionalidad) FROM micro)""",
                  """h2 AS (SELECT *, CASE WHEN regexp_matches(latest_period, '^[0-9]{4}-(0[1-9]|1[0-2])$')
                          THEN CAST(latest_period || '-01' AS DATE)
                          WHEN regexp_matches(latest_period, '^[0-9]{4}-?Q[1-4]$')
                          THEN make_date(CAST(substr(latest_period, 1, 4) AS INTEGER),
                                         (CAST(right(latest_period, 1) AS INTEGER) - 1) * 3 + 1, 1) END AS st FROM h)""") + f"""
SELECT table_name, n_rows, latest_period, latest_fetch, n_keys,
       CAST(date_diff('day', st, DATE '{AS_OF}') AS INTEGER) AS days_stale,
       CASE WHEN n_rows = 0 THEN 'empty' WHEN date_diff('day', st, DATE '{AS_OF}') > 30 THEN 'degraded'
            ELSE 'ok' END AS status
FROM h2"""


def v07_report(spark, sf):
    """Health with training and load state: predictions of a fleet in which
    some series failed, segments of a fixed label, loads of both tables."""
    ts, micro = _ts(spark, sf), C.microdata(spark, sf, with_raw=False)
    store = FQ.faulty_store(spark, sf)
    tables = V.health(ts, micro, AS_OF)
    load = lambda df, name, at: df.select(F.lit(name).alias("table_name"), at.alias("finished_at"),
                                          F.when(F.dayofyear(at) % 2 == 0, F.lit("success")).otherwise(F.lit("error")).alias("status"))
    loads = load(ts, "time_series", F.col("period_start").cast("date"))
    respondents = micro.withColumn("cluster_id", F.col("cuestionario") % 4)
    return V.report(tables, store.current("points"), R.run_status(store), respondents, loads)


V07_SQL = O.with_(O.TIME_SERIES, *FQ.FAULTY_RUN, f"tables AS ({V08_SQL.replace('WITH ', 'WITH ', 1)})") + f"""
SELECT t.*, p.n_predictions, p.n_models, p.n_forecast_series, p.last_run, p.n_failed_fits,
       CASE WHEN table_name = 'microdata' THEN (SELECT count(DISTINCT o_orderkey % 4) FROM orders) END AS n_segments, TRUE AS trained,
       CASE WHEN table_name = 'time_series' THEN (SELECT max(CAST(period_start AS DATE)) FROM time_series WHERE dayofyear(period_start) % 2 = 0) END AS last_success,
       CASE WHEN table_name = 'time_series' THEN (SELECT max(CAST(period_start AS DATE)) FROM time_series WHERE dayofyear(period_start) % 2 = 1) END AS last_failure
FROM tables t LEFT JOIN (
  SELECT 'time_series' AS table_name, (SELECT count(*) FROM faulty_four) AS n_predictions, 4 AS n_models,
         (SELECT count(DISTINCT (source, indicator, geo_code, measure)) FROM faulty_four) AS n_forecast_series, 1 AS last_run,
         (SELECT count(*) * 4 FROM checked WHERE reason IS NOT NULL) AS n_failed_fits) p USING (table_name)"""


QUERIES = {
    "v01_validate": v01_validate,
    "a26_counters": a26_counters,
    "a26_issues": a26_issues,
    "v02_validate": v02_validate,
    "k01_upsert": k01_upsert,
    "k13_keep_newest": k13_keep_newest,
    "k03_versions": k03_versions,
    "a27_fingerprint": a27_fingerprint,
    "v10_changed": v10_changed,
    "v08_health": v08_health,
    "v07_report": v07_report,
}

ORACLE = {
    "v01_validate": V01_SQL,
    "a26_counters": A26_SQL,
    "a26_issues": _a26_issues_sql(),
    "v02_validate": V02_SQL,
    "k01_upsert": K01_SQL,
    "k13_keep_newest": K13_SQL,
    "k03_versions": K03_SQL,
    "a27_fingerprint": A27_SQL,
    "v10_changed": V10_SQL,
    "v08_health": V08_SQL,
    "v07_report": V07_SQL,
}
