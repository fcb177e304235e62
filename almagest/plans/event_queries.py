"""Registered event, map and as-of queries with DuckDB oracles."""

from __future__ import annotations

from almagest.operators import events as E
from almagest.operators import regions as R
from almagest.plans import oracle_base as O
from almagest.sources import canonical as C
from almagest.sources.tables import read

IMPACT_INDICATORS = ["orders", "revenue", "buyers"]


def q22_impact(spark, sf):
    return E.event_impact(C.time_series(spark, sf), C.tourism_events(spark), IMPACT_INDICATORS)


def _events_values() -> str:
    rows = []
    for (i, name, desc, cat, sd, ed, imp, loc, src) in C.TOURISM_EVENTS:
        end = f"DATE '{ed.isoformat()}'" if ed else "CAST(NULL AS DATE)"
        rows.append(f"({i}, '{name}', '{cat}', DATE '{sd.isoformat()}', {end})")
    return ("ev(id, name, category, start_date, end_date) AS (VALUES " + ", ".join(rows) + ")")


def _q22_sql():
    inds = ", ".join(f"'{i}'" for i in IMPACT_INDICATORS)
    return O.with_(O.TIME_SERIES, _events_values(), """em AS (
  SELECT id, name, category, strftime(m, '%Y-%m') AS period,
         strftime(m - INTERVAL 12 MONTH, '%Y-%m') AS prev_period
  FROM (SELECT *, unnest(generate_series(date_trunc('month', start_date),
                                         date_trunc('month', coalesce(end_date, start_date)),
                                         INTERVAL 1 MONTH)) AS m FROM ev))""", f"""f AS (
  SELECT indicator, geo_code, period, value FROM time_series
  WHERE freq = 'M' AND indicator IN ({inds}) AND geo_level = 'region')""", """both_ AS (
  SELECT em.id, em.name, em.category, f.indicator, f.geo_code, TRUE AS is_cur, f.value
  FROM em JOIN f ON f.period = em.period
  UNION ALL
  SELECT em.id, em.name, em.category, f.indicator, f.geo_code, FALSE, f.value
  FROM em JOIN f ON f.period = em.prev_period)""", f"""g AS (
  SELECT id, name, category, indicator, geo_code,
         CAST(sum(CASE WHEN is_cur THEN {O.exact('value')} END) AS DOUBLE) / count(CASE WHEN is_cur THEN value END) AS ca,
         count(CASE WHEN is_cur THEN value END) AS n_current,
         CAST(sum(CASE WHEN NOT is_cur THEN {O.exact('value')} END) AS DOUBLE) / count(CASE WHEN NOT is_cur THEN value END) AS pa,
         count(CASE WHEN NOT is_cur THEN value END) AS n_previous
  FROM both_ GROUP BY id, name, category, indicator, geo_code)""") + f"""
SELECT CAST(id AS INTEGER) AS event_id, name AS event_name, category, indicator, geo_code, n_current, n_previous,
       {O.round2('ca', 4)} AS current_avg, {O.round2('pa', 4)} AS previous_avg,
       {O.pct_change('ca', 'pa')} AS yoy_change
FROM g"""


def q05_map(spark, sf):
    return R.intensity_map(C.time_series(spark, sf), C.geo_dim(spark, sf), ahead=2)


def _q05_sql():
    zones = " ".join(f"WHEN '{r}' THEN '{z}'" for r, z in R.REGION_ZONES.items())
    falls = " ".join(f"WHEN '{z}' THEN {f}" for z, f in R.FALLBACK_INTENSITIES.items())
    facs = " ".join(f"WHEN '{z}' THEN {f}" for z, f in R.ZONE_FACTORS.items())
    return O.with_(O.TIME_SERIES, """nm AS (
  SELECT source, indicator, geo_code, measure, t, value FROM time_series
  WHERE geo_level = 'nation' AND freq = 'M' AND indicator = 'orders'
    AND regexp_matches(period, '^[0-9]{4}-(0[1-9]|1[0-2])$'))""", """b AS (SELECT min(t) lo, max(t) hi FROM nm)""",
                   """sp AS (SELECT n_name AS geo_code, CAST(unnest(range(lo, hi + 3)) AS INTEGER) AS t FROM b, geo)""",
                   f"""c AS (
  SELECT printf('%04d-%02d', sp.t // 12, sp.t % 12 + 1) AS period, sp.geo_code, nm.value,
         CASE g.r_name {zones} END AS zone
  FROM sp LEFT JOIN nm ON nm.geo_code = sp.geo_code AND nm.t = sp.t
  LEFT JOIN geo g ON g.n_name = sp.geo_code)""", f"""d AS (
  SELECT *, max(value) OVER (PARTITION BY period) AS max_value,
         coalesce(CASE zone {facs} END, {R.DEFAULT_FACTOR}) AS factor,
         coalesce(CASE zone {falls} END, {R.DEFAULT_INTENSITY}) AS fallback FROM c)""", f"""e AS (
  SELECT period, geo_code, zone, value, max_value,
         CASE WHEN value IS NOT NULL THEN 'real' WHEN max_value IS NOT NULL THEN 'estimated' ELSE 'fallback' END AS source,
         max_value IS NOT NULL AS data_available,
         CAST(CASE WHEN value IS NOT NULL THEN
                (CASE WHEN max_value > 0 THEN least({O.round2('value / max_value * 100.0', 0)}, 100.0) ELSE 0.0 END)
              WHEN max_value IS NULL THEN fallback ELSE {O.round2('factor * 100.0', 0)} END AS INTEGER) AS intensity
  FROM d)""") + """
SELECT *, CASE WHEN intensity >= 85 THEN 4 WHEN intensity >= 70 THEN 3 WHEN intensity >= 50 THEN 2
               WHEN intensity >= 30 THEN 1 ELSE 0 END AS color_class
FROM e"""


def j17_asof_forward(spark, sf):
    ev = read(spark, sf, "events")
    return E.asof_forward(ev, "event_type", "ts", ["event_id", "value"])


J17_SQL = """WITH pts AS (SELECT event_type, ts, event_id, value FROM events),
b AS (SELECT event_type, min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM pts GROUP BY 1),
cur AS (SELECT event_type, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS TIMESTAMP)
               + INTERVAL 12 HOUR AS cursor FROM b),
fwd AS (SELECT c.event_type, c.cursor,
               min(struct_pack(ts := p.ts, event_id := p.event_id, value := p.value)) AS m
        FROM cur c LEFT JOIN pts p ON p.event_type = c.event_type AND p.ts >= c.cursor GROUP BY 1, 2),
lst AS (SELECT event_type, max(struct_pack(ts := ts, event_id := event_id, value := value)) AS l
        FROM pts GROUP BY 1)
SELECT fwd.event_type, fwd.cursor, coalesce(m, l).ts AS match_ts,
       coalesce(m, l).event_id AS match_event_id, coalesce(m, l).value AS match_value,
       m IS NULL AS clamped
FROM fwd JOIN lst ON fwd.event_type = lst.event_type"""


QUERIES = {
    "q22_impact": q22_impact,
    "q05_map": q05_map,
    "j17_asof_forward": j17_asof_forward,
}

ORACLE = {
    "q22_impact": _q22_sql(),
    "q05_map": _q05_sql(),
    "j17_asof_forward": J17_SQL,
}
