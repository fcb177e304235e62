"""DuckDB definitions of the canonical tables (the oracle side of
``almagest.sources.canonical``). Each oracle query is ``WITH <ctes> <body>``.

Numeric hygiene shared with the Spark side: rounding is half away from zero of
a DECIMAL with six places; amounts of money are cents as DECIMAL(18,2); means
are sums of six-place decimals (any order, same result) divided by counts.
"""

from __future__ import annotations

from almagest.sources.canonical import ACTIVITY_KEYS, IMPORTANCE_KEYS, SPENDING_KEYS


def money(x: str) -> str:
    return f"CAST(floor(({x}) * CAST(100.0 AS DOUBLE) + 0.5) / CAST(100.0 AS DOUBLE) AS DECIMAL(18,2))"


def round2(x: str, digits: int = 2) -> str:
    """Half away from zero, as a DOUBLE; values without decimals stay."""
    return (f"(CASE WHEN abs({x}) < 1e15 THEN CAST(round(CAST(({x}) AS DECIMAL(38,6)), {digits}) AS DOUBLE) "
            f"ELSE CAST(({x}) AS DOUBLE) END)")


def exact(x: str, precision: int = 28) -> str:
    return f"TRY_CAST(({x}) AS DECIMAL({precision},6))"


def pct_change(cur: str, prev: str, digits: int = 2) -> str:
    raw = f"CASE WHEN {prev} IS NOT NULL AND {prev} <> 0 THEN ({cur} - {prev}) / {prev} * 100.0 END"
    return round2(raw, digits)


def avg_exact(x: str, digits: int = 4) -> str:
    return round2(f"CAST(sum({exact(x)}) AS DOUBLE) / count({x})", digits)


GEO = """geo AS (
  SELECT n.n_nationkey, n.n_name, r.r_name
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

_ORD_COLS = "n_nationkey, o_custkey, o_totalprice, o_orderdate"

TIME_SERIES = GEO + f""",
ob AS (
  SELECT o.o_custkey, o.o_totalprice, o.o_orderdate, g.n_nationkey, g.n_name, g.r_name,
         CAST(year(o.o_orderdate) AS INTEGER) AS y, CAST(month(o.o_orderdate) AS INTEGER) AS mo,
         CAST(quarter(o.o_orderdate) AS INTEGER) AS q
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN geo g ON c.c_nationkey = g.n_nationkey),
okeys AS (
  SELECT 'region' AS geo_level, r_name AS geo_code, 'M' AS freq,
         strftime(o_orderdate, '%Y-%m') AS period, y * 12 + mo - 1 AS t, {_ORD_COLS} FROM ob
  UNION ALL
  SELECT 'region', r_name, 'Q', CAST(y AS VARCHAR) || '-Q' || CAST(q AS VARCHAR), y * 4 + q - 1,
         {_ORD_COLS} FROM ob
  UNION ALL
  SELECT 'region', r_name, 'A', CAST(y AS VARCHAR), y, {_ORD_COLS} FROM ob
  UNION ALL
  SELECT 'nation', n_name, 'M', strftime(o_orderdate, '%Y-%m'), y * 12 + mo - 1, {_ORD_COLS}
  FROM ob),
oagg AS (
  SELECT geo_level, geo_code, freq, period, t, count(*) AS n,
         sum({money('o_totalprice')}) AS rev, count(DISTINCT o_custkey) AS b,
         max(o_orderdate) AS fetched_at
  FROM okeys GROUP BY geo_level, geo_code, freq, period, t),
lagg AS (
  SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t,
         sum({money('l_quantity')}) AS qty, max(l_shipdate) AS fetched_at
  FROM lineitem GROUP BY 1, 2),
lreg AS (
  SELECT g.r_name AS geo_code, la.t, CAST(sum(la.qty) AS DOUBLE) AS value,
         max(la.fetched_at) AS fetched_at
  FROM lagg la JOIN supplier s ON la.l_suppkey = s.s_suppkey
  JOIN geo g ON s.s_nationkey = g.n_nationkey GROUP BY 1, 2),
ts0 AS (
  SELECT 'orders' AS source, 'orders' AS indicator, geo_level, geo_code, period,
         CAST(n AS DOUBLE) AS value, fetched_at, freq, t FROM oagg
  UNION ALL SELECT 'orders', 'revenue', geo_level, geo_code, period, CAST(rev AS DOUBLE),
         fetched_at, freq, t FROM oagg
  UNION ALL SELECT 'orders', 'buyers', geo_level, geo_code, period, CAST(b AS DOUBLE),
         fetched_at, freq, t FROM oagg
  UNION ALL SELECT 'lineitem', 'quantity', 'region', geo_code,
         printf('%04d-%02d', t // 12, t % 12 + 1), value, fetched_at, 'M', t FROM lreg),
time_series AS (
  SELECT source, indicator, geo_level, geo_code, period, 'ABSOLUTE' AS measure, value,
         fetched_at, freq, CAST(t AS INTEGER) AS t,
         CASE freq WHEN 'M' THEN make_date(t // 12, t % 12 + 1, 1)
                   WHEN 'Q' THEN make_date(t // 4, (t % 4) * 3 + 1, 1)
                   ELSE make_date(t, 1, 1) END AS period_start
  FROM ts0)"""

_SPEND_COLS = ",\n         ".join(
    f"sum(CASE WHEN (l_linenumber - 1) % {len(SPENDING_KEYS)} = {i} THEN "
    f"{money('l_extendedprice * (1 - l_discount)')} END) AS {name}"
    for i, name in enumerate(SPENDING_KEYS))

_MICRO_TYPED = """
    CAST(year(o.o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o.o_orderdate) AS VARCHAR) AS quarter,
    o.o_orderkey AS cuestionario, g.r_name AS isla,
    CASE WHEN o.o_custkey % 2 = 0 THEN '1' ELSE '6' END AS sexo,
    CAST(o.o_custkey % 70 + 18 AS INTEGER) AS edad, g.n_name AS nacionalidad,
    g.n_name AS pais_residencia, o.o_orderpriority AS proposito,
    CAST(o.o_orderkey % 14 + 1 AS INTEGER) AS noches, c.c_mktsegment AS aloj_categ,
    o.o_totalprice AS gasto_euros,
    o.o_totalprice * CAST(0.3 AS DOUBLE) AS coste_vuelos_euros,
    o.o_totalprice * CAST(0.4 AS DOUBLE) AS coste_aloj_euros,
    CAST(o.o_orderkey % 11 AS VARCHAR) AS satisfaccion"""

_ACTIV_COLS = ",\n    ".join(
    f"CASE WHEN (o.o_orderkey * {2 * i + 3}) % 7 < 3 THEN '1' ELSE '6' END AS {name}"
    for i, name in enumerate(ACTIVITY_KEYS))

_IMP_COLS = ",\n    ".join(
    f"CASE WHEN (o.o_orderkey + {i}) % 13 = 0 THEN NULL ELSE "
    f"['NADA','ALGO','BASTANTE','MUCHO'][CAST((o.o_orderkey + {i}) % 4 + 1 AS INTEGER)] END AS {name}"
    for i, name in enumerate(IMPORTANCE_KEYS))

# Typed respondent columns only.
MICRO = GEO + f""",
micro AS (
  SELECT {_MICRO_TYPED}
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN geo g ON c.c_nationkey = g.n_nationkey)"""

# Typed columns plus the record keys the Spark side keeps in raw_json
# (spending as DOUBLE, activity/importance answers as text, NULL = absent).
_SPEND_OUT = ", ".join(f"CAST(sp.{n} AS DOUBLE) AS {n}" for n in SPENDING_KEYS)
MICRO_RAW = GEO + f""",
spend AS (
  SELECT l_orderkey,
         {_SPEND_COLS}
  FROM lineitem GROUP BY l_orderkey),
micro AS (
  SELECT {_MICRO_TYPED},
    {_SPEND_OUT},
    {_ACTIV_COLS},
    {_IMP_COLS},
    CAST(o.o_orderkey % 5 + 1 AS VARCHAR) AS PERSONAS_TOTAL
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN geo g ON c.c_nationkey = g.n_nationkey
  LEFT JOIN spend sp ON sp.l_orderkey = o.o_orderkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
