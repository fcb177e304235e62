"""Registered what-if scenario queries (rows-only: model outputs; invariants
in tests/test_scenario.py). One pooled model is fitted per session and data
folder and shared by the three queries, as the reference keeps one fitted
engine."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from almagest.operators import forecast as M
from almagest.operators import scenario as Z
from almagest.operators import sinks as K
from almagest.plans import forecast_queries as FQ
from almagest.plans import oracle_base as O
from almagest.sources import canonical as C

HORIZON = 12
STEPS = (-20.0, -15.0, -10.0, -5.0, 0.0, 5.0, 10.0, 15.0, 20.0, 25.0)  # 1 000 scenarios for each series
_FITTED: dict = {}


def _run(spark, sf):
    key = (spark.sparkContext.applicationId, sf, C.input_fingerprint(spark, sf, C.TS_INPUTS))
    if key not in _FITTED:
        ts = C.time_series(spark, sf)
        geo = C.geo_dim(spark, sf)
        panel = Z.monthly_panel(ts, geo)
        frame = Z.feature_frame(panel).checkpoint(eager=True)
        train = frame.na.drop(subset=Z.FEATURES + ["y"]).withColumnRenamed("y", "label")
        model, sd = Z.fit(train)
        _FITTED[key] = (frame, model, sd)
    return _FITTED[key]


_SWEPT: dict = {}


def m25_sweep(spark, sf):
    """The aligned scenario paths, swept once per fitted model (checkpoint)."""
    frame, model, sd = _run(spark, sf)
    key = id(model)
    if key not in _SWEPT:
        _SWEPT[key] = Z.with_baseline(Z.sweep(Z.initial_state(frame), model, sd, HORIZON, Z.scenario_grid(STEPS, STEPS, STEPS))).checkpoint(eager=True)
    return _SWEPT[key]


def q23_scenario(spark, sf):
    return Z.impact(m25_sweep(spark, sf))


def m22_importance(spark, sf):
    _, model, _ = _run(spark, sf)
    return Z.importances(spark, model)


PCTS = (-10.0, 0.0, 10.0)


def _given_impact(spark, sf, pcts):
    fc = M.seasonal_naive(FQ._train(spark, sf), 12).filter(F.col("indicator") == "orders")
    grid = F.array(*[F.struct(F.lit(i).alias("scenario_id"), F.lit(p).alias("pct")) for i, p in enumerate(pcts)])
    paths = (fc.select("geo_code", "h", "value_predicted", F.explode(grid).alias("g"))
               .select("geo_code", "h", F.col("g.scenario_id").alias("scenario_id"),
                       F.col("g.pct").alias("occupancy_pct"), F.lit(0.0).alias("price_pct"),
                       F.lit(0.0).alias("foreign_pct"),
                       F.floor(F.col("value_predicted") * (1 + F.col("g.pct") / 100.0) + 0.5).cast("double").alias("value")))
    return Z.impact(Z.with_baseline(paths))


def a25_path_impact(spark, sf):
    """A24 + A25 + J13 on given paths: baseline = seasonal-naive forecast of
    each nation's orders, scenarios = that path scaled by a grid of %."""
    return _given_impact(spark, sf, PCTS)


#: Saved runs: their parameters and when they were made.
SAVED = {1: ((0.0, 5.0), "2024-01-01"), 2: ((0.0, -20.0), "2024-02-01"), 3: ((0.0,), "2024-03-01")}


def k10_saved(spark, sf):
    """Three scenario runs saved by id with their parameters; two of them
    and one that there is none of, compared."""
    root = K.snapshot_path(spark, "scenarios")
    for i, (pcts, at) in SAVED.items():
        K.save_run(_given_impact(spark, sf, pcts), root, i, f"run {i}", {"occupancy": pcts}, at)
    found, missing = K.compare_runs(spark, root, [1, 2, 9])
    return found.unionByName(missing, allowMissingColumns=True)


def _k10_sql():
    parts = [f"SELECT *, {i} AS run_id, 'run {i}' AS name, '{json.dumps({'occupancy': pcts})}' AS params, '{at}' AS created_at "
             f"FROM ({_a25_sql(pcts)})" for i, (pcts, at) in SAVED.items() if i in (1, 2)]
    return " UNION ALL BY NAME ".join(parts) + " UNION ALL BY NAME SELECT 9 AS run_id"


def _a25_sql(pcts=PCTS):
    grid = " UNION ALL ".join(f"SELECT {i} AS scenario_id, CAST({p} AS DOUBLE) AS pct" for i, p in enumerate(pcts))
    m = O.exact
    ex = lambda c: f"(CAST(sum({m(c)}) AS DOUBLE) / count({c}))"
    ctes = [O.TIME_SERIES, *FQ.dense_sql(1), *FQ.naive_sql("dense", "fc", 12), f"g AS ({grid})",
            """paths AS (SELECT fc.geo_code, fc.h, g.scenario_id, g.pct AS occupancy_pct,
                 CAST(floor(fc.value_predicted * (1 + g.pct / 100.0) + 0.5) AS DOUBLE) AS value
               FROM fc CROSS JOIN g WHERE fc.indicator = 'orders')""",
            """al AS (SELECT p.*, b.value AS baseline, coalesce(p.value, b.value) AS scenario
               FROM paths p LEFT JOIN paths b ON b.geo_code = p.geo_code AND b.h = p.h AND b.occupancy_pct = 0)""",
            """al2 AS (SELECT *, CASE WHEN baseline <> 0 THEN (scenario - baseline) / baseline * 100.0 END AS chg FROM al)""",
            f"""gg AS (SELECT geo_code, scenario_id, occupancy_pct, {ex('baseline')} AS ab, {ex('scenario')} AS asc_,
                 {ex('chg')} AS msc, first(h ORDER BY abs(scenario - baseline) DESC, h) AS peak_step
               FROM al2 GROUP BY geo_code, scenario_id, occupancy_pct)"""]
    return O.with_(*ctes) + f"""
SELECT geo_code, scenario_id, occupancy_pct, 0.0 AS price_pct, 0.0 AS foreign_pct,
       CAST(floor(ab + 0.5) AS BIGINT) AS avg_baseline, CAST(floor(asc_ + 0.5) AS BIGINT) AS avg_scenario,
       CASE WHEN ab <> 0 THEN {O.round2('(asc_ - ab) / ab * 100.0', 2)} ELSE 0.0 END AS avg_change_pct,
       {O.round2('msc', 2)} AS mean_step_change,
       CASE WHEN msc > 0.05 THEN 'up' WHEN msc < -0.05 THEN 'down' ELSE 'neutral' END AS direction,
       peak_step
FROM gg"""


QUERIES = {
    "a25_path_impact": a25_path_impact,
    "k10_saved": k10_saved,
    "m25_sweep": m25_sweep,
    "q23_scenario": q23_scenario,
    "m22_importance": m22_importance,
}

ORACLE = {"a25_path_impact": _a25_sql(), "k10_saved": _k10_sql()}
