"""Training runs over a fleet of series.

A run checks every series, fits the sound ones, scores them on held-out months
and appends points, metrics and a status row for each series and model to a
:class:`~almagest.operators.versions.VersionStore`; points and metrics of a
run share a version. A series that cannot be fitted ends with a status that
says why and leaves the rest of the fleet alone.

The store also holds the fingerprint of each series as last fitted. A refit
compares these with the data, joins the changed keys into the training set and
appends versions for them alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.operators import quality as V
from almagest.operators.forecast import MIN_SERIES
from almagest.operators.versions import VersionStore
from almagest.sources.canonical import SERIES_KEY

PRED_KEY = ["model", *SERIES_KEY]
#: Values from here on cannot be summed exactly.
LARGEST = 1e15


def series_checks(train: DataFrame, min_months: int = MIN_SERIES) -> DataFrame:
    """Series key, n_observed, and why a series cannot be fitted (null if it
    can): fewer than min_months observed months, or a value that is not finite
    or LARGEST and beyond."""
    v = F.col("value_filled")
    wild = F.max(F.when(v.isNotNull(), F.isnan(v) | (F.abs(v) >= LARGEST)))
    g = train.groupBy(*SERIES_KEY).agg(F.count("value").alias("n_observed"), wild.alias("_wild"))
    reason = (F.when(F.col("_wild"), F.lit("value_out_of_range"))
               .when(F.col("n_observed") < min_months, F.lit("too_few_months")))
    return g.select(*SERIES_KEY, "n_observed", reason.alias("reason"))


def train_fleet(store: VersionStore, train: DataFrame, fit: Callable[[DataFrame], DataFrame],
                score: Callable[[DataFrame], DataFrame], models: list[str], min_months: int = MIN_SERIES,
                fingerprints: DataFrame | None = None) -> int:
    """One run; returns its number. ``fit`` maps a training set to forecasts
    (model, series key, h, t, period, ...), ``score`` to metrics (model, series
    key, rmse, mae, mape, test_size). ``fingerprints``: what each series' data
    looked like, kept for :func:`refit`."""
    checks = store.staged(series_checks(train, min_months))
    sound = train.join(checks.filter("reason IS NULL").select(*SERIES_KEY), SERIES_KEY, "left_semi")
    points = store.staged(fit(sound))
    made = points.groupBy(*PRED_KEY).agg(F.count(F.lit(1)).alias("n_points"))
    every = checks.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    status = every.join(made, PRED_KEY, "left").select(
        *PRED_KEY, "n_observed", F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"),
        F.when(F.col("n_points") > 0, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.when(F.col("n_points").isNull(), F.coalesce("reason", F.lit("no_forecast"))).alias("reason"))
    logs = {"status": status}
    if fingerprints is not None:
        logs["fingerprints"] = fingerprints
    run = store.append("points", points, beside={"metrics": score(sound)}, logs=logs)
    store._drop(checks.draft)
    return run


def run_status(store: VersionStore) -> DataFrame:
    """The newest status of every (model, series) over all runs, with its run."""
    rows = store.log("status")
    newest = rows.groupBy(*PRED_KEY).agg(F.max("run").alias("run"))
    return rows.join(newest, [*PRED_KEY, "run"], "left_semi")


def changes(store: VersionStore, fingerprints: DataFrame) -> DataFrame:
    """Series key, status (new, gone, changed) against what the store was
    last fitted on; all new if it never was."""
    if not store.last_run():
        return fingerprints.select(*SERIES_KEY, F.lit("new").alias("status"))
    return V.changed_fingerprints(store.latest("fingerprints"), fingerprints, SERIES_KEY)


def refit(store: VersionStore, ts: DataFrame, prepare: Callable[[DataFrame], DataFrame], fit: Callable[[DataFrame], DataFrame],
          score: Callable[[DataFrame], DataFrame], models: list[str], min_months: int = MIN_SERIES) -> int:
    """Fit the series of ts that are new or changed since the store's last run
    and append new versions for these alone; the others keep theirs. Returns
    the run's number, or the last one's if nothing changed. ``prepare`` makes
    the training set of a part of ts."""
    now = store.staged(V.series_fingerprint(ts, SERIES_KEY))
    changed = store.staged(changes(store, now).filter("status <> 'gone'").select(*SERIES_KEY))
    try:
        if changed.isEmpty():
            return store.last_run()
        train = prepare(ts.join(changed, SERIES_KEY, "left_semi"))
        return train_fleet(store, train, fit, score, models, min_months, now)
    finally:
        store._drop(now.draft, changed.draft)
