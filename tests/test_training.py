"""Version store and training runs."""

import pytest
from pyspark.sql import functions as F

from almagest.operators import forecast as M
from almagest.operators import training as R
from almagest.operators.versions import VersionStore
from almagest.sources.canonical import SERIES_KEY

TS = "source string, indicator string, geo_code string, measure string, geo_level string, t int, period string, value double, freq string"


def facts(spark, series):
    """series: name -> list of monthly values (None: no row)."""
    rows = [("s", "arrivals", name, "ABSOLUTE", "nation", 24000 + i, f"{(24000 + i) // 12:04d}-{i % 12 + 1:02d}", v, "M")
            for name, values in series.items() for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, TS)


def season(n, base=100.0):
    return [base + 10.0 * (i % 12) + i for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "store"), R.PRED_KEY)


def fit(train):
    return M.seasonal_naive(train, 12)


def score(train):
    return M.backtest(train, ("naive",), 12)


def run(store, ts, **more):
    return R.train_fleet(store, M.training_series(ts), fit, score, ["seasonal_naive"], **more)


def versions(store, table="points"):
    return {(r.geo_code, r.version, r.is_current) for r in store.read(table).collect()}


def test_versions_rise_by_key_and_old_ones_stay(spark, store):
    run(store, facts(spark, {"A": season(60), "B": season(60)}))
    run(store, facts(spark, {"A": season(60, 200.0)}))
    assert versions(store) == {("A", 1, False), ("A", 2, True), ("B", 1, True)}
    assert versions(store, "metrics") == versions(store)
    current = store.current("points").groupBy("geo_code", "version").count().collect()
    assert {tuple(r) for r in current} == {("A", 2, 12), ("B", 1, 12)}


def test_an_append_reads_heads_but_no_points(spark, store):
    run(store, facts(spark, {"A": season(60)}))
    batch = store.staged(fit(M.training_series(facts(spark, {"A": season(61)}))))
    files = store.numbered(batch).inputFiles()
    assert any("/heads/run=1" in f for f in files) and not any("/points/" in f for f in files)


def test_rows_without_heads_are_not_there(spark, store):
    run(store, facts(spark, {"A": season(60)}))
    left = store.read("points").drop("is_current").withColumn("version", F.lit(7))
    left.write.parquet(f"{store.root}/points/run=2")  # a writer that died before its commit
    assert versions(store) == {("A", 1, True)}
    assert run(store, facts(spark, {"A": season(60), "B": season(48)})) == 2
    assert versions(store) == {("A", 1, False), ("A", 2, True), ("B", 1, True)}


def test_of_two_appends_at_once_one_fails(spark, store):
    run(store, facts(spark, {"A": season(60)}))
    with pytest.raises(RuntimeError, match="first"):
        store._commit(store.staged(store.heads()).draft, 1)


def test_one_bad_series_leaves_the_fleet_alone(spark, store):
    wild = season(60)
    wild[20] = float("nan")
    huge = season(60)
    huge[30] = 1e300
    ts = facts(spark, {"A": season(60), "SHORT": season(35), "NAN": wild, "HUGE": huge, "EDGE": season(36)})
    run(store, ts)
    got = {r.geo_code: (r.status, r.reason, r.n_points, r.n_observed) for r in R.run_status(store).collect()}
    assert got["A"] == ("ok", None, 12, 60) and got["EDGE"] == ("ok", None, 12, 36)
    assert got["SHORT"] == ("failed", "too_few_months", 0, 35)
    assert got["HUGE"][:3] == ("failed", "value_out_of_range", 0)
    assert got["NAN"][:3] == ("failed", "value_out_of_range", 0)
    assert {r.geo_code for r in store.read("points").select("geo_code").distinct().collect()} == {"A", "EDGE"}


def test_a_model_that_fails_for_a_series_says_so(spark, store):
    ts = facts(spark, {"A": season(60), "ZERO": [0.0] * 60})

    def only_a(train):
        return fit(train).filter("geo_code = 'A'")
    R.train_fleet(store, M.training_series(ts), only_a, score, ["seasonal_naive"])
    got = {r.geo_code: (r.status, r.reason) for r in R.run_status(store).collect()}
    assert got == {"A": ("ok", None), "ZERO": ("failed", "no_forecast")}


def test_refit_fits_what_changed(spark, store):
    def refit(series):
        return R.refit(store, facts(spark, series), M.training_series, fit, score, ["seasonal_naive"])
    first = {"A": season(60), "B": season(60), "C": season(60), "S": season(20)}
    assert refit(first) == 1
    assert refit(first) == 1  # nothing new: no run
    corrected = season(60)
    corrected[5] += 1.0
    assert refit({"A": corrected, "B": season(60), "D": season(40), "S": season(40)}) == 2
    assert versions(store) == {("A", 1, False), ("A", 2, True), ("B", 1, True), ("C", 1, True), ("D", 1, True), ("S", 1, True)}
    assert refit({"A": corrected, "B": season(61), "D": season(40), "S": season(40)}) == 3
    assert ("B", 2, True) in versions(store) and ("A", 2, True) in versions(store)
    # a series that was gone and comes back as it was is fitted anew
    assert refit({**first, "B": season(61)}) == 4
    assert {(r.geo_code, r.run) for r in R.run_status(store).collect()} >= {("C", 4), ("A", 4), ("B", 3), ("D", 2)}


def test_fingerprints_do_not_depend_on_order(spark, store):
    ts = facts(spark, {"A": season(60), "B": season(50)})
    from almagest.operators import quality as V
    a = V.series_fingerprint(ts, SERIES_KEY).collect()
    b = V.series_fingerprint(ts.orderBy(F.desc("value")).repartition(5), SERIES_KEY).collect()
    assert sorted(a) == sorted(b)


def test_an_empty_fleet(spark, store):
    ts = facts(spark, {"A": season(60)}).limit(0)
    assert run(store, ts) == 1
    assert store.read("points").count() == 0 and R.run_status(store).count() == 0


def test_kept_frames_are_let_go(spark):
    train = M.training_series(facts(spark, {"A": season(60)}))
    with M.Kept() as keep:
        rows = M.backtest(train, ("naive", "hw", "sarima"), 12, keep).collect()
        assert all(f.is_cached for f in keep.frames)
    assert rows and not any(f.storageLevel.useMemory for f in keep.frames)
