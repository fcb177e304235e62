"""Sinks and load status."""

import tempfile

import pytest

from almagest.operators import quality as V
from almagest.operators import sinks as K

COLS = "source string, indicator string, geo_code string, period string, measure string, value string, ingest_seq long"


def test_upsert_last_batch_wins_first_within_batch(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    new = spark.createDataFrame([("b", 20.0, 2), ("b", 21.0, 1), ("c", 3.0, 1)], "k string, v double, seq int")
    out = {r.k: r.v for r in K.upsert(old, new, ["k"], order="seq").collect()}
    assert out == {"a": 1.0, "b": 21.0, "c": 3.0}


def test_keep_newest(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("a", 2, 20.0), ("b", 1, 5.0)], "k string, id int, v double")
    assert {r.k: r.v for r in K.keep_newest(df, ["k"]).collect()} == {"a": 30.0, "b": 5.0}


def test_load_batch_status_machine(spark):
    key = V.TS_KEY
    val = lambda b: V.validate_timeseries(b, 2025, ("istac",))[0]
    empty = spark.createDataFrame([], COLS)
    t, st = V.load_batch(None, empty, val, key, "istac", "daily", "s", "f", order="value")
    assert t is None and st.first().status == "no_new_data"
    bad = spark.createDataFrame([("istac", "x", "ES709", "2024-01", "ABSOLUTE", "n/a", 1)], COLS)
    t, st = V.load_batch(None, bad, val, key, "istac", "daily", "s", "f", order="value")
    assert t is None and st.first().status == "error"
    good = spark.createDataFrame([("istac", "X", "ES709", "2024-01", "ABSOLUTE", "5", 1),
                                  ("istac", "x", "ES709", "2024-01", "ABSOLUTE", "6", 2),
                                  ("istac", "x", "ES709", "1800-01", "ABSOLUTE", "6", 3)], COLS)
    t, st = V.load_batch(None, good, val, key, "istac", "daily", "s", "f", order="value")
    r = st.first()
    assert (r.status, r.records_fetched, r.records_valid) == ("success", 3, 1)
    assert [x.value for x in t.collect()] == [5.0]


def test_save_and_list_named(spark):
    root = tempfile.mkdtemp(prefix="almagest-saved-")
    df = spark.createDataFrame([(1, 10.0), (2, 11.0)], "h int, value double")
    K.save_named(df, root, "plan_a", "2024-01-01 10:00:00")
    K.save_named(df, root, "plan_b", "2024-02-01 10:00:00")
    names = [r.name for r in K.list_named(spark, root).collect()]
    assert names == ["plan_b", "plan_a"]


def test_upsert_never_repeats_a_key(spark):
    old = spark.createDataFrame([("a", 1.0)], "k string, v double")
    new = spark.createDataFrame([("b", 2.0), ("b", 3.0), ("a", 4.0)], "k string, v double")
    assert sorted((r.k, r.v) for r in K.upsert(old, new, ["k"], order="v").collect()) == [("a", 4.0), ("b", 2.0)]


def test_raising_source_leaves_the_table_alone(spark):
    old = spark.createDataFrame([("istac", "x", "E", "2024-01", "ABSOLUTE", 5.0)],
                                "source string, indicator string, geo_code string, period string, measure string, value double")

    def broken():
        raise OSError("source is down")

    val = lambda b: V.validate_timeseries(b, 2025, ("istac",))[0]
    good = spark.createDataFrame([("istac", "x", "E", "2024-02", "ABSOLUTE", "6", 1)], COLS)
    jobs = [dict(source="a", job="daily", fetch=broken, validate=val, key=V.TS_KEY, table="ts", order="value"),
            dict(source="b", job="daily", fetch=lambda: good, validate=val, key=V.TS_KEY, table="ts", order="value"),
            dict(source="c", job="weekly", fetch=lambda: good.limit(0), validate=val, key=V.TS_KEY, table="ts", order="value")]
    tables, status = V.run_jobs({"ts": old}, jobs, "s", "f")
    assert [(r.source, r.status, r.records_valid) for r in status.collect()] == [("a", "error", 0), ("b", "success", 1), ("c", "no_new_data", 0)]
    assert "source is down" in status.filter("source = 'a'").first().error
    assert sorted(r.period for r in tables["ts"].collect()) == ["2024-01", "2024-02"]


def test_saved_results_and_models_come_back(spark):
    from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler

    root = tempfile.mkdtemp(prefix="almagest-named-")
    K.save_named(spark.createDataFrame([(1, 1.0)], "h int, value double"), root, "p", "2024-01-01 10:00:00")
    K.save_named(spark.createDataFrame([(1, 2.0), (2, 3.0)], "h int, value double"), root, "p", "2024-01-02 10:00:00")
    assert sorted(r.value for r in K.load_named(spark, root, "p").collect()) == [2.0, 3.0]
    assert K.load_named(spark, root, "q").count() == 0
    df = VectorAssembler(inputCols=["a"], outputCol="v").transform(spark.createDataFrame([(1.0,), (3.0,)], "a double"))
    model = StandardScaler(inputCol="v", outputCol="w").fit(df)
    path = tempfile.mkdtemp(prefix="almagest-model-")
    back = K.load_model(StandardScalerModel, K.save_model(model, path))
    assert back.std == model.std


def test_overwrite_seed_once_and_lookup(spark):
    root = tempfile.mkdtemp(prefix="almagest-tables-")
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    two = spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int")
    assert spark.read.parquet(K.overwrite_table(one, root + "/t")).count() == 1
    assert spark.read.parquet(K.overwrite_table(two, root + "/t")).count() == 2
    K.write_if_absent(one, root + "/seed")
    assert [r.k for r in spark.read.parquet(K.write_if_absent(two, root + "/seed")).collect()] == ["a"]
    t = spark.read.parquet(root + "/t")
    assert [r.v for r in K.point(t, k="c").collect()] == [3] and K.point(t, k="x", v=1).count() == 0
    snap = K.write_snapshot(two, K.snapshot_path(spark, "t"), sort_within=["k"])
    assert spark.read.parquet(snap).count() == 2


def test_saved_runs_by_id(spark):
    root = tempfile.mkdtemp(prefix="almagest-runs-")
    df = spark.createDataFrame([(1, 10.0), (2, 11.0)], "h int, value double")
    for i, at in ((1, "2024-01-01"), (2, "2024-03-01"), (3, "2024-02-01")):
        K.save_run(df, root, i, f"plan {i}", {"price": i}, at)
    K.save_run(df.limit(1), root, 2, "plan 2 again", {"price": 5}, "2024-03-01")
    df.write.parquet(f"{root}/results/run_id=7")  # not finished
    assert [(r.run_id, r.name, r.params) for r in K.list_runs(spark, root).collect()] == [
        (2, "plan 2 again", '{"price": 5}'), (3, "plan 3", '{"price": 3}'), (1, "plan 1", '{"price": 1}')]
    found, missing = K.compare_runs(spark, root, [1, 2, 7])
    assert sorted((r.run_id, r.h) for r in found.collect()) == [(1, 1), (1, 2), (2, 1)]
    assert [r.run_id for r in missing.collect()] == [7]
    with pytest.raises(ValueError):
        K.compare_runs(spark, root, [1, 2, 3, 4])
