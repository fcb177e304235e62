"""Streams keep every row whatever the landing, and go on after a restart."""

import os

import pytest
from pyspark.sql import functions as F

from almagest.operators import quality as V
from almagest.sources import batches as B
from almagest.sources import canonical as C
from almagest.sources.tables import read
from almagest.streaming import ingest as S

SERIES = ["source", "indicator", "geo_code", "measure", "freq"]


@pytest.mark.parametrize("files", [1, 8, 64])
def test_dedup_keeps_every_event(spark, sf_dir, files):
    ev = read(spark, sf_dir, "events")
    again = ev.filter("event_id % 7 = 0")
    work = S.workspace(spark, "dedup")
    shuffled = ev.unionByName(again).repartition(files, F.xxhash64("event_id", F.rand(3)))
    shuffled.write.parquet(os.path.join(work, "landing"))
    out = S.dedup_stream(spark, os.path.join(work, "landing"), ev.schema, ["event_id"], "1 day", work, max_files_per_trigger=5)
    assert out.count() == ev.count() == out.select("event_id").distinct().count()


def test_ingest_goes_on_after_a_restart(spark, sf_dir):
    raw = B.ts_landing(C.time_series(spark, sf_dir))
    work = S.workspace(spark, "restart")
    landing = os.path.join(work, "landing")
    check = lambda b: V.validate_timeseries(b, 2001, ("orders", "lineitem"))[0]
    parts = [raw.filter(F.expr(f"cast(ingest_seq / 10 as long) % 2 = {p}")) for p in (0, 1)]
    for p, part in enumerate(parts):
        part.write.parquet(os.path.join(landing, f"arrival={p}"))
        # a new table object each time, as a new driver has it
        table = S.incremental_ingest(spark, landing, raw.schema, check, V.TS_KEY, work)
    want = check(raw)
    assert table.read().count() == want.count()
    cols = ["source", "indicator", "geo_code", "period", "measure", "value"]
    assert table.read().select(cols).exceptAll(want.select(cols)).count() == 0


def test_latest_state_goes_on_after_a_restart(spark, sf_dir):
    ts = C.time_series(spark, sf_dir).select(*SERIES, "period", "value", "t").withColumn("rev", F.lit(1))
    work = S.workspace(spark, "latest")
    landing = os.path.join(work, "landing")
    for p in (0, 1):
        ts.filter(F.col("t") % 2 == p).write.parquet(os.path.join(landing, f"arrival={p}"))
        out = S.latest_state(spark, landing, ts.schema, SERIES, work, "rev")
    want = ts.groupBy(*SERIES).agg(F.max_by("value", "t").alias("v"), F.count("*").alias("n"))
    joined = out.join(want, SERIES)
    assert out.count() == want.count() == joined.filter("latest_value <=> v AND n_points = n").count()


POINT = "series string, period string, value double, t int, rev int"


def _deliver(spark, work, n, rows):
    landing = os.path.join(work, "landing")
    spark.createDataFrame(rows, POINT).coalesce(1).write.parquet(os.path.join(landing, f"arrival={n}"))
    schema = spark.createDataFrame([], POINT).schema
    out = S.latest_state(spark, landing, schema, ["series"], work, "rev", state_buckets=3)
    return {r.series: tuple(r)[1:] for r in out.collect()}


def test_corrections_replace_and_do_not_count(spark):
    work = S.workspace(spark, "corrections")
    assert _deliver(spark, work, 0, [("a", "2020-01", 1.0, 1, 1), ("a", "2020-02", 2.0, 2, 1), ("b", "2020-02", 5.0, 2, 1)]) == {
        "a": ("2020-02", 2.0, "2020-01", "2020-02", 2), "b": ("2020-02", 5.0, "2020-02", "2020-02", 1)}
    got = _deliver(spark, work, 1, [("a", "2020-02", 9.0, 2, 2), ("a", "2020-02", 8.0, 2, 1), ("a", "2020-02", 9.0, 2, 2)])
    assert got["a"] == ("2020-02", 9.0, "2020-01", "2020-02", 2)
    got = _deliver(spark, work, 2, [("a", "2020-02", 7.0, 2, 1), ("a", "2019-12", 0.0, 0, 1), ("a", "2020-03", None, 3, 1)])
    assert got["a"] == ("2020-03", None, "2019-12", "2020-03", 4)  # an older revision came late
    assert got["b"] == ("2020-02", 5.0, "2020-02", "2020-02", 1)


def test_a_batch_run_again_adds_nothing(spark):
    news = spark.createDataFrame([("a", "2020-02", 3.0, 2, 1, True)], POINT + ", is_new boolean")
    state = S.caught_up(news, None, ["series"], 4, 3)
    assert S.caught_up(news, state, ["series"], 4, 3).collect() == state.collect()
    assert S.caught_up(news, state, ["series"], 5, 3).first().n_points == 2
