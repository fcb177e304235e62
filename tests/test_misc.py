"""Small operators: CSV export, saved-scenario comparison, event listing,
polygon fallback, JSON default, staleness, last runs."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.functions import period as P
from almagest.functions import scalars as X
from almagest.operators import events as E
from almagest.operators import quality as V
from almagest.operators import regions as R
from almagest.operators import scenario as Z
from almagest.operators import sinks as K
from almagest.sources import canonical as C


def test_export_csv_quotes_and_metadata(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="almagest-csv-"), "export")
    df = spark.createDataFrame([("a,b", 'say "hi"', "line\nbreak")], "x string, y string, z string")
    K.export_csv(df.coalesce(1), out, {"source": "test", "filters": {"geo": "ES709"}})
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out).collect()[0]
    assert (back.x, back.y, back.z) == ("a,b", 'say "hi"', "line\nbreak")
    assert '"source": "test"' in spark.read.text(out + "_metadata").first()[0]


def test_compare_saved_and_missing(spark):
    saved = spark.createDataFrame([(1, 1, 10.0), (2, 1, 11.0), (3, 1, 12.0)], "scenario_id int, h int, value double")
    found, missing = Z.compare_saved(saved, [1, 3, 9])
    assert sorted(r.scenario_id for r in found.collect()) == [1, 3]
    assert [r.scenario_id for r in missing.collect()] == [9]


def test_events_list_categories_and_months(spark):
    ev = C.tourism_events(spark)
    rows = E.list_events(ev, "1999-12-01", "2000-06-30").collect()
    assert [r.id for r in rows] == [5, 6]
    assert [r.id for r in E.list_events(ev, category="sports").collect()] == [4, 6]
    assert [r.category for r in E.categories(ev).collect()] == ["business", "culture", "festival", "sports"]
    months = {r.month: len(r.events) for r in E.by_start_month(ev).collect()}
    assert months["1999-12"] == 1 and len(months) == 10
    em = {(r.id, r.period): r.prev_period for r in E.event_months(ev).collect()}
    assert em[(5, "2000-01")] == "1999-01" and (4, "1999-11") in em and (4, "1999-12") not in em


def test_polygon_intensity_fallback(spark):
    feats = spark.createDataFrame([("38001", 95.0), ("38006", None), ("38028", 40.0)], "code string, tourism_intensity double")
    api = spark.createDataFrame([("38001", 70)], "code string, intensity int")
    out = {r.code: r.intensity for r in R.polygons_with_intensity(feats, api).collect()}
    assert out == {"38001": 70.0, "38006": 0.0, "38028": 40.0}


def test_json_default_and_staleness(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    df = spark.createDataFrame([('{"a": 1}',), ("not json",), (None,)], "j string")
    got = [r[0] for r in df.select(X.json_or_default("j", schema)).collect()]
    assert got[0].a == 1 and (got[1] is None or got[1].a is None) and got[2] is None
    d = spark.createDataFrame([("2024-01",)], "p string").select(P.days_since_period("p", "2024-03-01")).first()[0]
    assert d == 60


def test_last_runs(spark):
    st = spark.createDataFrame([("istac", "success", "2024-01-01"), ("istac", "error", "2024-01-02"),
                                ("istac", "success", "2024-01-03"), ("ine", "no_new_data", "2024-01-01")],
                               "source string, status string, finished_at string")
    out = {r.source: (r.last_success, r.last_failure, r.runs) for r in V.last_runs(st).collect()}
    assert out == {"istac": ("2024-01-03", "2024-01-02", 3), "ine": (None, None, 1)}
