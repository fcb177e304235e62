"""Landed-file readers on tiny hand-made files (the reference's parser tests
use the same shapes)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from almagest.sources import landed as L


def _dir():
    return tempfile.mkdtemp(prefix="almagest-src-")


def _write(folder, name, text, encoding="utf-8"):
    p = os.path.join(folder, name)
    with open(p, "w", encoding=encoding) as f:
        f.write(text)
    return p


def test_indicator_csv(spark):
    d = _dir()
    _write(d, "alojatur_tarifa_adr_island.csv", "geo_code,time,measure,value\nES709,2024-01,ABSOLUTE,81.5\nES709,2024-02,ABSOLUTE,n/a\n")
    _write(d, "turistas_island.csv", "indicator,geo_code,time,value\nTURISTAS,ES709,2024-01,500000\n")
    rows = sorted(tuple(r) for r in L.read_indicator_csv(spark, d + "/*_island.csv", stem_suffix="_island").collect())
    assert rows == [("istac", "alojatur_adr", "ES709", "2024-01", "ABSOLUTE", 81.5),
                    ("istac", "turistas", "ES709", "2024-01", "ABSOLUTE", 500000.0)]


def test_series_bundles_registry_and_slug(spark):
    d = _dir()
    bundle = {"S1": {"description": "Known", "records": [{"Anyo": 2024, "FK_Periodo": 3, "Valor": 5.0},
                                                         {"Anyo": 2024, "FK_Periodo": 99, "Valor": 1.0}]},
              "S2": {"description": "Tourists. Total Stays", "records": [{"Anyo": 2023, "FK_Periodo": 20, "Valor": 7.0},
                                                                         {"Anyo": 2023, "FK_Periodo": 21, "Valor": None}]}}
    _write(d, "bundle.json", json.dumps(bundle))
    _write(d, "summary.json", json.dumps(bundle))
    reg = spark.createDataFrame([("S1", "ine_known_ocupacion", "ES70")], "series_id string, name string, geo_code string")
    rows = sorted(tuple(r) for r in L.read_series_bundles(spark, d + "/*.json", reg).collect())
    assert rows == [("ine", "ine_known_ocupacion", "ES70", "2024-03", "PERCENTAGE_RATE", 5.0),
                    ("ine", "tourists_total_stays", "ES709", "2023-Q2", "ABSOLUTE", 7.0)]


def test_series_payload_list_wrapper_and_junk(spark):
    d = _dir()
    _write(d, "A.json", json.dumps([{"Anyo": 2024, "FK_Periodo": 1, "Valor": 10.0}]))
    _write(d, "B.json", json.dumps({"COD": "B", "Data": [{"Anyo": 2024, "FK_Periodo": 19, "Valor": 2.5}]}))
    _write(d, "C.json", json.dumps({"unexpected": 1}))
    _write(d, "D.json", json.dumps([{"Anyo": 2024, "FK_Periodo": 2, "Valor": 1.0}]))
    reg = spark.createDataFrame([("A", "a_adr", "ES709"), ("B", "b", "ES70"), ("C", "c", "ES709")],
                                "series_id string, name string, geo_code string")
    rows = sorted(tuple(r) for r in L.read_series_payloads(spark, d + "/*.json", reg).collect())
    assert rows == [("ine", "a_adr", "ES709", "2024-01", "RATE", 10.0), ("ine", "b", "ES70", "2024-Q1", "ABSOLUTE", 2.5)]
    latest = L.latest_observation(L.read_series_payloads(spark, d + "/*.json", reg), ["indicator"])
    assert {r.indicator: r.period for r in latest.collect()} == {"a_adr": "2024-01", "b": "2024-Q1"}


def test_cube_list_and_dict_observations(spark):
    d = _dir()
    cube_list = {"dimension": {
        "TIME": {"dimensionValues": {"value": [{"id": "2024-01", "order": 0}, {"id": "2024-02", "order": 1},
                                               {"id": "2024-03", "order": 1}]}},
        "geographical": {"dimensionValues": [{"id": "ES709"}, {"id": "ES701"}]},
        "MEASURE": {"dimensionValues": {"value": [{"id": "ABSOLUTE"}]}}},
        "observation": [{"timeIndex": 0, "geographicalIndex": 1, "measureIndex": 0, "value": 10},
                        {"dimensionCodes": {"TIME": 1}, "primaryMeasure": "20.5"},
                        {"timeIndex": 0, "value": None}]}
    cube_dict = {"dimension": {"TIME": {"dimensionValues": [{"id": "2023-12"}]}},
                 "observation": {"0|0|0": 5, "0|x|0": {"value": 6}, "0": None}}
    _write(d, "TURISTAS.json", json.dumps(cube_list))
    _write(d, "PLAZAS.json", json.dumps(cube_dict))
    rows = sorted(tuple(r) for r in L.read_cube_json(spark, d + "/*.json").collect())
    assert rows == [("istac", "plazas", "ES709", "2023-12", "ABSOLUTE", 5.0),
                    ("istac", "plazas", "ES709", "2023-12", "ABSOLUTE", 6.0),
                    ("istac", "turistas", "ES701", "2024-01", "ABSOLUTE", 10.0),
                    ("istac", "turistas", "ES709", "2024-03", "ABSOLUTE", 20.5)]


def test_survey_csv(spark):
    d = _dir()
    text = ("ISLA,NUMERO_CUESTIONARIO,EDAD,NACIONALIDAD,NOCHES,GASTO_EUROS,ALOJ_CATEG,PROPOSITO\n"
            "ES709,101,34.0,826,7,1200.5,_Z,Ocio\n"
            "ES709,_Z,40,724,3,300,1,Ocio\n"
            "ES708,102,50,276,2,100,1,Señal\n"
            "ES709,103,_U,276,2,abc,2,Señal\n")
    _write(d, "microdatos_gasto_turistico_2024q3.csv", text, encoding="latin-1")
    df = L.read_survey_csv(spark, d + "/microdatos_*.csv")
    rows = {r.cuestionario: r for r in df.collect()}
    assert set(rows) == {101, 103}
    assert rows[101].quarter == "2024Q3" and rows[101].edad == 34 and rows[101].aloj_categ is None
    assert rows[103].edad is None and rows[103].gasto_euros is None and rows[103].proposito == "Señal"
    assert "ALOJ_CATEG" not in json.loads(rows[101].raw_json)


def test_manifest_quarters(spark):
    d = _dir()
    man = {"resources": [{"name": "Microdatos 2024Q3", "format": "CSV", "url": "u1"},
                         {"name": "Datos", "description": "T1 2023", "format": "", "url": "http://x/y.csv"},
                         {"name": "3er trimestre 2022", "format": "csv", "url": "u3"},
                         {"name": "sin fecha", "format": "CSV", "url": "http://x/2021-Q4.csv"},
                         {"name": "2020Q1", "format": "PDF", "url": "u5"},
                         {"name": "nada", "format": "CSV", "url": "u6"}]}
    _write(d, "m.json", json.dumps(man))
    got = sorted((r.name, r.quarter) for r in L.manifest_resources(spark, d + "/*.json").collect())
    assert got == [("3er trimestre 2022", "2022Q3"), ("Datos", "2023Q1"), ("Microdatos 2024Q3", "2024Q3"),
                   ("sin fecha", "2021Q4")]


def test_sdmx_and_open_data(spark):
    d = _dir()
    a = _write(d, "gasto_medio.csv", "TIME_PERIOD_CODE,TERRITORIO_CODE,OBS_VALUE\n2024-01,ES709,55.5\n2024-02,ES709,\n")
    b = _write(d, "otra.csv", "FOO,BAR\n1,2\n")
    c = _write(d, "microdatos_x.csv", "TIME_PERIOD_CODE,OBS_VALUE\n2024-01,1\n")
    rows = [tuple(r) for r in L.read_sdmx_csv(spark, [a, b, c]).collect()]
    assert rows == [("istac", "gasto_medio", "ES709", "2024-01", "ABSOLUTE", 55.5)]
    e = _dir()
    _write(e, "plazas.csv", "period,value\n2024-01,10\n2024-02,\n")
    rows = [tuple(r) for r in L.read_open_data_csv(spark, e + "/*.csv").collect()]
    assert rows == [("cabildo", "plazas", "ES709", "2024-01", "ABSOLUTE", 10.0)]


def test_headers_that_differ_in_every_way(spark):
    d = _dir()
    _write(d, "a.csv", 'time,value,geo_code\n2024-01,1,"ES70, 1"\n\n2024-02,"2"\n')
    _write(d, "b.csv", "\ufeffvalue,time\r\n3,2024-03\r\n,2024-04\r\n")
    _write(d, "c.csv", "time,value,,value\n2024-05,5,x,6\n2024-06,7,x,8,surplus\n")
    _write(d, "d.csv", "value,time\n")
    _write(d, "e.csv", "")
    rows = sorted(tuple(r)[2:] for r in L.read_indicator_csv(spark, d + "/*.csv").collect())
    assert rows == [("ES70, 1", "2024-01", "ABSOLUTE", 1.0), ("ES709", "2024-02", "ABSOLUTE", 2.0), ("ES709", "2024-03", "ABSOLUTE", 3.0),
                    ("ES709", "2024-05", "ABSOLUTE", 5.0), ("ES709", "2024-06", "ABSOLUTE", 7.0)]
    names = {r.header: r.names for r in L.csv_headers(spark, d + "/c.csv").collect()}
    assert names == {"time,value,,value": ["time", "value", "_c2", "value_3"]}


def test_jobs_do_not_grow_with_files(spark):
    def jobs(n):
        d, group = _dir(), f"files-{n}"
        for i in range(n):
            _write(d, f"s{i:04d}.csv", ("time,value" if i % 2 else "value,geo_code,time") + "\n" + ("2024-01,1\n" if i % 2 else "2,G,2024-02\n"))
        spark.sparkContext.setJobGroup(group, group)
        try:
            rows = L.read_indicator_csv(spark, d + "/*.csv").collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(rows) == n and sum(r.value for r in rows) == 1.5 * n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    few = jobs(20)
    assert jobs(1000) <= few + 2  # a listing of many paths is itself a job


def test_large_header_tables_are_joined_by_shuffle(spark, monkeypatch):
    d = _dir()
    for i in range(9):
        _write(d, f"s{i}.csv", "time,value\n" + "2024-01,1\n" * (i + 1))
    small = L.read_indicator_csv(spark, d + "/*.csv").collect()
    monkeypatch.setattr(L, "SMALL_HEADERS", 0)
    assert sorted(L.read_indicator_csv(spark, d + "/*.csv").collect()) == sorted(small) and len(small) == 45


def test_survey_csv_bytes_of_another_encoding(spark):
    d = _dir()
    with open(os.path.join(d, "x_2024q1.csv"), "wb") as f:
        f.write(b"ISLA,NUMERO_CUESTIONARIO,PROPOSITO\nES709,1,Se\xf1al \xe9\nES709,2,\xff\x80\n")
    rows = {r.cuestionario: r.proposito for r in L.read_survey_csv(spark, d + "/*.csv").collect()}
    assert rows == {1: "Señal é", 2: "ÿ\x80"}


def test_geojson_and_last_update(spark):
    d = _dir()
    gj = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "Adeje", "code": "38001", "zone": "south", "tourism_intensity": 95},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    p = _write(d, "regions.geojson", json.dumps(gj))
    rows = L.read_geojson(spark, p).collect()
    assert rows[0].code == "38001" and rows[0].tourism_intensity == 95.0 and rows[0].geometry_type == "Polygon"
    df = spark.createDataFrame([('{"lastUpdate": "2024-01-01"}',), ('{"lastUpdated": "2024-02-02"}',), ("{}",)], "m string")
    assert [r[0] for r in df.select(L.last_update(F.col("m"))).collect()] == ["2024-01-01", "2024-02-02", None]
