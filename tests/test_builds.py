"""Builds of the canonical facts: what is shuffled and stored, and the rows."""

import datetime as dt
import json
import os
import re
import tempfile

import pytest

from almagest.sources import canonical as C


@pytest.fixture(scope="module")
def rows_dir(spark):
    """Two customers of one region, one of them listed in two nations; orders
    that repeat a customer in a month, quarter and year, one without a date,
    one without a price."""
    d = tempfile.mkdtemp(prefix="almagest-builds-")
    day = lambda *x: dt.datetime(*x)
    tables = {
        "region": ([(0, "EUROPE"), (1, "ASIA")], "r_regionkey bigint, r_name string"),
        "nation": ([(0, "A", 0), (1, "B", 0), (2, "C", 1)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "customer": ([(1, 0, "X"), (2, 0, "Y"), (2, 1, "Y"), (3, 2, None)], "c_custkey bigint, c_nationkey bigint, c_mktsegment string"),
        "supplier": ([(1, 0)], "s_suppkey bigint, s_nationkey bigint"),
        "orders": ([(1, 1, 10.0, day(1996, 1, 3), "p"), (2, 1, 20.0, day(1996, 1, 9), "p"), (3, 1, 5.0, day(1996, 2, 1), "q"),
                    (4, 2, 7.0, day(1996, 1, 5), "p"), (5, 2, None, day(1996, 4, 5), "p"), (6, 3, 1.0, None, None), (7, None, 1.0, day(1996, 1, 1), "p")],
                   "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, 4.0, 100.0, 0.1, day(1996, 1, 7)), (1, 1, 9, 4.0, 10.0, 0.0, day(1996, 1, 8)), (4, 1, 2, 1.0, 3.0, 0.0, day(1996, 2, 8))],
                     "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [None, 5])
def test_buyers_are_distinct_in_each_level(spark, rows_dir, parts):
    got = {(r.geo_level, r.geo_code, r.period, r.indicator): r.value
           for r in C.build_time_series(spark, rows_dir, parts).filter("source = 'orders'").collect()}
    at = lambda i, level, place, period: got[(level, place, period, i)]
    assert [at("buyers", "region", "EUROPE", p) for p in ("1996-01", "1996-02", "1996-Q1", "1996-Q2", "1996")] == [2, 1, 2, 1, 2]
    assert [at("buyers", "nation", p, "1996-01") for p in "AB"] == [2, 1]
    assert [at("orders", "region", "EUROPE", p) for p in ("1996-01", "1996-Q1", "1996")] == [4, 5, 7]  # a customer listed twice counts twice
    assert at("revenue", "region", "EUROPE", "1996-Q1") == 49 and at("revenue", "region", "EUROPE", "1996-Q2") is None
    assert at("orders", "region", "ASIA", None) == 1  # one row without a date for each level
    assert got[("nation", "C", None, "buyers")] == 1


def test_orders_are_shuffled_once_by_customer(spark, rows_dir):
    text = _plan(C.build_time_series(spark, rows_dir, 5))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^\n]*)\), ", text)
    by_customer = [x for x in exchanges if "o_custkey" in x]
    assert len(by_customer) == 1 and by_customer[0].endswith(", 5") and "geo_code" not in by_customer[0]


def test_answers_are_made_after_the_shuffle_and_text_when_read(spark, rows_dir, monkeypatch):
    laid = []
    keep = C.survey_record
    monkeypatch.setattr(C, "survey_record", lambda m, *a: laid.append(m) or keep(m, *a))
    by_id = lambda df: {(r.cuestionario, r.nacionalidad): r.asDict() for r in df.collect()}
    got = by_id(C.microdata(spark, rows_dir))
    assert laid and not {"raw", "raw_json", *C.ACTIVITY_KEYS, *C.IMPORTANCE_KEYS} & set(laid[0].columns)
    folder = f"{C.ensure_checkpoint_dir(spark)}/canonical"
    stored = spark.read.parquet(*[f"{folder}/{x}" for x in os.listdir(folder) if x.startswith("microdata-")][:1])
    assert "raw" in stored.columns and "raw_json" not in stored.columns
    want = by_id(C.build_microdata(spark, rows_dir))
    assert got == want and {k for k, _ in got} == {1, 2, 3, 4, 5, 6}
    text = {k: json.loads(r["raw_json"]) for k, r in got.items()}
    assert text[1, "A"]["DESGLOSE_RESTAURANT"] == "100.00" and "DESGLOSE_RESTAURANT" not in text[3, "A"]


def test_partitions_grow_with_the_input(spark, rows_dir, monkeypatch):
    assert C.partitions(spark, rows_dir, C.TS_INPUTS) is None
    monkeypatch.setattr(C, "PART_BYTES", 100)
    few = C.partitions(spark, rows_dir, ["orders"])
    assert C.partitions(spark, rows_dir, C.TS_INPUTS) > few > spark.sparkContext.defaultParallelism
    # dealt over so many partitions, the facts are the same
    assert sorted(map(str, C.build_time_series(spark, rows_dir, few).collect())) == sorted(map(str, C.build_time_series(spark, rows_dir).collect()))
