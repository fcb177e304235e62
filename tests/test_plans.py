"""Plans: what reaches the scan, and what must not appear."""

import re

import pytest

from almagest.plans import registry

Q = registry.queries()


def plan(spark, sf_dir, name):
    return Q[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_spending_reads_eight_answers_only(spark, sf_dir):
    schemas = re.findall(r"ReadSchema: (\S+)", plan(spark, sf_dir, "a16_spending"))
    assert schemas and all("raw_json" not in s and "ACTIV_" not in s and "IMPORTANCIA_" not in s for s in schemas)
    assert any("DESGLOSE_RESTAURANT" in s for s in schemas)


def test_series_filters_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "q06_series")
    assert re.search(r"PushedFilters: \[[^\]]*(indicator|geo_code)", text) and "PartitionFilters: [" in text


def test_last_n_is_limited_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(spark, sf_dir, "w02_last_n")


@pytest.mark.parametrize("name", ["q08_yoy", "w01_latest", "q19_compare", "j16_align", "k01_upsert", "a02_trend", "a04_flows",
                                  "v01_validate", "q22_impact", "q05_map", "u03_gaps"])
def test_no_cartesian_product_and_no_python(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_neither_sorts_nor_rereads_events(spark, sf_dir):
    from almagest.plans import registry
    plan = _plan(registry.queries()["j17_asof_forward"](spark, sf_dir))
    assert "SortAggregate" not in plan and plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_smoothing_search_stays_in_the_row(spark, sf_dir):
    from almagest.operators import forecast as M
    from almagest.sources import canonical as C
    fitted = M.holt_winters(M.training_series(C.time_series(spark, sf_dir)), 12)
    plan = _plan(fitted)
    arrays = _plan(M._series_arrays(M.training_series(C.time_series(spark, sf_dir))))
    assert plan.count("Exchange ") == arrays.count("Exchange ") and plan.count("Generate") == arrays.count("Generate") + 1  # the steps
