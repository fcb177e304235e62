"""All registered queries (name -> (spark, sf_dir) -> DataFrame) and their
DuckDB oracle SQL. Names are SURVEY §2 IDs in lower case plus a word."""

from __future__ import annotations

from almagest.plans import (event_queries, forecast_queries, landed_queries, quality_queries, scenario_queries,
                            segment_queries, series_queries, stream_queries, survey_queries)

_MODULES = [series_queries, survey_queries, event_queries, quality_queries, forecast_queries,
            segment_queries, scenario_queries, stream_queries, landed_queries]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
