"""Time-series operators over the long ``time_series`` fact (F01-F14,
J01-J06, J16, W01-W07, A06-A08, A20, O01, U03, U06).

Every window is partitioned by the series key, so a window never pulls more
than one series into a task; a series is bounded by its number of periods
(hundreds), not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions import period as P
from almagest.functions import scalars as X
from almagest.sources.canonical import SERIES_KEY

STEPS = {"M": 12, "Q": 4, "A": 1}


def series_window(*extra: str) -> Window:
    return Window.partitionBy(*SERIES_KEY, *extra)


def avg_exact(c, digits: int = 4) -> Column:
    """Average that every engine computes alike: exact decimal sum / count."""
    c = F.col(c) if isinstance(c, str) else c
    return X.round2(F.sum(X.exact(c)).cast("double") / F.count(c), digits)


# --------------------------------------------------------------------------
# Filters (F01, F02, F05, F06, F13)
# --------------------------------------------------------------------------

def select_series(ts: DataFrame, indicator=None, geo=None, measure="ABSOLUTE",
                  from_period: str | None = None, to_period: str | None = None) -> DataFrame:
    """F01 + F02: conjunctive equality filter and inclusive period range.

    Plain comparisons on stored columns, so they reach the Parquet scan of a
    stored table as pushed filters.
    """
    if from_period and to_period and from_period > to_period:
        raise ValueError(f"empty range of periods: {from_period} to {to_period}")
    out = ts
    for col, v in (("indicator", indicator), ("geo_code", geo), ("measure", measure)):
        if v is None:
            continue
        out = out.filter(F.col(col).isin(*v) if isinstance(v, (list, tuple)) else F.col(col) == v)
    if from_period:
        out = out.filter(F.col("period") >= from_period)
    if to_period:
        out = out.filter(F.col("period") <= to_period)
    return out


def monthly_only(df: DataFrame) -> DataFrame:
    """keep rows whose period is a 'YYYY-MM' month."""
    return df.filter(F.col("period").rlike(P.MONTHLY_RE))


def exclude_window(df: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """blank the values inside [lo, hi] (months); None = no-op."""
    if not lo or not hi:
        return df
    inside = F.col("period").between(lo, hi)
    return df.withColumn("value", F.when(inside, F.lit(None).cast("double")).otherwise(F.col("value")))


# --------------------------------------------------------------------------
# Year over year
# --------------------------------------------------------------------------

def with_prior_year(df: DataFrame, value: str = "value", out: str = "prev_value") -> DataFrame:
    """Value of the same period one year earlier, whatever the
    frequency.

    The ordinal ``t`` of a month, quarter or year is scaled to months, so one
    range frame looks exactly one year back in every series and yields NULL
    when that period is missing, which ``lag`` would get wrong. One shuffle by
    series, one window; no self-join.
    """
    scale = F.element_at(F.create_map(*[F.lit(x) for f, k in STEPS.items() for x in (f, 12 // k)]), F.col("freq"))
    w = series_window("freq").orderBy("_months").rangeBetween(-12, -12)
    return (df.withColumn("_months", F.col("t") * scale)
              .withColumn(out, F.first(value, ignorenulls=True).over(w)).drop("_months"))


def yoy_matrix(ts: DataFrame) -> DataFrame:
    """Q08: year x 0-based month matrix with % change versus the prior year."""
    m = ts.filter((F.col("freq") == "M") & F.col("value").isNotNull())
    w = series_window().orderBy("t").rangeBetween(-12, -12)
    m = m.withColumn("prev_value", F.first("value").over(w))
    return m.select(
        *SERIES_KEY,
        F.year("period_start").alias("year"),
        (F.month("period_start") - 1).alias("month"),
        "value",
        X.pct_change(F.col("value"), F.col("prev_value")).alias("yoy_change"))


# --------------------------------------------------------------------------
# Latest / last N
# --------------------------------------------------------------------------

def latest_per_series(ts: DataFrame, by_freq: bool = True) -> DataFrame:
    """The newest row of every series (one aggregate, no sort)."""
    keys = SERIES_KEY + (["freq"] if by_freq else [])
    return (ts.groupBy(*keys)
              .agg(F.max_by(F.struct("period", "value", "t", "fetched_at"), F.col("t")).alias("r"))
              .select(*keys, F.col("r.period").alias("latest_period"),
                      F.col("r.value").alias("latest_value"), F.col("r.t").alias("t"),
                      F.col("r.fetched_at").alias("fetched_at")))


def last_n(ts: DataFrame, n: int = 24) -> DataFrame:
    """The last ``n`` rows of every series, returned oldest first.

    ``row_number <= n`` over a per-series window is planned as a
    WindowGroupLimit, so each task keeps at most ``n`` rows per series
    before the sort.
    """
    w = series_window("freq").orderBy(F.col("t").desc())
    return (ts.withColumn("rn", F.row_number().over(w))
              .filter(F.col("rn") <= n)
              .withColumn("pos", F.lit(n + 1) - F.col("rn"))
              .drop("rn"))


def kpi_snapshot(ts: DataFrame, kpis: dict[str, tuple[str, str]], period: str | None = None) -> DataFrame:
    """Q01: per geography, latest value, period and YoY change of each KPI,
    given as {name: (indicator, frequency)}; monthly, quarterly and yearly ones
    may be mixed. ``period``: values of that period instead of the latest.
    ``last_updated`` is the newest fetch of the whole table, whatever the KPI.
    A geography without the first KPI has ``data_available`` false and a reason.

    The reference issues one point query per KPI; here one pass: filter to
    the KPI list, prior-year value by a range frame (one shuffle by series),
    latest row per series by ``max_by`` on the same partitioning, then a
    pivot over the fixed KPI list into one row per geography.
    """
    wanted = F.lit(False)
    for indicator, freq in kpis.values():
        wanted = wanted | ((F.col("indicator") == indicator) & (F.col("freq") == freq))
    base = with_prior_year(ts.filter(wanted))
    if period:
        base = base.filter(F.col("period") == period)
    lat = (base.groupBy(*SERIES_KEY, "freq")
               .agg(F.max_by(F.struct("period", "value", "prev_value"), F.col("t")).alias("r"))
               .select(*SERIES_KEY, "freq", F.col("r.period").alias("latest_period"),
                       F.col("r.value").alias("latest_value"), F.col("r.prev_value").alias("prev_value")))
    j = lat.withColumn("yoy", X.pct_change(F.col("latest_value"), F.col("prev_value")))
    aggs = []
    for name, (indicator, freq) in kpis.items():
        sel = (F.col("indicator") == indicator) & (F.col("freq") == freq)
        aggs += [F.max(F.when(sel, F.col("latest_value"))).alias(f"{name}_value"),
                 F.max(F.when(sel, F.col("latest_period"))).alias(f"{name}_period"),
                 F.max(F.when(sel, F.col("yoy"))).alias(f"{name}_yoy")]
    out = j.groupBy("geo_code", "measure").agg(*aggs)
    there = F.col(f"{next(iter(kpis))}_value").isNotNull()
    return (out.withColumn("last_updated", ts.agg(F.max("fetched_at")).scalar())
               .withColumn("data_available", there)
               .withColumn("reason", F.when(~there, F.lit("no_data_available"))))


# --------------------------------------------------------------------------
# Paging and catalogue
# --------------------------------------------------------------------------

def page(ts: DataFrame, indicator: str, geo: str, measure: str = "ABSOLUTE",
         from_period: str | None = None, to_period: str | None = None,
         page_no: int = 1, page_size: int = 100, freq: str = "M") -> DataFrame:
    """Q06: one page of a series ordered by period, with total and page count.

    Null values are removed before counting (trap T19). The page is a
    sort + offset + limit (TakeOrderedAndProject: each task keeps only
    offset+limit rows) and the total is a scalar subquery.
    """
    if page_no < 1 or not 1 <= page_size <= 500:
        raise ValueError("page >= 1 and 1 <= page_size <= 500")
    s = (select_series(ts, indicator, geo, measure, from_period, to_period)
         .filter((F.col("freq") == freq) & F.col("value").isNotNull()))
    total = s.agg(F.count(F.lit(1))).scalar()
    rows = s.orderBy("period").offset((page_no - 1) * page_size).limit(page_size).select("period", "value")
    return (rows.withColumn("total", total)
                .withColumn("page", F.lit(page_no))
                .withColumn("page_size", F.lit(page_size))
                .withColumn("total_pages", F.ceil(F.col("total") / page_size).cast("bigint")))


def catalogue(ts: DataFrame) -> DataFrame:
    """Per (indicator, source, freq): first/last period, points, last fetch."""
    return (ts.groupBy("indicator", "source", "freq")
              .agg(F.min("period").alias("available_from"),
                   F.max("period").alias("available_to"),
                   F.count(F.lit(1)).alias("total_points"),
                   F.max("fetched_at").alias("last_updated")))


def forecastable(ts: DataFrame, min_observations: int = 36) -> DataFrame:
    """Monthly series with at least ``min_observations`` values."""
    return (ts.filter((F.col("freq") == "M") & F.col("value").isNotNull())
              .groupBy(*SERIES_KEY).agg(F.count(F.lit(1)).alias("n_obs"))
              .filter(F.col("n_obs") >= min_observations))


# --------------------------------------------------------------------------
# Seasonality
# --------------------------------------------------------------------------

def seasonal_profile(ts: DataFrame) -> DataFrame:
    """Mean value per calendar month of every monthly series."""
    m = ts.filter((F.col("freq") == "M") & F.col("value").isNotNull())
    return (m.groupBy(*SERIES_KEY, F.month("period_start").alias("month_number"))
             .agg(avg_exact("value").alias("avg_value"),
                  F.count(F.lit(1)).alias("n_years")))


def layered(month: Column, layers: dict[str, Column], last: str, default: Column) -> Column:
    """The value of a month from the first layer (a map by month number) that
    has it, else the default, with the name of the layer that answered."""
    value = lambda m: F.try_element_at(m, month)
    answered = F.lit(last)
    for name, layer in reversed(layers.items()):
        answered = F.when(value(layer).isNotNull(), F.lit(name)).otherwise(answered)
    return F.struct(F.coalesce(*map(value, layers.values()), default).alias("value"), answered.alias("layer"))


def seasonal_position(ts: DataFrame, as_of_month: int, forecasts: DataFrame | None = None) -> DataFrame:
    """Q04: peak month, position of ``as_of_month``, the next three months and
    the monthly averages.

    The outlook is the mean of the stored forecasts for these months (of
    ``forecasts``: series key, t, value_predicted) if a series has any, else
    of the historical monthly means, else of the overall mean;
    ``outlook_layers`` says for each month which layer answered.
    """
    prof = seasonal_profile(ts)
    per = prof.groupBy(*SERIES_KEY).agg(
        (F.sum(F.col("avg_value").cast("decimal(38,4)")).cast("double")
         / F.count("avg_value")).alias("overall_avg"),
        F.max_by("month_number", F.struct(F.col("avg_value"), -F.col("month_number"))).alias("peak_month_number"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("month_number", "avg_value")))).alias("m"))
    cur = F.lit(as_of_month)
    nxt = P.next_months(cur, 3)
    if forecasts is None:
        per = per.withColumn("f", F.lit(None).cast("map<int,double>"))
    else:
        # a forecast month may come twice in a long horizon: its mean
        by_month = (forecasts.groupBy(*SERIES_KEY, (F.pmod(F.col("t"), F.lit(12)) + 1).cast("int").alias("month_number"))
                             .agg(avg_exact("value_predicted").alias("v")).filter(F.array_contains(nxt, F.col("month_number"))))
        found = by_month.groupBy(*SERIES_KEY).agg(F.map_from_entries(F.collect_list(F.struct("month_number", "v"))).alias("f"))
        per = per.join(found, SERIES_KEY, "left")
    overall = F.col("overall_avg")
    past = F.transform(nxt, lambda mm: layered(mm, {"history": F.col("m")}, "overall", overall))
    ahead = F.transform(F.filter(nxt, lambda mm: F.map_contains_key("f", mm)),
                        lambda mm: layered(mm, {"forecast": F.col("f")}, "overall", overall))
    per = per.withColumn("_out", F.when(F.col("f").isNotNull(), ahead).otherwise(past))
    total = F.aggregate("_out", F.lit(0.0), lambda acc, x: acc + x["value"])
    averages = F.transform(F.map_entries("m"), lambda e: F.concat(P.month_name(e["key"]), F.lit("="),
                                                                  X.round2(e["value"], 0).cast("long").cast("string")))
    return per.select(
        *SERIES_KEY,
        "peak_month_number",
        P.month_name(F.col("peak_month_number")).alias("peak_month"),
        X.round2(overall, 4).alias("overall_avg"),
        P.month_name(cur).alias("current_month"),
        X.classify_position(F.coalesce(F.try_element_at("m", cur), overall), overall).alias("current_position"),
        X.classify_position(total / F.size("_out"), overall).alias("next_3_months"),
        F.concat_ws(",", F.transform(nxt, lambda mm: P.month_name(mm))).alias("next_months"),
        F.concat_ws(",", F.transform("_out", lambda x: x["layer"])).alias("outlook_layers"),
        F.concat_ws(",", averages).alias("monthly_averages"))


# --------------------------------------------------------------------------
# Gaps, spine, lags, rolling, interpolation
# --------------------------------------------------------------------------

def monthly_spine(ts: DataFrame) -> DataFrame:
    """Every month between the first and last observation of a series,
    with the observed value or NULL."""
    m = ts.filter(F.col("freq") == "M")
    bounds = m.groupBy(*SERIES_KEY).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    spine = bounds.select(*SERIES_KEY, F.explode(P.month_spine(F.col("lo"), F.col("hi"))).alias("t"))
    return (spine.join(m.select(*SERIES_KEY, "t", "value"), SERIES_KEY + ["t"], "left")
                 .withColumn("period", P.ordinal_to_month_period(F.col("t"))))


def gaps(ts: DataFrame) -> DataFrame:
    """Months, quarters or years missing between the first and last
    observation of a series of that frequency."""
    key = [*SERIES_KEY, "freq"]
    bounds = ts.groupBy(*key).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    spine = bounds.select(*key, F.explode(F.sequence("lo", "hi")).alias("t"))
    missing = spine.join(ts.select(*key, "t"), key + ["t"], "left_anti")
    return missing.select(*key, "t", P.ordinal_to_period(F.col("freq"), F.col("t")).alias("missing_period"))


def with_lags(df: DataFrame, lags=(1, 3, 6, 12), value: str = "value") -> DataFrame:
    """Lag k on the dense month axis (range frame on ``t``)."""
    for k in lags:
        w = series_window().orderBy("t").rangeBetween(-k, -k)
        df = df.withColumn(f"lag_{k}", F.first(value).over(w))
    return df


def with_rolling_mean(df: DataFrame, sizes=(3, 12), value: str = "value") -> DataFrame:
    """Mean of the last k months, NULL until k values are present."""
    for k in sizes:
        w = series_window().orderBy("t").rangeBetween(-(k - 1), 0)
        n = F.count(value).over(w)
        df = df.withColumn(f"roll_{k}", F.when(n == k, F.sum(X.exact(F.col(value))).over(w).cast("double") / k))
    return df


def seasonal_difference(df: DataFrame, value: str = "value") -> DataFrame:
    """Value minus the value 12 months earlier (calendar based, T29)."""
    w = series_window().orderBy("t").rangeBetween(-12, -12)
    return df.withColumn("seasonal_diff", F.col(value) - F.first(value).over(w))


def interpolate(spine: DataFrame, value: str = "value") -> DataFrame:
    """Linear interpolation over the month axis.

    Previous and next known points come from two ignore-nulls frames; the
    weight is the distance in months. Trailing gaps take the last value,
    leading gaps stay NULL (pandas ``interpolate`` semantics).
    """
    w_prev = series_window().orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    w_next = series_window().orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    known_t = F.when(F.col(value).isNotNull(), F.col("t"))
    df = (spine.withColumn("_pv", F.last(value, ignorenulls=True).over(w_prev))
               .withColumn("_pt", F.last(known_t, ignorenulls=True).over(w_prev))
               .withColumn("_nv", F.first(value, ignorenulls=True).over(w_next))
               .withColumn("_nt", F.first(known_t, ignorenulls=True).over(w_next)))
    lin = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("t") - F.col("_pt")) / (F.col("_nt") - F.col("_pt"))
    filled = (F.when(F.col(value).isNotNull(), F.col(value))
               .when(F.col("_pv").isNull(), F.lit(None).cast("double"))
               .when(F.col("_nv").isNull(), F.col("_pv"))
               .otherwise(lin))
    return df.withColumn("value_filled", filled).drop("_pv", "_pt", "_nv", "_nt")


# --------------------------------------------------------------------------
# Two-series comparison
# --------------------------------------------------------------------------

def compare_pair(ts: DataFrame, indicator: str, geo_a: str, geo_b: str,
                 periods: int = 24, measure: str = "ABSOLUTE", freq: str = "M") -> DataFrame:
    """Last ``periods`` of two geographies side by side by period
    (full outer join), with difference, ratio % and each side's YoY."""
    base = ts.filter((F.col("indicator") == indicator) & (F.col("measure") == measure)
                     & (F.col("freq") == freq) & F.col("geo_code").isin(geo_a, geo_b))
    base = with_prior_year(base)
    base = base.withColumn("yoy", X.pct_change(F.col("value"), F.col("prev_value")))
    recent = last_n(base, periods)
    a = recent.filter(F.col("geo_code") == geo_a).select("period", F.col("value").alias("value_a"),
                                                          F.col("yoy").alias("yoy_a"))
    b = recent.filter(F.col("geo_code") == geo_b).select("period", F.col("value").alias("value_b"),
                                                          F.col("yoy").alias("yoy_b"))
    j = a.join(b, "period", "full")
    return j.select(
        "period", "value_a", "value_b",
        (F.col("value_a") - F.col("value_b")).alias("difference"),
        X.round2(F.try_divide(F.col("value_a"), F.col("value_b")) * 100.0, 2).alias("ratio_pct"),
        "yoy_a", "yoy_b",
        F.when(F.col("value_a") > F.col("value_b"), F.lit(geo_a))
         .when(F.col("value_b") > F.col("value_a"), F.lit(geo_b)).alias("leader"))


def compare_sides(ts: DataFrame, side_a: tuple[str, str], side_b: tuple[str, str],
                  periods: int = 24, measure: str = "ABSOLUTE", freq: str = "M") -> DataFrame:
    """Two (indicator, geo) series side by side over the
    union of their last ``periods`` periods (full outer join), with the
    ratio a/b in % (NULL when b is 0 or missing) and a's share of a+b."""
    def side(ind, geo, tag):
        s = ts.filter((F.col("indicator") == ind) & (F.col("geo_code") == geo)
                      & (F.col("measure") == measure) & (F.col("freq") == freq))
        return last_n(s, periods).select("period", F.col("value").alias(f"value_{tag}"))
    j = side(*side_a, "a").join(side(*side_b, "b"), "period", "full")
    return j.select(
        "period", "value_a", "value_b",
        X.round2(F.try_divide(F.col("value_a"), F.col("value_b")) * 100.0, 2).alias("ratio_pct"),
        X.round2(F.try_divide(F.col("value_a"), F.col("value_a") + F.col("value_b")) * 100.0, 1).alias("share_a_pct"))


def align(ts: DataFrame, sides: list[tuple[str, str]], newest: int = 12,
          measure: str = "ABSOLUTE", freq: str = "M") -> DataFrame:
    """J16 + U04: up to three (indicator, geo) series side by side by period
    (pivot over the fixed side labels), restricted to the newest ``newest``
    periods of the union of their periods."""
    if not 1 <= len(sides) <= 3:
        raise ValueError("between 1 and 3 series can be aligned")
    cond = None
    label = None
    for i, (ind, geo) in enumerate(sides, start=1):
        c = (F.col("indicator") == ind) & (F.col("geo_code") == geo)
        cond = c if cond is None else cond | c
        label = F.when(c, F.lit(f"s{i}")) if label is None else label.when(c, F.lit(f"s{i}"))
    rows = (ts.filter(cond & (F.col("measure") == measure) & (F.col("freq") == freq))
              .withColumn("side", label))
    wide = rows.groupBy("period").pivot("side", [f"s{i}" for i in range(1, len(sides) + 1)]).agg(F.first("value"))
    # The newest periods of the union: a limit that is the feature (top-k by period).
    return wide.orderBy(F.col("period").desc()).limit(newest)
