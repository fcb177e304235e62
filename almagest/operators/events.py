"""Calendar-event operators (F09, J07, J08, A09, A29, U02, Q21, Q22) and the
forward as-of read (J17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions import period as P
from almagest.functions import scalars as X


def list_events(events: DataFrame, from_date: str | None = None, to_date: str | None = None,
                category: str | None = None) -> DataFrame:
    """Events overlapping [from_date, to_date], optional category,
    ordered by start date."""
    e = events
    if from_date:
        e = e.filter((F.col("end_date") >= F.to_date(F.lit(from_date)))
                     | (F.col("end_date").isNull() & (F.col("start_date") >= F.to_date(F.lit(from_date)))))
    if to_date:
        e = e.filter(F.col("start_date") <= F.to_date(F.lit(to_date)))
    if category:
        e = e.filter(F.col("category") == category)
    return e.orderBy("start_date", "id")


def categories(events: DataFrame) -> DataFrame:
    """Distinct categories, sorted."""
    return events.select("category").distinct().orderBy("category")


def by_start_month(events: DataFrame) -> DataFrame:
    """Events grouped by start month, each group sorted by start date."""
    return (events.groupBy(F.date_format("start_date", "yyyy-MM").alias("month"))
                  .agg(F.sort_array(F.collect_list(F.struct("start_date", "id", "name"))).alias("events"))
                  .orderBy("month"))


def event_months(events: DataFrame) -> DataFrame:
    """J07/X11 + J08: one row per (event, month) with the month a year earlier."""
    return (events.select("id", "name", "category",
                          F.explode(P.months_of_range(F.col("start_date"), F.col("end_date"))).alias("period"))
                  .withColumn("prev_period", P.shift_year(F.col("period"), -1)))


def event_impact(ts: DataFrame, events: DataFrame, indicators: list[str],
                 geo_like: str | None = None, geo_level: str | None = "region") -> DataFrame:
    """Q22 for every event at once: mean of each KPI over the event's months,
    the same months a year before, and the YoY change, per geography.

    Event months are an equi-join key (no range join): the event calendar is
    expanded to months (bounded by events x months), the fact side is
    filtered to the KPI list before the join.
    """
    em = event_months(events)
    facts = ts.filter((F.col("freq") == "M") & F.col("indicator").isin(*indicators))
    if geo_like:
        facts = facts.filter(F.col("geo_code").like(geo_like))
    if geo_level:
        facts = facts.filter(F.col("geo_level") == geo_level)
    facts = facts.select("indicator", "geo_code", "period", "value")
    cur = em.join(facts, "period")
    prev = (em.drop("period").withColumnRenamed("prev_period", "period")
              .join(facts, "period"))
    keys = ["id", "name", "category", "indicator", "geo_code"]
    both = (cur.select(*keys, F.lit(True).alias("is_cur"), "value")
               .unionByName(prev.select(*keys, F.lit(False).alias("is_cur"), "value")))
    g = both.groupBy(*keys).agg(
        F.sum(F.when(F.col("is_cur"), X.exact("value"))).alias("cs"),
        F.count(F.when(F.col("is_cur"), F.col("value"))).alias("n_current"),
        F.sum(F.when(~F.col("is_cur"), X.exact("value"))).alias("ps"),
        F.count(F.when(~F.col("is_cur"), F.col("value"))).alias("n_previous"))
    cur_avg = F.col("cs").cast("double") / F.col("n_current")
    prev_avg = F.col("ps").cast("double") / F.col("n_previous")
    return g.select(
        F.col("id").alias("event_id"), F.col("name").alias("event_name"), "category", "indicator",
        "geo_code", "n_current", "n_previous",
        X.round2(cur_avg, 4).alias("current_avg"), X.round2(prev_avg, 4).alias("previous_avg"),
        X.pct_change(cur_avg, prev_avg).alias("yoy_change"))


def asof_forward(points: DataFrame, key: str, ts: str, payload: list[str],
                 cursor_offset_hours: int = 12) -> DataFrame:
    """For every series ``key`` and every day between its first and
    last point, the first point at or after the cursor (day + offset),
    clamped to the series' last point when none follows. Of points at one time
    the one with the smallest ``payload[0]`` (a number that tells points
    apart) comes first.

    Bucketed as-of join: points are reduced per (series, day), map-side first,
    by one fixed-width key of time and number, so a hash table holds the
    reduction and no raw point is sorted or joined. A day then knows the next
    one that has points, and each answers for the days in between. No range
    join, no per-series collect of raw points; the window holds one row per
    day with points of a series.
    """
    cursor_of = lambda day: F.to_timestamp(day) + F.make_interval(hours=F.lit(cursor_offset_hours))
    big = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    number = F.coalesce(F.col(payload[0]).cast("decimal(20,0)"), big(-2**63)) + big(2**63)
    place = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)") * big(2**64) + number
    p = points.select(key, ts, *payload, place.cast("decimal(38,0)").alias("_place")).withColumn("_day", F.to_date(ts))
    after = F.when(F.col(ts) >= cursor_of(F.col("_day")), F.col("_place"))
    cols = [ts, *payload]
    daily = p.groupBy(key, "_day").agg(
        *[F.min_by(c, "_place").alias(f"first_{c}") for c in cols], *[F.min_by(F.col(c), after).alias(f"after_{c}") for c in cols],
        *[F.max_by(c, "_place").alias(f"last_{c}") for c in cols])
    w = Window.partitionBy(key).orderBy("_day")
    j = daily.withColumns({"_next": F.lead("_day").over(w), **{f"next_{c}": F.lead(f"first_{c}").over(w) for c in cols}})
    j = j.withColumn("_cursor", F.explode(F.sequence("_day", F.coalesce(F.date_sub("_next", 1), F.col("_day")))))
    own = (F.col("_cursor") == F.col("_day")) & F.col(f"after_{ts}").isNotNull()
    clamped = ~own & F.col("_next").isNull()
    match = lambda c: F.when(own, F.col(f"after_{c}")).when(clamped, F.col(f"last_{c}")).otherwise(F.col(f"next_{c}"))
    return j.select(key, cursor_of(F.col("_cursor")).alias("cursor"), match(ts).alias("match_ts"),
                    *[match(c).alias(f"match_{c}") for c in payload], clamped.alias("clamped"))
