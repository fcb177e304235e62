"""Period as a logical type.

A period stays the delivered text; three columns are derived from it once:
``freq`` in {M, Q, A}, ``period_start`` (first day) and the integer ordinal
``t`` (year*12+month-1, year*4+quarter-1, year). Prior-year, gaps and lags
are then integer arithmetic on ``t``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted period grammars.
MONTHLY_RE = r"^[0-9]{4}-(0[1-9]|1[0-2])$"
QUARTERLY_RE = r"^[0-9]{4}-Q[1-4]$"
QUARTERLY_ALT_RE = r"^[0-9]{4}Q[1-4]$"
ANNUAL_RE = r"^[0-9]{4}$"
# Loose monthly test used by the validator (two digits, any value).
MONTHLY_LOOSE_RE = r"^[0-9]{4}-[0-9]{2}$"

STEPS_PER_YEAR = {"M": 12, "Q": 4, "A": 1}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid_period(p) -> Column:
    """The four grammars of the validator."""
    p = _c(p)
    return (p.rlike(MONTHLY_LOOSE_RE) | p.rlike(QUARTERLY_RE)
            | p.rlike(QUARTERLY_ALT_RE) | p.rlike(ANNUAL_RE))


def freq(p) -> Column:
    p = _c(p)
    return (F.when(p.rlike(MONTHLY_RE), F.lit("M"))
             .when(p.rlike(QUARTERLY_RE) | p.rlike(QUARTERLY_ALT_RE), F.lit("Q"))
             .when(p.rlike(ANNUAL_RE), F.lit("A")))


def _year(p: Column) -> Column:
    return F.substring(p, 1, 4).cast("int")


def _month(p: Column) -> Column:
    return F.substring(p, 6, 2).cast("int")


def _quarter(p: Column) -> Column:
    return F.substring(p, -1, 1).cast("int")


def ordinal(p) -> Column:
    """``t``: integer position of the period on its own frequency axis."""
    p = _c(p)
    f = freq(p)
    return (F.when(f == "M", _year(p) * 12 + _month(p) - 1)
             .when(f == "Q", _year(p) * 4 + _quarter(p) - 1)
             .when(f == "A", _year(p)))


def period_start(p) -> Column:
    """X22 generalised: first day of the period."""
    p = _c(p)
    f = freq(p)
    return (F.when(f == "M", F.make_date(_year(p), _month(p), F.lit(1)))
             .when(f == "Q", F.make_date(_year(p), (_quarter(p) - 1) * 3 + 1, F.lit(1)))
             .when(f == "A", F.make_date(_year(p), F.lit(1), F.lit(1))))


def with_period_columns(df, col: str = "period"):
    """Add ``freq``, ``t`` and ``period_start`` derived from a period column."""
    return (df.withColumn("freq", freq(col))
              .withColumn("t", ordinal(col))
              .withColumn("period_start", period_start(col)))


def month_period(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def quarter_period(ts, sep: str = "-Q") -> Column:
    ts = _c(ts)
    return F.concat(F.year(ts).cast("string"), F.lit(sep), F.quarter(ts).cast("string"))


def month_ordinal(ts) -> Column:
    ts = _c(ts)
    return F.year(ts) * 12 + F.month(ts) - 1


def ordinal_to_month_period(t) -> Column:
    """Inverse of the monthly ordinal: ``t`` -> 'YYYY-MM'."""
    t = _c(t)
    return F.format_string("%04d-%02d", F.floor(t / 12).cast("int"), (t % 12 + 1).cast("int"))


def ordinal_to_period(freq, t) -> Column:
    """Inverse of the ordinals of all frequencies: 'YYYY-MM', 'YYYY-Qn', 'YYYY'."""
    t = _c(t)
    quarter = F.format_string("%04d-Q%d", F.floor(t / 4).cast("int"), (t % 4 + 1).cast("int"))
    return (F.when(_c(freq) == "M", ordinal_to_month_period(t)).when(_c(freq) == "Q", quarter)
             .otherwise(F.format_string("%04d", t.cast("int"))))


def shift_year(p, delta: int = -1) -> Column:
    """The same period ``delta`` years away, any grammar."""
    p = _c(p)
    return F.concat((_year(p) + delta).cast("string"), F.substring(p, 5, 100))


def months_of_range(start, end) -> Column:
    """X11: array of 'YYYY-MM' covering [start, end] (end defaults to start)."""
    s = F.trunc(_c(start), "MM")
    e = F.trunc(F.coalesce(_c(end), _c(start)), "MM")
    return F.transform(F.sequence(s, e, F.expr("interval 1 month")),
                       lambda d: F.date_format(d, "yyyy-MM"))


def month_spine(lo_t, hi_t) -> Column:
    """Every monthly ordinal between two ordinals (inclusive)."""
    return F.sequence(_c(lo_t), _c(hi_t))


def month_name(m) -> Column:
    """English month name of a month number 1..12."""
    return F.date_format(F.make_date(F.lit(2000), _c(m), F.lit(1)), "MMMM")


def next_months(m, k: int = 3) -> Column:
    """The ``k`` month numbers after ``m`` wrapped to 1..12."""
    m = _c(m)
    return F.array(*[((m - 1 + i) % 12) + 1 for i in range(1, k + 1)])


def days_since_period(max_period, as_of) -> Column:
    """Days from the first day of a monthly period to ``as_of``."""
    return F.datediff(F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of,
                      F.to_date(F.concat(_c(max_period), F.lit("-01"))))


def quarter_from_source_code(year, code) -> Column:
    """Source period code -> 'YYYY-MM' (codes 1..12) or 'YYYY-Qn' (19..22)."""
    y, c = _c(year), _c(code)
    return (F.when(c.between(1, 12), F.format_string("%d-%02d", y, c))
             .when(c.between(19, 22), F.concat(y.cast("string"), F.lit("-Q"), (c - 18).cast("string"))))


def normalise_quarter(q) -> Column:
    """F08/T02: '2025-Q1' and '2025Q1' compare equal after removing '-'."""
    return F.upper(F.regexp_replace(_c(q), "-", ""))


# Quarter spellings recognised in resource names, tried in
# this order on the upper-cased text ('2024Q3' / '2024-Q3', 'T3 2024',
# '3er trimestre 2024'); capture groups give (year, quarter) or (quarter, year).
QUARTER_TEXT_PATTERNS = (
    (r"(\d{4})[_\-]?Q(\d)", 1, 2),
    (r"T(\d)[_\s]*(\d{4})", 2, 1),
    (r"(\d)\w*\s*TRIMESTRE\s*(\d{4})", 2, 1),
)


def quarter_from_text(text) -> Column:
    """Quarter label 'YYYYQn' from free text, first matching spelling."""
    t = F.upper(_c(text))
    options = []
    for pattern, yi, qi in QUARTER_TEXT_PATTERNS:
        y = F.regexp_extract(t, pattern, yi)
        q = F.regexp_extract(t, pattern, qi)
        options.append(F.when(t.rlike(pattern), F.concat(y, F.lit("Q"), q)))
    return F.coalesce(*options)
