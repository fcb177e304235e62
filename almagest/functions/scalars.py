"""Column expressions shared by batch and streaming jobs (X01-X03, X06,
X08, X09, X12-X21, X25). All are built-in functions: they stay inside
whole-stage codegen and are ANSI-safe (try_* / nullif, never a raising cast).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder codes that mean "no value" in survey files.
PLACEHOLDER_CODES = ("_Z", "_U", "_N", "_Y", "")

# Measure classes by keyword of the indicator name.
PERCENTAGE_KEYWORDS = ("ocupacion",)
RATE_KEYWORDS = ("estancia_media", "adr", "revpar")
RATE_MEASURES = ("PERCENTAGE_RATE", "ANNUAL_PERCENTAGE_RATE", "RATE")
VALID_MEASURES = ("ABSOLUTE", "PERCENTAGE_RATE", "ANNUAL_PERCENTAGE_RATE", "RATE")

# Plain decimal or exponent notation, blanks around allowed (trap T04:
# Spark's cast would also accept '5d', '5f').
_NUMBER_RE = r"^\s*[+-]?(([0-9]+\.?[0-9]*)|(\.[0-9]+))([eE][+-]?[0-9]+)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_float(x) -> Column:
    """Text -> double; placeholder, unparsable or NaN -> NULL."""
    s = F.trim(_c(x).cast("string"))
    v = F.when(~s.isin(*PLACEHOLDER_CODES) & s.rlike(_NUMBER_RE), s.try_cast("double"))
    return nan_to_null(v)


def safe_int(x) -> Column:
    """Text -> int through a double, truncating ('7.9' -> 7)."""
    d = safe_float(x)
    return F.when(d.isNotNull() & (F.abs(d) < 2147483648.0), d.cast("int"))


def nan_to_null(x) -> Column:
    """NaN -> NULL so max/std/order never see it."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def finite_or(x, default: float = 0.0) -> Column:
    """NULL, NaN, +-inf -> default."""
    x = _c(x).try_cast("double") if not isinstance(x, Column) else x
    x = _c(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(x)


def measure_of(indicator) -> Column:
    """Measure class from the indicator name."""
    i = _c(indicator)
    pct = None
    for k in PERCENTAGE_KEYWORDS:
        pct = i.contains(k) if pct is None else pct | i.contains(k)
    rate = None
    for k in RATE_KEYWORDS:
        rate = i.contains(k) if rate is None else rate | i.contains(k)
    return (F.when(pct, F.lit("PERCENTAGE_RATE"))
             .when(rate, F.lit("RATE"))
             .otherwise(F.lit("ABSOLUTE")))


def is_reasonable(value, measure) -> Column:
    """Plausibility by measure class."""
    v, m = _c(value), _c(measure)
    return F.when(m.isin(*RATE_MEASURES), v.between(-100.0, 200.0)).otherwise(v >= 0)


def round2(x, digits: int = 2) -> Column:
    """Round half away from zero to ``digits`` decimals, by way of a decimal
    with six (T05: a double's own ``round`` differs between engines on values
    like 1.005). From 1e15 on a double has no such decimals and stays as it is."""
    v = _c(x).cast("double")
    return F.when(F.abs(v) < 1e15, F.round(v.try_cast("decimal(38,6)"), digits).cast("double")).otherwise(v)


def exact(x, precision: int = 28) -> Column:
    """The value as a decimal with six places: sums of it do not depend on the
    order of rows, and small values keep their digits."""
    return _c(x).try_cast(f"decimal({precision},6)")


def pct_change(cur, prev, digits: int = 2) -> Column:
    """(cur-prev)/prev*100, NULL when prev is NULL or 0, rounded."""
    c, p = _c(cur), _c(prev)
    raw = F.when(p.isNotNull() & (p != 0), (c - p) / p * 100.0)
    return round2(raw, digits)


def classify_position(value, overall_avg) -> Column:
    """High >= 1.10, Low <= 0.90 of the average, else Moderate."""
    v, a = _c(value), _c(overall_avg)
    ratio = v / a
    return (F.when(a.isNull() | (a <= 0), F.lit("Moderate"))
             .when(ratio >= 1.10, F.lit("High"))
             .when(ratio <= 0.90, F.lit("Low"))
             .otherwise(F.lit("Moderate")))


# Segment-name labels and cut points.
#   spend  < 500 Budget,  <= 1000 Mid-spend,   else Premium
#   age    < 35  Young,   <= 55   Mid-age,     else Older
#   nights < 5   Short-stay, <= 10 Medium-stay, else Long-stay
def segment_name(spend, age, nights) -> Column:
    """Three-part segment name from spend, age and nights thresholds."""
    s, a, n = _c(spend), _c(age), _c(nights)
    spend_part = (F.when(s < 500, F.lit("Budget"))
                   .when(s <= 1000, F.lit("Mid-spend"))
                   .otherwise(F.lit("Premium")))
    age_part = (F.when(a < 35, F.lit("Young"))
                 .when(a <= 55, F.lit("Mid-age"))
                 .otherwise(F.lit("Older")))
    nights_part = (F.when(n < 5, F.lit("Short-stay"))
                    .when(n <= 10, F.lit("Medium-stay"))
                    .otherwise(F.lit("Long-stay")))
    return F.concat_ws(" / ", spend_part, age_part, nights_part)


def month_cyclic(m):
    """(sin, cos) of the month on the unit circle."""
    ang = F.lit(2 * math.pi) * _c(m) / 12.0
    return F.sin(ang), F.cos(ang)


def ratio_or_half(num, den) -> Column:
    """num/den, 0.5 when den is 0 or NULL."""
    n, d = _c(num), _c(den)
    return F.when(d.isNotNull() & (d != 0), n / d).otherwise(F.lit(0.5))


# Ordinal answer scale.
IMPORTANCE_LEVELS = ("NADA", "ALGO", "BASTANTE", "MUCHO")


def importance_score(x) -> Column:
    """NADA/ALGO/BASTANTE/MUCHO -> 0..3, else NULL."""
    m = F.create_map(*[v for i, lvl in enumerate(IMPORTANCE_LEVELS)
                       for v in (F.lit(lvl), F.lit(float(i)))])
    return F.element_at(m, F.upper(F.trim(_c(x))))


def binary_flag(x) -> Column:
    """1 -> 1.0, anything else (NULL included) -> 0.0."""
    text = _c(x).cast("string")  # the usual answers need no parsing
    return (F.when(text == "1", F.lit(1.0)).when(text.isNull() | (F.length(text) <= 1), F.lit(0.0))
             .when(safe_float(x) == 1.0, F.lit(1.0)).otherwise(F.lit(0.0)))


def display_name(code, prefix: str = "") -> Column:
    """Strip a prefix, '_' -> ' ', title case."""
    c = _c(code)
    if prefix:
        c = F.regexp_replace(c, "^" + prefix, "")
    return F.initcap(F.lower(F.regexp_replace(c, "_", " ")))


def json_or_default(text, schema, default=None) -> Column:
    """Parse JSON text, NULL (or a default) on malformed input."""
    parsed = F.from_json(_c(text), schema, {"mode": "PERMISSIVE"})
    return parsed if default is None else F.coalesce(parsed, default)


def map_without_placeholders(m) -> Column:
    """Drop entries whose value is a placeholder code."""
    return F.map_filter(_c(m), lambda k, v: ~F.coalesce(v.isin(*PLACEHOLDER_CODES), F.lit(False)))


def slug(text, max_len: int = 100) -> Column:
    """Lower case, drop '.', blanks -> '_', first ``max_len`` chars."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"\.", ""), " ", "_")
    return F.substring(s, 1, max_len)


def intensity_class(intensity) -> Column:
    """Intensity 0..100 -> colour class 0..4 (cuts 30/50/70/85)."""
    v = _c(intensity)
    return (F.when(v >= 85, 4).when(v >= 70, 3).when(v >= 50, 2)
             .when(v >= 30, 1).otherwise(0))
