"""Fleet forecasting.

Every series of the fleet is forecast in the same job: a series is a group
key, never a driver loop. A series is bounded by its number of months
(hundreds), so per-series arrays (Holt-Winters state, ARMA normal
equations) are small whatever the data volume; the number of series is
what grows, and that is spread over tasks by the shuffle on the series key.

Models
* seasonal_naive (M07): repeat the last 12 months; bands from the sample
  sd of seasonal differences, +-z*se*sqrt(h/12).
* holt_winters (M05/M06): additive trend, multiplicative season 12
  (additive when a value <= 0). Smoothing parameters are chosen from a
  fixed grid by in-sample SSE; the recursion runs in ``aggregate`` over the
  ordered value array. Bands +-z*se*sqrt(h).
* seasonal_arma (M03/M04): (2,0,1)(2,0,0)12 without intercept re-aimed as a
  Hannan-Rissanen two-stage least squares fit: stage 1 long AR(12) residuals,
  stage 2 regression on the expanded seasonal lags + residual lag 1. The
  normal equations X'X, X'y are summed by Spark; the <= 10x10 solve and the
  recursion run per series in ``applyInPandas``. Not equal to an MLE fit.
* ensemble (M08/M09): 0.7/0.2/0.1 for steps 1-3, 0.5/0.3/0.2 after; weights
  renormalised over available models; bands = ARMA bands x ensemble/ARMA.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.functions import period as P
from almagest.functions import scalars as X
from almagest.operators import series as S
from almagest.sources.canonical import SERIES_KEY

# Band multipliers and ensemble weights.
Z80, Z95 = 1.28, 1.96
WEIGHTS_SHORT = {"sarima": 0.7, "hw": 0.2, "naive": 0.1}
WEIGHTS_MEDIUM = {"sarima": 0.5, "hw": 0.3, "naive": 0.2}
SHORT_STEPS = 3
SEASON = 12
MIN_SERIES = 36
MIN_CLEAN_FOR_BACKTEST = 48

# Smoothing grid (a parameter of the re-aimed fit, not a reference value).
HW_ALPHAS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
HW_BETAS = (0.01, 0.05, 0.1, 0.2)
HW_GAMMAS = (0.05, 0.1, 0.2, 0.4)

FC_COLS = ["model", *SERIES_KEY, "h", "t", "period", "value_predicted",
           "ci_lower_80", "ci_upper_80", "ci_lower_95", "ci_upper_95"]


# --------------------------------------------------------------------------
# Training input
# --------------------------------------------------------------------------

def training_series(ts: DataFrame, until_period: str | None = None, exclude: tuple[str, str] | None = None,
                    geo_level: str | None = None, leave_out: int = 0) -> DataFrame:
    """M01 + M02: dense monthly series per key, excluded window blanked and
    gaps linearly interpolated. Columns: series key, t, period, value,
    value_filled. ``leave_out``: months at the end of each source's data that
    are not trained on (1: the month that is still being delivered)."""
    m = ts.filter((F.col("freq") == "M") & (F.col("measure") == "ABSOLUTE"))
    if geo_level:
        m = m.filter(F.col("geo_level") == geo_level)
    if until_period:
        m = m.filter(F.col("period") <= until_period)
    if leave_out:
        last = m.groupBy("source").agg((F.max("t") - leave_out).alias("last_t"))
        m = m.join(last, "source").filter(F.col("t") <= F.col("last_t")).drop("last_t")
    if exclude:
        m = S.exclude_window(m, *exclude)
    m = m.filter(F.col("value").isNotNull())
    spine = S.monthly_spine(m.select(*SERIES_KEY, "t", "value", "freq"))
    return S.interpolate(spine).select(*SERIES_KEY, "t", "period", "value", "value_filled")


def _sd_from(n: str = "_n", s1: str = "_s1", s2: str = "_s2") -> Column:
    num = (F.col(n) * F.col(s2) - F.col(s1) * F.col(s1)).cast("double")
    return F.when(F.col(n) > 1, F.sqrt(num / (F.col(n) * (F.col(n) - 1)).cast("double")))


def _steps(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


# --------------------------------------------------------------------------
# Seasonal naive
# --------------------------------------------------------------------------


def _finish(j: DataFrame, model: str, mean: Column, w80: Column, w95: Column,
            floor: bool = True) -> DataFrame:
    """Common output: one row per (model, series, step), values in cents."""
    out = j.select(F.lit(model).alias("model"), *SERIES_KEY, "h",
                   (F.col("t_last") + F.col("h")).cast("int").alias("t"),
                   mean.alias("_m"), w80.alias("_w80"), w95.alias("_w95"))
    # Counts cannot be negative: the point forecast is floored at 0 before
    # the bands are formed (lower bands are floored too, T23).
    m = F.greatest(F.col("_m"), F.lit(0.0)) if floor else F.col("_m")
    w80c, w95c = F.col("_w80"), F.col("_w95")
    lo = (lambda c: F.greatest(c, F.lit(0.0))) if floor else (lambda c: c)
    return out.select(
        "model", *SERIES_KEY, "h", "t", P.ordinal_to_month_period(F.col("t")).alias("period"),
        X.round2(m, 2).alias("value_predicted"),
        X.round2(lo(m - w80c), 2).alias("ci_lower_80"), X.round2(m + w80c, 2).alias("ci_upper_80"),
        X.round2(lo(m - w95c), 2).alias("ci_lower_95"), X.round2(m + w95c, 2).alias("ci_upper_95"))


def seasonal_naive(train: DataFrame, horizon: int = 12) -> DataFrame:
    """Step h repeats the value at t_last - season + 1 + (h-1) mod season,
    season = min(12, n), on the dense month axis (calendar based, T29).
    se = sample sd of the seasonal differences (of the values when n <= 12)."""
    w12 = S.series_window().orderBy("t").rangeBetween(-SEASON, -SEASON)
    v = F.col("value_filled")
    d = train.withColumn("_d", v - F.first("value_filled").over(w12))
    dm, vm = X.exact("_d", 18), X.exact(v, 18)
    stats = d.groupBy(*SERIES_KEY).agg(
        F.count(v).alias("n"), F.max("t").alias("t_last"),
        F.count("_d").alias("_n"), F.sum(dm).alias("_s1"), F.sum(dm * dm).alias("_s2"),
        F.count(v).alias("_vn"), F.sum(vm).alias("_v1"), F.sum(vm * vm).alias("_v2"))
    se = F.when(F.col("n") > SEASON, _sd_from()).otherwise(_sd_from("_vn", "_v1", "_v2"))
    stats = (stats.filter(F.col("n") > 0)
                  .withColumn("se", se).withColumn("season", F.least(F.lit(SEASON), F.col("n"))))
    steps = _steps(stats, horizon).withColumn(
        "src_t", F.col("t_last") - F.col("season") + 1 + (F.col("h") - 1) % F.col("season"))
    src = train.select(*SERIES_KEY, F.col("t").alias("src_t"), F.col("value_filled").alias("mean"))
    j = steps.join(src, SERIES_KEY + ["src_t"], "left")
    root = F.sqrt(F.col("h").cast("double") / float(SEASON))
    return _finish(j, "seasonal_naive", F.col("mean"),
                   F.lit(Z80) * F.col("se") * root, F.lit(Z95) * F.col("se") * root)


# --------------------------------------------------------------------------
# Holt-Winters
# --------------------------------------------------------------------------

def _series_arrays(train: DataFrame) -> DataFrame:
    """Per series: ordered dense values (bounded by the number of months)."""
    return (train.groupBy(*SERIES_KEY)
                 .agg(F.array_sort(F.collect_list(F.struct("t", "value_filled"))).alias("_pts"),
                      F.max("t").alias("t_last"))
                 .withColumn("v", F.transform("_pts", lambda p: p["value_filled"]))
                 .drop("_pts")
                 .withColumn("n", F.size("v")))


def holt_winters(train: DataFrame, horizon: int = 12, min_points: int = 2 * SEASON) -> DataFrame:
    """M05 + M06: additive trend, multiplicative season (additive when any
    value <= 0), smoothing parameters from a fixed grid by in-sample SSE.

    The search runs inside the row of a series: the grid is a literal array
    that is transformed to the states after the last value, and the least SSE
    among them stays, so after the arrays are built there is neither a generator
    nor a shuffle. The recursion is ``aggregate`` over the ordered values with
    (level, trend, 12 seasonals, sse, sum of errors) as state.
    """
    arr = _series_arrays(train).filter(F.col("n") >= min_points)
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g"))
                     for a, b, g in itertools.product(HW_ALPHAS, HW_BETAS, HW_GAMMAS)])
    v = F.col("v")
    mul = F.forall(v, lambda x: x > 0)
    l0 = F.aggregate(F.slice(v, 1, SEASON), F.lit(0.0), lambda acc, x: acc + x) / SEASON
    l1 = F.aggregate(F.slice(v, SEASON + 1, SEASON), F.lit(0.0), lambda acc, x: acc + x) / SEASON
    b0 = (l1 - l0) / SEASON
    s0 = F.transform(F.slice(v, 1, SEASON), lambda x: F.when(mul, F.try_divide(x, l0)).otherwise(x - l0))
    x = arr.withColumn("mul", mul).withColumn("l0", l0).withColumn("b0", b0).withColumn("s0", s0)
    init = F.struct(F.col("l0").alias("l"), F.col("b0").alias("b"), F.col("s0").alias("s"),
                    F.lit(0.0).alias("sse"), F.lit(0.0).alias("se1"))

    def after(p):
        """The state after the last value under parameters p."""
        a, b, g = p["a"], p["b"], p["g"]

        def step(acc, i):
            y = F.element_at(v, i)
            idx = (i - 1) % SEASON
            si = F.element_at(acc["s"], idx + 1)
            lb = acc["l"] + acc["b"]
            pred = F.when(F.col("mul"), lb * si).otherwise(lb + si)
            e = y - pred
            l_new = F.when(F.col("mul"), a * F.try_divide(y, si) + (1 - a) * lb).otherwise(a * (y - si) + (1 - a) * lb)
            b_new = b * (l_new - acc["l"]) + (1 - b) * acc["b"]
            s_i = F.when(F.col("mul"), g * F.try_divide(y, l_new) + (1 - g) * si).otherwise(g * (y - l_new) + (1 - g) * si)
            s_new = F.transform(acc["s"], lambda sv, j: F.when(j == idx, s_i).otherwise(sv))
            return F.struct(l_new.alias("l"), b_new.alias("b"), s_new.alias("s"),
                            (acc["sse"] + e * e).alias("sse"), (acc["se1"] + e).alias("se1"))
        return F.aggregate(F.sequence(F.lit(SEASON + 1), F.col("n")), init, step)

    fits = F.transform(F.transform(grid, lambda p: F.struct(after(p).alias("st"), p.alias("p"))),
                       lambda f: F.struct(f["st"]["sse"].alias("sse"), f["p"].alias("p"), f["st"].alias("st")))
    sound = F.filter(fits, lambda f: f["sse"].isNotNull() & ~F.isnan(f["sse"]))
    best = (x.withColumn("best", F.array_min(sound)).filter(F.col("best").isNotNull())
             .select(*SERIES_KEY, "n", "t_last", "mul", F.col("best.st").alias("st"), F.col("best.p").alias("p")))
    m = F.col("n") - SEASON
    var = (F.col("st.sse") - F.col("st.se1") * F.col("st.se1") / m) / (m - 1)
    best = best.withColumn("se", F.sqrt(F.greatest(var, F.lit(0.0))))
    steps = _steps(best, horizon)
    h = F.col("h")
    s_idx = ((F.col("n") + h - 1) % SEASON) + 1
    seas = F.element_at(F.col("st.s"), s_idx.cast("int"))
    trend = F.col("st.l") + h * F.col("st.b")
    mean = F.when(F.col("mul"), trend * seas).otherwise(trend + seas)
    root = F.sqrt(h.cast("double"))
    return _finish(steps, "holt_winters", mean, F.lit(Z80) * F.col("se") * root,
                   F.lit(Z95) * F.col("se") * root)


# --------------------------------------------------------------------------
# Seasonal ARMA by Hannan-Rissanen
# --------------------------------------------------------------------------

STAGE1_LAGS = tuple(range(1, SEASON + 1))
FULL_LAGS = (1, 2, 12, 13, 14, 24, 25, 26)
SHORT_LAGS = (1, 2, 12, 13, 14)
RIDGE = 1e-6


def _with_lags(df: DataFrame, col: str, lags, prefix: str) -> DataFrame:
    for k in lags:
        w = S.series_window().orderBy("t").rangeBetween(-k, -k)
        df = df.withColumn(f"{prefix}{k}", F.first(col).over(w))
    return df


def _normal_sums(df: DataFrame, regs: list[str], tag: str) -> list[Column]:
    """Upper triangle of X'X, X'y and y'y, only over rows where every
    regressor is present."""
    ok = F.lit(True)
    for r in regs:
        ok = ok & F.col(r).isNotNull()
    out = [F.sum(F.when(ok, 1).otherwise(0)).alias(f"{tag}_m"),
           F.sum(F.when(ok, F.col("y") * F.col("y"))).alias(f"{tag}_yy")]
    xtx = [F.sum(F.when(ok, F.col(regs[i]) * F.col(regs[j]))) for i in range(len(regs)) for j in range(i, len(regs))]
    xty = [F.sum(F.when(ok, F.col(r) * F.col("y"))) for r in regs]
    out += [F.array(*xtx).alias(f"{tag}_xtx"), F.array(*xty).alias(f"{tag}_xty")]
    return out


def _solve(m, xtx_u, xty, k):
    a = np.zeros((k, k))
    iu = np.triu_indices(k)
    a[iu] = xtx_u
    a = a + a.T - np.diag(np.diag(a))
    a = a + RIDGE * max(np.trace(a) / k, 1.0) * np.eye(k)
    return np.linalg.solve(a, np.asarray(xty, dtype=float))


def _stage1(pdf_iter):
    k = len(STAGE1_LAGS)
    for pdf in pdf_iter:
        coefs = []
        for m, xtx, xty in zip(pdf["s1_m"], pdf["s1_xtx"], pdf["s1_xty"]):
            try:
                coefs.append(list(map(float, _solve(m, np.asarray(xtx, float), xty, k)))
                             if m and m > k else None)
            except Exception:  # this series has no forecast; the others go on
                coefs.append(None)
        pdf = pdf[SERIES_KEY].copy()
        pdf["phi1"] = coefs
        yield pdf


def _stage2_and_forecast(horizon: int):
    def run(pdf_iter):
        for pdf in pdf_iter:
            rows = []
            for r in pdf.itertuples(index=False):
                lags = FULL_LAGS if r.n >= 60 else SHORT_LAGS
                tag = "f" if r.n >= 60 else "s"
                k = len(lags) + 1
                m, xtx, xty, yy = getattr(r, f"{tag}_m"), getattr(r, f"{tag}_xtx"), getattr(r, f"{tag}_xty"), getattr(r, f"{tag}_yy")
                mean, sd = None, None
                if m is not None and m > k and xtx is not None:
                    try:
                        beta = _solve(m, np.asarray(xtx, float), xty, k)
                        a = np.zeros((k, k))
                        a[np.triu_indices(k)] = xtx
                        a = a + a.T - np.diag(np.diag(a))
                        rss = float(yy) - 2 * float(beta @ np.asarray(xty, float)) + float(beta @ a @ beta)
                        sigma2 = max(rss, 0.0) / (m - k)
                        phi = dict(zip(lags, beta[:-1]))
                        theta = float(beta[-1])
                        hist = list(np.asarray(r.tail, float))  # last 26 values, oldest first
                        e_last = float(r.e_last) if r.e_last is not None and not math.isnan(r.e_last) else 0.0
                        preds = []
                        for h in range(1, horizon + 1):
                            val = sum(c * hist[-lag] for lag, c in phi.items())
                            if h == 1:
                                val += theta * e_last
                            preds.append(val)
                            hist.append(val)
                        psi = [1.0]
                        for j in range(1, horizon):
                            pj = (theta if j == 1 else 0.0) + sum(c * psi[j - lag] for lag, c in phi.items() if j - lag >= 0)
                            psi.append(pj)
                        cum = np.cumsum(np.square(psi))
                        mean = [p * r.scale for p in preds]
                        sd = [math.sqrt(sigma2 * c) * r.scale for c in cum]
                    except Exception:  # this series has no forecast; the others go on
                        mean, sd = None, None
                rows.append((*[getattr(r, c) for c in SERIES_KEY], int(r.t_last), mean, sd))
            yield pd.DataFrame(rows, columns=[*SERIES_KEY, "t_last", "mean", "sd"])
    return run


def seasonal_arma(train: DataFrame, horizon: int = 12, min_points: int = MIN_SERIES, keep=DataFrame.persist) -> DataFrame:
    """M03 + M04: seasonal ARMA (2,0,1)(2,0,0)12 by two-stage least squares.

    Spark does the heavy part: lag columns (range frames on the dense month
    axis), cross-product sums per series (one aggregate), residuals of stage
    1 (a join of per-series coefficients back to the rows). Python only
    solves each series' <= 10x10 system and runs the 12-step recursion.
    """
    sizes = train.groupBy(*SERIES_KEY).agg(F.count("value_filled").alias("n"),
                                          F.avg("value_filled").alias("scale"))
    sizes = sizes.filter(F.col("n") >= min_points)
    base = (train.join(sizes, SERIES_KEY)
                 .withColumn("y", F.col("value_filled") / F.when(F.col("scale") != 0, F.col("scale")).otherwise(1.0)))
    lagged = keep(_with_lags(base, "y", sorted(set(STAGE1_LAGS) | set(FULL_LAGS)), "l"))  # read twice
    s1_regs = [f"l{k}" for k in STAGE1_LAGS]
    s1 = lagged.groupBy(*SERIES_KEY).agg(*_normal_sums(lagged, s1_regs, "s1"))
    phi1 = s1.mapInPandas(_stage1, schema=T.StructType(
        [T.StructField(c, T.StringType()) for c in SERIES_KEY]
        + [T.StructField("phi1", T.ArrayType(T.DoubleType()))]))
    with_e = lagged.join(phi1, SERIES_KEY)
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(len(STAGE1_LAGS))), F.lit(0.0),
                         lambda acc, i: acc + F.element_at("phi1", i) * F.element_at(F.array(*s1_regs), i))
    with_e = with_e.withColumn("e", F.col("y") - fitted)
    with_e = _with_lags(with_e, "e", (1,), "e")
    full = [f"l{k}" for k in FULL_LAGS] + ["e1"]
    short = [f"l{k}" for k in SHORT_LAGS] + ["e1"]
    last = F.max_by(F.struct("t", "y", "e"), "t")
    tail = F.array_sort(F.collect_list(F.when(F.col("t") > F.col("t_last_w") - 26, F.struct("t", "y"))))
    with_e = with_e.withColumn("t_last_w", F.max("t").over(S.series_window()))
    agg = with_e.groupBy(*SERIES_KEY, "n", "scale").agg(
        *_normal_sums(with_e, full, "f"), *_normal_sums(with_e, short, "s"),
        last.alias("_last"), tail.alias("_tail"))
    agg = agg.select(*SERIES_KEY, "n", "scale", "f_m", "f_yy", "f_xtx", "f_xty", "s_m", "s_yy", "s_xtx", "s_xty",
                     F.col("_last.t").alias("t_last"), F.col("_last.e").alias("e_last"),
                     F.transform("_tail", lambda p: p["y"]).alias("tail"))
    out_schema = T.StructType([T.StructField(c, T.StringType()) for c in SERIES_KEY] + [
        T.StructField("t_last", T.IntegerType()),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("sd", T.ArrayType(T.DoubleType()))])
    fc = agg.mapInPandas(_stage2_and_forecast(horizon), schema=out_schema).filter(F.col("mean").isNotNull())
    steps = _steps(fc, horizon)
    mean = F.element_at("mean", F.col("h"))
    sd = F.element_at("sd", F.col("h"))
    return _finish(steps, "seasonal_arma", mean, F.lit(Z80) * sd, F.lit(Z95) * sd)


# --------------------------------------------------------------------------
# Ensemble and bands
# --------------------------------------------------------------------------

def ensemble(sarima: DataFrame, hw: DataFrame, naive: DataFrame) -> DataFrame:
    """M08 + M09: weighted mean of the available models per (series, step);
    bands are the primary model's (ARMA, else naive) scaled by
    ensemble/primary, re-ordered and floored at 0."""
    allm = sarima.unionByName(hw).unionByName(naive)
    keys = [*SERIES_KEY, "h", "t", "period"]

    def pick(model, col="value_predicted"):
        return F.max(F.when(F.col("model") == model, F.col(col)))

    g = allm.groupBy(*keys).agg(
        pick("seasonal_arma").alias("vs"), pick("holt_winters").alias("vh"), pick("seasonal_naive").alias("vn"),
        *[pick("seasonal_arma", c).alias(f"s_{c}") for c in ("ci_lower_80", "ci_upper_80", "ci_lower_95", "ci_upper_95")],
        *[pick("seasonal_naive", c).alias(f"n_{c}") for c in ("ci_lower_80", "ci_upper_80", "ci_lower_95", "ci_upper_95")])
    short = F.col("h") <= SHORT_STEPS

    def w(name):
        return F.when(short, F.lit(WEIGHTS_SHORT[name])).otherwise(F.lit(WEIGHTS_MEDIUM[name]))

    num = F.lit(0.0)
    den = F.lit(0.0)
    for col, name in (("vs", "sarima"), ("vh", "hw"), ("vn", "naive")):
        num = num + F.coalesce(w(name) * F.col(col), F.lit(0.0))
        den = den + F.when(F.col(col).isNotNull(), w(name)).otherwise(F.lit(0.0))
    ens = F.when(den > 0, num / den)
    primary = F.coalesce("vs", "vn")
    ratio = F.when(F.abs(primary) > 1e-10, ens / primary).otherwise(F.lit(1.0))

    def band(c):
        return F.coalesce(F.when(F.col("vs").isNotNull(), F.col(f"s_{c}")), F.col(f"n_{c}")) * ratio

    lo80, hi80, lo95, hi95 = (band(c) for c in ("ci_lower_80", "ci_upper_80", "ci_lower_95", "ci_upper_95"))
    # Re-order (scaling can flip), keep the ensemble value inside its bands
    # (ratio 1 when the primary is ~0 would otherwise leave it outside) and
    # floor the lower bounds at 0.
    l80, u80 = F.least(lo80, hi80, ens), F.greatest(lo80, hi80, ens)
    l95, u95 = F.least(lo95, hi95, l80), F.greatest(lo95, hi95, u80)
    return g.select(
        F.lit("ensemble").alias("model"), *keys,
        X.round2(ens, 2).alias("value_predicted"),
        X.round2(F.greatest(l80, F.lit(0.0)), 2).alias("ci_lower_80"),
        X.round2(u80, 2).alias("ci_upper_80"),
        X.round2(F.greatest(l95, F.lit(0.0)), 2).alias("ci_lower_95"),
        X.round2(u95, 2).alias("ci_upper_95")).filter(F.col("value_predicted").isNotNull())


class Kept:
    """Persists frames and lets go of them together, when what is read from
    them has been written: ``with Kept() as keep: all_models(train, 12, keep)...``"""

    def __enter__(self):
        self.frames: list[DataFrame] = []
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist())
        return self.frames[-1]

    def __exit__(self, *_):
        for df in self.frames:
            df.unpersist()


def all_models(train: DataFrame, horizon: int = 12, keep=DataFrame.persist) -> DataFrame:
    """The four models for the whole fleet, one DataFrame."""
    # The training series feeds every model, and each base forecast feeds both
    # the output and the ensemble: keep them so each is computed once (lost
    # blocks are recomputed from lineage).
    train = keep(train)
    n = keep(seasonal_naive(train, horizon))
    hw = keep(holt_winters(train, horizon))
    sa = keep(seasonal_arma(train, horizon, keep=keep))
    return sa.unionByName(hw).unionByName(n).unionByName(ensemble(sa, hw, n))


# --------------------------------------------------------------------------
# Back-test and metrics
# --------------------------------------------------------------------------

def holdout_split(train: DataFrame, test_size: int = 12, min_clean: int = MIN_CLEAN_FOR_BACKTEST):
    """M10 split: the last ``test_size`` observed (clean) months of each series
    are the test set; series with fewer than ``min_clean`` clean months are
    skipped. Returns (train part, actuals)."""
    obs = train.filter(F.col("value").isNotNull())
    w = S.series_window().orderBy(F.col("t").desc())
    ranked = obs.withColumn("_rk", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(S.series_window()))
    ranked = ranked.filter(F.col("_n") >= min_clean)
    actual = ranked.filter(F.col("_rk") <= test_size).select(*SERIES_KEY, "t", F.col("value").alias("actual"))
    cut = ranked.filter(F.col("_rk") == test_size + 1).select(*SERIES_KEY, F.col("t").alias("_cut"))
    part = train.join(cut, SERIES_KEY).filter(F.col("t") <= F.col("_cut")).drop("_cut")
    return part, actual


def metrics(forecasts: DataFrame, actual: DataFrame) -> DataFrame:
    """RMSE, MAE, MAPE (zero actuals excluded) per (model, series),
    forecast steps matched to actuals by month ordinal (T31)."""
    j = forecasts.join(actual, SERIES_KEY + ["t"])
    e = X.exact("actual", 18) - X.exact("value_predicted", 18)
    ape = F.when(F.col("actual") != 0, F.abs((F.col("actual") - F.col("value_predicted")) / F.col("actual")))
    ape = ape.cast("decimal(38,10)")
    g = j.groupBy("model", *SERIES_KEY).agg(
        F.count(e).alias("test_size"), F.sum(e * e).alias("_sq"), F.sum(F.abs(e)).alias("_ab"),
        F.sum(ape).alias("_ape"), F.count(ape).alias("_napes"))
    return g.select(
        "model", *SERIES_KEY, "test_size",
        X.round2(F.sqrt(F.col("_sq").cast("double") / F.col("test_size")), 2).alias("rmse"),
        X.round2(F.col("_ab").cast("double") / F.col("test_size"), 2).alias("mae"),
        X.round2(F.col("_ape").cast("double") / F.col("_napes") * 100.0, 2).alias("mape"))


def backtest(train: DataFrame, models=("naive",), test_size: int = 12, keep=DataFrame.persist) -> DataFrame:
    """Fit on the training part, forecast the hold-out, score it. With
    all three base models the ensemble is scored too (same fallback and
    renormalisation as in prediction, T30)."""
    part, actual = holdout_split(train, test_size)
    part = keep(part)  # feeds every model
    fcs = {}
    if "naive" in models:
        fcs["naive"] = seasonal_naive(part, test_size)
    if "hw" in models:
        fcs["hw"] = holt_winters(part, test_size)
    if "sarima" in models:
        fcs["sarima"] = seasonal_arma(part, test_size, keep=keep)
    fc = None
    for f in fcs.values():
        fc = f if fc is None else fc.unionByName(f)
    if len(fcs) == 3:
        for k in fcs:
            fcs[k] = keep(fcs[k])
        fc = fcs["naive"].unionByName(fcs["hw"]).unionByName(fcs["sarima"])
        fc = fc.unionByName(ensemble(fcs["sarima"], fcs["hw"], fcs["naive"]))
    return metrics(fc, actual)


def best_model(metrics_df: DataFrame) -> DataFrame:
    """Lowest MAPE per series, then most test points, then model name."""
    w = Window.partitionBy(*SERIES_KEY).orderBy(F.col("mape").asc_nulls_last(),
                                               F.col("test_size").desc(), F.col("model").asc())
    return metrics_df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# --------------------------------------------------------------------------
# Prediction table reads
# --------------------------------------------------------------------------

def current_predictions(current: DataFrame, horizon: int = 12, metrics_df: DataFrame | None = None) -> DataFrame:
    """Q09: of current versions (F07) the first ``horizon`` periods per model
    and series (W11), with metrics (J09), ``ci_available`` (F12), how many
    periods there are and whether that is all that was asked for."""
    if not 1 <= horizon <= 24:
        raise ValueError("horizon must be within 1..24")
    w = Window.partitionBy("model", *SERIES_KEY)
    out = (current.withColumn("_rn", F.row_number().over(w.orderBy("period"))).filter(F.col("_rn") <= horizon).drop("_rn")
                  .withColumn("actual_horizon", F.count(F.lit(1)).over(w))
                  .withColumn("complete", F.col("actual_horizon") >= horizon))
    if metrics_df is not None:
        out = out.join(metrics_df.select("model", *SERIES_KEY, "rmse", "mae", "mape"), ["model", *SERIES_KEY], "left")
    return out.withColumn("ci_available", F.col("ci_lower_80").isNotNull() & F.col("ci_upper_80").isNotNull())


def compare_models(preds: DataFrame, metrics_df: DataFrame, horizon: int = 12) -> DataFrame:
    """Q10: the points of every model of a series side by side (first
    ``horizon`` periods, W11), with the model's back-test metrics (J09) and
    whether it is the series' best by them (O05)."""
    w = Window.partitionBy("model", *SERIES_KEY).orderBy("period")
    points = preds.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= horizon).drop("_rn")
    best = best_model(metrics_df).select(*SERIES_KEY, F.col("model").alias("_best"))
    return (points.join(metrics_df.select("model", *SERIES_KEY, "rmse", "mae", "mape"), ["model", *SERIES_KEY], "left")
                  .join(best, SERIES_KEY, "left")
                  .withColumn("is_best", F.coalesce(F.col("model") == F.col("_best"), F.lit(False))).drop("_best"))


def prediction_history(preds: DataFrame, versions: int = 5) -> DataFrame:
    """The newest ``versions`` versions per (model, series)."""
    w = Window.partitionBy("model", *SERIES_KEY).orderBy(F.col("version").desc())
    return preds.withColumn("_vr", F.dense_rank().over(w)).filter(F.col("_vr") <= versions).drop("_vr")


def history_with_forecast(history: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Observed points and the forecast points of every model as one
    tagged series (``is_forecast``, ``model``), bands and the model's metrics
    kept."""
    bands = ("ci_lower_80", "ci_upper_80", "ci_lower_95", "ci_upper_95", "rmse", "mae", "mape")
    h = history.select(F.lit(None).cast("string").alias("model"), *SERIES_KEY, "period", F.col("value"),
                       F.lit(False).alias("is_forecast"), *[F.lit(None).cast("double").alias(c) for c in bands])
    f = forecasts.select("model", *SERIES_KEY, "period", F.col("value_predicted").alias("value"),
                         F.lit(True).alias("is_forecast"), *bands)
    return h.unionByName(f)
