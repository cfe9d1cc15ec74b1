"""Count-series forecasting baselines and rolling-origin evaluation.

A series has one row per period (day or week) and is bounded by the calendar,
not by the row volume: the heavy work ends at the first daily aggregation.
Functions accept ``by`` columns so many series (one per entity, one per
cutoff) are handled by the same grouped jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.operators import events, series
from panelrisk.operators.positions import attach
from panelrisk.spec import PanelSpec

WEATHER = ("temp", "humidity")


def build_timeseries(panel: DataFrame, spec: PanelSpec, freq: str = "W", with_weather: bool = True) -> DataFrame:
    """events → daily fleet count → gap-free calendar (+ interpolated weather means) → weekly.

    Returns ``ds, y`` (double) and, with weather, ``temp, humidity``.
    """
    ev = events.with_events(panel, spec)
    daily = series.daily_sum(ev, spec.date, "event").withColumn("y", F.col("y").cast("double"))
    dense = series.densify(daily, {"y": 0.0})
    if with_weather:
        w = series.daily_mean(panel, spec.date, [spec.temp, spec.humidity]).toDF("ds", "temp", "humidity")
        w = series.interpolate_linear(dense.select("ds").join(w, "ds", "left"), list(WEATHER))
        dense = dense.join(F.broadcast(w), "ds", "left")
    if freq == "D":
        return dense
    return series.weekly(dense, ["y"], list(WEATHER) if with_weather else [])


def parse_ranges(ranges: str | None) -> list[tuple[str, str]]:
    """'S:E,S:E' → [(S, E), …] (a configuration string, not data)."""
    if not ranges:
        return []
    out = []
    for part in ranges.split(","):
        s, e = part.split(":")
        out.append((s.strip(), e.strip()))
    return out


def mask_ranges(ts: DataFrame, ranges: str | None, ds: str = "ds", y: str = "y") -> DataFrame:
    """Set ``y`` NULL where S <= ds <= E for any range; rows are kept; adds ``masked``."""
    conds = [F.col(ds).between(F.lit(s).cast("date"), F.lit(e).cast("date")) for s, e in parse_ranges(ranges)]
    hit = F.lit(False)
    for c in conds:
        hit = hit | c
    return ts.withColumn("masked", hit.cast("int")).withColumn(y, F.when(hit, F.lit(None)).otherwise(F.col(y)))


def with_period_index(ts: DataFrame, ds: str = "ds", by=(), out: str = "t") -> DataFrame:
    """0-based period index within each series (bounded by the calendar)."""
    return ts.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(ds)) - 1)


def holdout_split(ts: DataFrame, train_frac: float = 0.8, by=(), ds: str = "ds") -> DataFrame:
    """First int(n·frac) periods train, rest holdout (G02); adds ``t`` and ``n_train``."""
    t = with_period_index(ts, ds, by)
    n = ts.groupBy(*by).agg(F.floor(F.count(F.lit(1)) * train_frac).alias("n_train"))
    t = attach(t, n, by)
    return t.withColumn("split", F.when(F.col("t") < F.col("n_train"), "train").otherwise("holdout"))


def naive_mean(split_ts: DataFrame, by=(), y: str = "y") -> DataFrame:
    """Constant forecast = NULL-safe mean of train ``y`` (M02): (by…, naive_mean)."""
    return split_ts.filter("split = 'train'").groupBy(*by).agg(F.avg(y).alias("naive_mean"))


def seasonal_lag(ts: DataFrame, period: int, by=(), y: str = "y", t: str = "t", out: str = "y_lag") -> DataFrame:
    """Value ``period`` positions earlier in the same series."""
    return ts.withColumn(out, F.lag(y, period).over(Window.partitionBy(*by).orderBy(t)))


def seasonal_naive(split_ts: DataFrame, period: int, by=(), y: str = "y") -> DataFrame:
    """Holdout prediction = the value one season earlier, else the train mean.

    Positions before the start or masked values fall back to the mean of the
    train periods (never to the point being predicted).
    """
    lagged = seasonal_lag(split_ts, period, by, y)
    m = naive_mean(split_ts, by, y)
    lagged = attach(lagged, m, by)
    return lagged.withColumn("snaive", F.coalesce(F.col("y_lag"), F.col("naive_mean"))).drop("y_lag")


def trend_fit(split_ts: DataFrame, by=(), y: str = "y", t: str = "t") -> DataFrame:
    """Least-squares line y = a + b·t on train periods (M04): (by…, intercept, slope)."""
    tr = split_ts.filter(F.col("split") == "train").filter(F.col(y).isNotNull())
    return tr.groupBy(*by).agg(F.regr_intercept(y, t).alias("intercept"), F.regr_slope(y, t).alias("slope"))


def trend_forecast(split_ts: DataFrame, by=(), y: str = "y", t: str = "t") -> DataFrame:
    fit = trend_fit(split_ts, by, y, t)
    return attach(split_ts, fit, by).withColumn(
        "trend", F.greatest(F.col("intercept") + F.col("slope") * F.col(t), F.lit(0.0))
    ).drop("intercept", "slope")


def make_future(ts: DataFrame, horizon: int, step_days: int = 7, ds: str = "ds", by=()) -> DataFrame:
    """The next ``horizon`` periods after the last ``ds`` of each series."""
    last = ts.groupBy(*by).agg(F.max(ds).alias("_last"))
    return last.select(
        *by,
        F.explode(F.sequence(F.date_add("_last", step_days), F.date_add("_last", step_days * horizon),
                             F.expr(f"INTERVAL {step_days} DAYS"))).alias(ds),
    )


def cutoffs(ts: DataFrame, horizon_days: int, ds: str = "ds", initial_frac: float = 0.5,
            period_frac: float = 0.1, min_period_days: int = 7, by=()) -> DataFrame:
    """Rolling-origin cutoffs (M11): from max - horizon back by ``period`` while >= min + initial.

    initial = int(span·0.5) days, period = max(int(span·0.1), 7) days. Each ``by`` series has its own.
    """
    b = ts.groupBy(*by).agg(F.min(ds).alias("_lo"), F.max(ds).alias("_hi"))
    b = b.withColumn("_span", F.datediff("_hi", "_lo"))
    b = b.withColumn("_initial", F.floor(F.col("_span") * initial_frac).cast("int")) \
         .withColumn("_period", F.greatest(F.floor(F.col("_span") * period_frac).cast("int"), F.lit(min_period_days)))
    first = F.date_sub("_hi", horizon_days)
    n = F.floor((F.datediff(first, "_lo") - F.col("_initial")) / F.col("_period")).cast("int")
    b = b.withColumn("_n", n)
    return b.filter(F.col("_n") >= 0).select(
        *by, F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_j"), "_hi", "_period"
    ).select(*by, F.date_sub(F.date_sub("_hi", horizon_days), F.col("_j") * F.col("_period")).alias("cutoff"))


def cv_points(ts: DataFrame, cuts: DataFrame, horizon_days: int, ds: str = "ds") -> DataFrame:
    """Rows in (cutoff, cutoff + horizon] for every cutoff.

    The cutoff table is tiny; the range condition is a filter on each
    (row, cutoff) pair of the broadcast side.
    """
    j = ts.crossJoin(F.broadcast(cuts))
    return j.filter((F.col(ds) > F.col("cutoff")) & (F.col(ds) <= F.date_add("cutoff", horizon_days))) \
        .withColumn("horizon", F.datediff(F.col(ds), F.col("cutoff")))


def cv_naive(ts: DataFrame, cuts: DataFrame, horizon_days: int, ds: str = "ds", y: str = "y") -> DataFrame:
    """Naive-mean forecasts per cutoff: mean of y up to the cutoff (M11 for the baseline)."""
    hist = ts.crossJoin(F.broadcast(cuts)).filter(F.col(ds) <= F.col("cutoff")).groupBy("cutoff").agg(
        F.avg(y).alias("yhat"))
    pts = cv_points(ts, cuts, horizon_days, ds).filter(F.col(y).isNotNull())
    return pts.join(F.broadcast(hist), "cutoff").select("cutoff", ds, "horizon", y, "yhat")


def error_by_horizon(points: DataFrame, y: str = "y", yhat: str = "yhat", rolling: float = 0.1, by=(),
                     lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Rolling MAE, RMSE, MAPE and (with ``lower`` and ``upper``) coverage by horizon over ``rolling`` of the points.

    Points are grouped by horizon; for each horizon the mean covers that
    horizon's points and as many earlier-horizon points as needed to reach
    w = max(1, int(rolling·n)) points, the earliest group counted partially.
    Horizons without w points to their left are dropped. MAPE is a fraction,
    NULL where any actual value is within 1e-8 of 0. Works on the per-horizon
    table (bounded by the horizon length), per ``by`` series.
    """
    from panelrisk.operators.positions import asof_lookup

    by = list(by)
    e = F.col(y) - F.col(yhat)
    values = {"mae": F.abs(e), "rmse": e * e, "mape": F.try_divide(F.abs(e), F.abs(F.col(y)))}
    if lower and upper:
        values["coverage"] = F.when(F.col(y).between(F.col(lower), F.col(upper)), 1.0).otherwise(0.0)
    g = points.groupBy(*by, "horizon").agg(*[F.sum(v).alias(f"g_{m}") for m, v in values.items()], F.count(F.lit(1)).alias("cnt"))
    n = points.groupBy(*by).agg(F.greatest(F.floor(F.count(F.lit(1)) * rolling), F.lit(1)).alias("w"),
                                (F.min(F.abs(F.col(y))) < 1e-8).alias("_zero"))
    w = Window.partitionBy(*by).orderBy("horizon").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.select("*", F.sum("cnt").over(w).alias("cn"), *[F.sum(f"g_{m}").over(w).alias(f"c_{m}") for m in values])
    g = attach(g, n, by)
    # the window of horizon t starts in the group i holding point rank cn_t - w (as-of on the
    # groups' start ranks); horizons with fewer than w points up to them are dropped
    cums = [f"c_{m}" for m in values]
    probe = g.filter(F.col("cn") >= F.col("w")).select(*by, "horizon", "w", "_zero", "cn", *cums, (F.col("cn") - F.col("w")).alias("_rank"))
    first = ["cn", "cnt", *cums, *[f"g_{m}" for m in values]]
    starts = g.select(*by, (F.col("cn") - F.col("cnt")).alias("i_start"), *[F.col(c).alias(f"i_{c}") for c in first])
    best = asof_lookup(probe, starts, by, "_rank", "i_start", [f"i_{c}" for c in first])
    excess = F.col("cn") - F.col("i_cn") + F.col("i_cnt") - F.col("w")

    def rolled(m: str) -> Column:
        total = F.col(f"c_{m}") - F.col(f"i_c_{m}") + F.col(f"i_g_{m}")
        return (total - excess * F.col(f"i_g_{m}") / F.col("i_cnt")) / F.col("w")

    shown = {m: rolled(m) for m in values}
    shown["rmse"] = F.sqrt(shown["rmse"])
    shown["mape"] = F.when(~F.col("_zero"), shown["mape"])
    return best.select(*by, "horizon", *[c.alias(m) for m, c in shown.items()])
