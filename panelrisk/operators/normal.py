"""Ridge fits of trend + seasonality from summed products.

A series is fitted from its normal equations. Each fitted row becomes a base
vector (1, time, Fourier terms, regressors, y); the products of its entries are
summed per segment of the series, where the segments lie between its changepoints
and cutoffs. A hinge ``max(0, day - c)`` is linear in (1, time) beyond ``c``, so
all products with hinges follow from running sums over the segments, and so does
the fit at every cutoff: one scan of the series serves all of them. What is
shuffled is each series' days and values (one per period, so the calendar bounds
a series); the vectors and their sums, a hundred times larger, live in the task
that solves the small systems of the series, one per cutoff.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.operators.positions import attach, join_groups
from panelrisk.session import bound_batches

# Fixed model settings: Fourier orders, changepoints, ridge penalty, 80 % band.
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
RIDGE = 1.0
Z80 = 1.2815515655446004

DAY_SCALE = 1000.0  # time in the base vector is in thousands of days, so that products stay near 1
QUANTILES = [float(q) for q in np.linspace(0, CHANGEPOINT_RANGE, N_CHANGEPOINTS + 2)[1:-1]]


def _terms(weekly: bool) -> list[tuple[float, int]]:
    out = [(365.25, k) for k in range(1, YEARLY_ORDER + 1)]
    return out + [(7.0, k) for k in range(1, WEEKLY_ORDER + 1)] if weekly else out


def base_vector(day: Column, ds: Column, regressors: list[str], weekly: bool) -> list[Column]:
    """1, time, (sin, cos) per Fourier term, (value or 0, is known) per regressor."""
    epoch = F.datediff(ds, F.lit("1970-01-01").cast("date")).cast("double")
    out = [F.lit(1.0), day / DAY_SCALE]
    for period, k in _terms(weekly):
        angle = epoch * (2 * math.pi * k / period)
        out += [F.sin(angle), F.cos(angle)]
    for r in regressors:
        v = F.col(r).cast("double")
        known = v.isNotNull() & ~F.isnan(v)
        out += [F.when(known, v).otherwise(0.0), F.when(known, 1.0).otherwise(0.0)]
    return out


def _between(days: Column, n: Column, q: Column) -> Column:
    """Quantile ``q`` of the first ``n`` of the sorted ``days``, linear between neighbours."""
    h = (n - 1) * q
    low = F.floor(h).cast("int")
    a = F.get(days, low)
    b = F.get(days, F.least(low + 1, n - 1))
    return a + (h - low) * (b - a)


def _fit_plans(ts: DataFrame, by: list[str], is_fit: Column, cuts: DataFrame | None, horizon_days: int) -> DataFrame:
    """(by…, lo, cutoff, cut_day, span, cps): what each wanted fit looks at. Days count from the start of the series."""
    day = lambda c: F.datediff(c, F.col("lo")).cast("double")
    b = ts.groupBy(*by).agg(F.min("ds").alias("lo"), F.sort_array(F.collect_list("ds")).alias("_all"),
                            F.sort_array(F.collect_list(F.when(is_fit, F.col("ds")))).alias("_fit"))
    b = b.filter(F.col("lo").isNotNull()).select(*by, "lo", F.transform("_all", day).alias("_all"),
                                                 F.transform("_fit", day).alias("_fit"))
    if cuts is None:
        b = b.withColumn("cutoff", F.lit(None).cast("date")).withColumn("cut_day", F.lit(None).cast("double"))
        seen, end = F.size("_fit"), F.array_max("_all")
    else:
        b = attach(cuts.select(*by, "cutoff"), b, by).withColumn("cut_day", day(F.col("cutoff")))
        seen = F.size(F.filter("_fit", lambda d: d <= F.col("cut_day")))
        end = F.array_max(F.filter("_all", lambda d: d <= F.col("cut_day") + horizon_days))
    b = b.withColumn("_n", seen)
    cps = F.transform(F.lit(QUANTILES), lambda q: _between(F.col("_fit"), F.col("_n"), q))
    none = F.array().cast("array<double>")
    return b.select(*by, "lo", "cutoff", "cut_day", F.greatest(end, F.lit(1.0)).alias("span"),
                    F.when(F.col("_n") > 2, cps).otherwise(none).alias("cps"))


def _prefix_products(first: int, edges: np.ndarray, epoch: np.ndarray, target: np.ndarray, regressors: list[np.ndarray],
                     weekly: bool) -> np.ndarray:
    """Products of the entries of :func:`base_vector` and the target, summed over the segments up to each one."""
    order = np.lexsort((target, *regressors, epoch))  # the same sums on every run
    epoch, target = epoch[order], target[order]
    cols = [np.ones(len(epoch)), (epoch - first) / DAY_SCALE]
    for period, k in _terms(weekly):
        angle = epoch * (2 * math.pi * k / period)
        cols += [np.sin(angle), np.cos(angle)]
    for r in regressors:
        r = r[order]
        cols += [np.where(np.isnan(r), 0.0, r), np.where(np.isnan(r), 0.0, 1.0)]
    x = np.column_stack([*cols, target])
    ends = [*np.searchsorted(epoch - first, edges, side="right"), len(x)]  # a row of segment s lies behind s edges
    return np.cumsum([x[a:b].T @ x[a:b] for a, b in zip([0, *ends], ends)], axis=0)


def solve_at(prefix: np.ndarray, edges: np.ndarray, cut_day: float | None, span: float, cps: np.ndarray,
             n_fourier: int, n_reg: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients of the base vector and of the hinges (in days), and the residual deviation.

    ``prefix[s]`` holds the products of all rows in segments up to ``s``; a row
    of segment ``s`` lies behind exactly ``s`` of the ``edges``.
    """
    p = prefix.shape[1] - 1
    last = len(edges) if cut_day is None else int(np.searchsorted(edges, cut_day))
    total = prefix[last]
    k = len(cps)
    n = total[0, 0]
    if n == 0:
        return np.zeros(p), np.zeros(k), 0.0
    raw = np.zeros((p + k + 1, p + k + 1))  # base terms, hinges, y
    base = [*range(p), p + k]
    raw[np.ix_(base, base)] = total
    behind = [total - prefix[int(np.searchsorted(edges, c))] for c in cps]
    for i, c in enumerate(cps):
        row = DAY_SCALE * behind[i][1] - c * behind[i][0]
        raw[p + i, base] = raw[base, p + i] = row
        for j in range(i + 1):  # cps ascend: both hinges are open behind the later one
            r, e = behind[i], cps[j]
            raw[p + i, p + j] = raw[p + j, p + i] = (DAY_SCALE ** 2 * r[1, 1] - DAY_SCALE * (c + e) * r[0, 1]
                                                     + c * e * r[0, 0])
    # model terms (time over span, standardised regressors) as combinations of the raw ones
    n_base = 2 + n_fourier
    w = np.zeros((n_base + n_reg + k, p + k))
    w[:n_base, :n_base] = np.eye(n_base)
    w[1, 1] = DAY_SCALE / span
    for r in range(n_reg):
        value, known = n_base + 2 * r, n_base + 2 * r + 1
        count = total[known, known]
        if count > 0:
            mean = total[0, value] / count
            var = total[value, value] / count - mean * mean
            sd = math.sqrt(var) if var > 1e-12 * max(mean * mean, 1e-300) else 1.0
            w[n_base + r, value], w[n_base + r, known] = 1 / sd, -mean / sd
    w[n_base + n_reg:, p:] = np.eye(k) / span
    gram, xy = w @ raw[:-1, :-1] @ w.T, w @ raw[:-1, -1]
    penalty = RIDGE * np.eye(len(gram))
    penalty[0, 0] = 0.0
    beta = np.linalg.solve(gram + penalty, xy)
    squares = max(raw[-1, -1] - 2 * beta @ xy + beta @ gram @ beta, 0.0)
    mean_residual = (total[0, -1] - beta @ gram[:, 0]) / n
    sd = math.sqrt(max(squares - n * mean_residual ** 2, 0.0) / (n - 1)) if n > 1 else 0.0
    coef = w.T @ beta
    return coef[:p], coef[p:], sd


def fit_series(ts: DataFrame, by=(), fit_col: str | None = None, regressors=(), multiplicative: bool = False,
               weekly: bool = False, cuts: DataFrame | None = None, horizon_days: int = 0) -> DataFrame:
    """One row per series (and cutoff): ``by…, lo, cutoff, cps, hinges, beta, resid_sd``.

    ``ts`` has ``by…, ds, y`` and the regressors. Rows with ``fit_col`` true (all
    when None) and a known ``y`` are fitted; with ``cuts`` (``by…, cutoff``) those
    up to each cutoff. A series without such rows gets zeros.
    """
    by, regs = list(by), list(regressors)
    bound_batches(ts.sparkSession)
    y = F.col("y").cast("double")
    is_fit = y.isNotNull() & ~F.isnan(y)
    if fit_col:
        is_fit = is_fit & F.coalesce(F.col(fit_col).cast("boolean"), F.lit(False))
    plans = _fit_plans(ts, by, is_fit, cuts, horizon_days)
    # by… → start and edges of the segments (at most 26 per cutoff)
    own = F.when(F.col("cut_day").isNull(), F.col("cps")).otherwise(F.concat("cps", F.array("cut_day")))
    wanted = plans.groupBy(*by).agg(
        F.first("lo").alias("lo"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("edges"),
        F.collect_list(F.struct("cutoff", "cut_day", "span", "cps")).alias("wanted"))
    wanted = wanted.filter(F.col("lo").isNotNull())
    target = F.log1p(F.greatest(y, F.lit(0.0))) if multiplicative else y
    epoch = F.datediff("ds", F.lit("1970-01-01").cast("date"))
    known = {f"r{i}": F.coalesce(F.col(r).cast("double"), F.lit(float("nan"))) for i, r in enumerate(regs)}
    # no value is NULL, so the lists of a series are aligned
    values = {"epoch": epoch, "target": target, **known}
    rows = ts.filter(is_fit & F.col("ds").isNotNull()).groupBy(*by).agg(*[F.collect_list(v).alias(n) for n, v in values.items()])
    names = list(values)
    wanted = wanted.withColumn("first", F.datediff("lo", F.lit("1970-01-01").cast("date")))
    todo = join_groups(wanted, rows, by, "left") if by else attach(wanted, rows)
    n_fourier, n_reg = 2 * len(_terms(weekly)), len(regs)

    def solve(batches):
        for b in batches:
            out = []
            for rec in b.to_dict("records"):
                edges = np.asarray(rec["edges"], dtype=float)
                columns = [np.asarray(rec[n] if rec[n] is not None else [], dtype=float) for n in names]
                prefix = _prefix_products(rec["first"], edges, *columns[:2], columns[2:], weekly)
                for w in rec["wanted"]:
                    cps = np.asarray(w["cps"], dtype=float)
                    cut_day = None if w["cut_day"] is None else float(w["cut_day"])
                    beta, hinges, sd = solve_at(prefix, edges, cut_day, float(w["span"]), cps, n_fourier, n_reg)
                    out.append([*[rec[k] for k in by], rec["lo"], w["cutoff"], cps, hinges, beta, sd])
            yield pd.DataFrame(out, columns=[*by, "lo", "cutoff", "cps", "hinges", "beta", "resid_sd"])

    keys = "".join(f"{k} {ts.schema[k].dataType.simpleString()}, " for k in by)
    return todo.select(*by, "lo", "first", "edges", "wanted", *names).mapInPandas(
        solve, keys + "lo date, cutoff date, cps array<double>, hinges array<double>, beta array<double>, resid_sd double")


def predict(rows: DataFrame, regressors=(), multiplicative: bool = False, weekly: bool = False) -> DataFrame:
    """Adds ``yhat, yhat_lower, yhat_upper`` (clipped at 0) and the components to rows that carry their fit.

    ``trend``, ``yearly`` and, with ``weekly``, ``weekly`` are on the scale of the fit (log1p if multiplicative).
    """
    day = F.datediff("ds", "lo").cast("double")
    vec = base_vector(day, F.col("ds"), list(regressors), weekly)

    def part(a: int, b: int) -> Column:
        out = F.lit(0.0)
        for j in range(a, b):
            out = out + vec[j] * F.get("beta", F.lit(j))
        return out

    hinge = F.aggregate(F.zip_with("cps", "hinges", lambda c, h: h * F.greatest(F.col("_day") - c, F.lit(0.0))),
                        F.lit(0.0), lambda a, v: a + v)
    year_end = 2 + 2 * YEARLY_ORDER
    week_end = 2 + 2 * len(_terms(weekly))
    out = rows.withColumn("_day", day).withColumn("trend", part(0, 2) + hinge).withColumn("yearly", part(2, year_end))
    out = out.withColumn("weekly", part(year_end, week_end))
    out = out.withColumn("_mean", F.col("trend") + F.col("yearly") + F.col("weekly") + part(week_end, len(vec)))
    back = (lambda c: F.expm1(c)) if multiplicative else (lambda c: c)
    clip = lambda c: F.greatest(back(c), F.lit(0.0))
    out = out.withColumn("yhat", clip(F.col("_mean")))
    out = out.withColumn("yhat_lower", clip(F.col("_mean") - Z80 * F.col("resid_sd")))
    out = out.withColumn("yhat_upper", clip(F.col("_mean") + Z80 * F.col("resid_sd")))
    return out.drop("_day", "_mean", "lo", "cps", "hinges", "beta", "resid_sd", *([] if weekly else ["weekly"]))
