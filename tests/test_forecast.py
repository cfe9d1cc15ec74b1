"""Seasonal fits from summed products against a fit on the rows themselves."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelrisk.operators import forecast as fc
from panelrisk.plans import forecast as pf


def literal_fit(pdf, fit, regs=(), multiplicative=False, weekly=False):
    """Ridge least squares on the rows of one series: (yhat, lower, upper, trend)."""
    ds = pd.to_datetime(pdf["ds"])
    day = (ds - ds.min()).dt.days.to_numpy(float)
    epoch = (ds - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)
    y = pdf["y"].to_numpy(float)
    fit = np.asarray(fit) & ~np.isnan(y)
    t = day / max(day.max(), 1.0)
    cps = np.quantile(t[fit], np.linspace(0, 0.8, 27)[1:-1]) if fit.sum() > 2 else []
    cols = [np.ones_like(t), t, *[np.maximum(0.0, t - c) for c in cps]]
    n_trend = len(cols)
    for period, order in ((365.25, 10), *(((7, 3),) if weekly else ())):
        for k in range(1, order + 1):
            cols += [np.sin(2 * np.pi * k * epoch / period), np.cos(2 * np.pi * k * epoch / period)]
    for r in regs:
        v = pdf[r].to_numpy(float)
        cols.append(np.nan_to_num((v - np.nanmean(v[fit])) / (np.nanstd(v[fit]) or 1.0)))
    x = np.column_stack(cols)
    target = np.log1p(np.clip(y, 0, None)) if multiplicative else y
    penalty = np.eye(x.shape[1])
    penalty[0, 0] = 0
    beta, sd = np.zeros(x.shape[1]), 0.0
    if fit.any():
        beta = np.linalg.solve(x[fit].T @ x[fit] + penalty, x[fit].T @ target[fit])
        sd = np.std(target[fit] - x[fit] @ beta, ddof=1) if fit.sum() > 1 else 0.0
    mean = x @ beta
    band = [mean, mean - 1.2815515655446004 * sd, mean + 1.2815515655446004 * sd]
    band = [np.clip(np.expm1(b) if multiplicative else b, 0, None) for b in band]
    return (*band, x[:, :n_trend] @ beta[:n_trend])


def make_series(n, step, seed):
    rng = np.random.default_rng(seed)
    ds = [dt.date(2018, 1, 7) + dt.timedelta(days=step * i) for i in range(n)]
    y = rng.poisson(8 + 4 * np.sin(np.arange(n) * step * 2 * np.pi / 365.25) + np.arange(n) * 0.02).astype(float)
    y[rng.random(n) < 0.05] = np.nan
    temp = 15 + 10 * np.sin(np.arange(n) * step / 58.0) + rng.normal(0, 1, n)
    temp[rng.random(n) < 0.03] = np.nan
    return pd.DataFrame({"ds": ds, "y": y, "temp": temp})


def frame(spark, pdf, keys=""):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, keys + "ds date, y double, temp double, tr boolean")


def close(got, want, scale=1.0):
    assert np.allclose(got, want, rtol=0, atol=1e-8 * max(scale, np.abs(want).max()))


@pytest.mark.parametrize("step,weekly,multiplicative", [(7, False, False), (1, True, True)])
def test_fit_equals_rows(spark, step, weekly, multiplicative):
    parts = []
    for e, n in ((1, 300), (2, 90), (3, 2), (4, 1), (5, 40)):
        s = make_series(n, step, e)
        s.insert(0, "e", e)
        s["tr"] = np.arange(n) < int(n * 0.8)
        if e == 5:
            s["y"] = np.nan  # nothing to fit
        parts.append(s)
    df = frame(spark, pd.concat(parts), "e int, ")
    got = pf.fit_seasonal(df, ["e"], "tr", ["temp"], multiplicative, weekly).toPandas()
    assert len(got) == sum(len(p) for p in parts)
    for s in parts:
        g = got[got["e"] == s["e"].iloc[0]].sort_values("ds")
        want = literal_fit(s, s["tr"].to_numpy(), ["temp"] if s["temp"].notna().any() else [], multiplicative, weekly) \
            if s["y"].notna().any() else [np.zeros(len(s))] * 4
        for c, w in zip(("yhat", "yhat_lower", "yhat_upper", "trend"), want):
            close(g[c].to_numpy(), w)


def test_every_cutoff_equals_a_refit(spark):
    s = make_series(300, 7, 9).assign(tr=True)
    df = frame(spark, s)
    two = df.withColumn("k", F.lit("a")).unionByName(df.filter("ds < '2021-06-01'").withColumn("k", F.lit("b")))
    for by, ts in (([], df), (["k"], two)):
        cuts = fc.cutoffs(ts, 56, by=by)
        got = pf.cv_seasonal(ts, cuts, 56, by, ["temp"]).toPandas()
        wanted = cuts.toPandas()
        assert len(wanted) >= 5 * max(len(by) * 2, 1)
        for w in wanted.itertuples(index=False):
            own = s[s["ds"] < dt.date(2021, 6, 1)] if by and w.k == "b" else s
            own = own[own["ds"] <= w.cutoff + dt.timedelta(days=56)]
            yhat = literal_fit(own, (own["ds"] <= w.cutoff).to_numpy(), ["temp"])[0]
            g = got[(got["cutoff"] == w.cutoff) & ((got["k"] == w.k) if by else True)].sort_values("ds")
            close(g["yhat"].to_numpy(), yhat[(own["ds"] > w.cutoff).to_numpy()])


def test_error_by_horizon_is_the_rolling_mean_over_points(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(h), float(rng.integers(0 if k == "z" else 1, 9)), float(rng.normal(5, 2)))
            for k in ("a", "z") for h in range(7, 57, 7) for _ in range(5)]
    pts = spark.createDataFrame(rows + [("z", 7, 0.0, 1.0)], "k string, horizon int, y double, yhat double")
    pts = pts.withColumn("lo", F.col("yhat") - 2).withColumn("hi", F.col("yhat") + 2)
    got = fc.error_by_horizon(pts, by=["k"], lower="lo", upper="hi").toPandas().sort_values(["k", "horizon"])
    p = pts.toPandas()
    for k, own in p.groupby("k"):
        w = max(1, int(0.1 * len(own)))
        for r in got[got["k"] == k].itertuples():
            # all points of this horizon count whole; the earliest group gives its mean for what is missing
            need, vals = w, {"mae": 0.0, "mape": 0.0, "coverage": 0.0}
            groups = own[own["horizon"] <= r.horizon].groupby("horizon")
            for h in sorted(groups.groups, reverse=True):
                g = groups.get_group(h)
                take = len(g) if need >= len(g) else need
                e = (g["y"] - g["yhat"]).abs()
                inside = ((g["y"] >= g["lo"]) & (g["y"] <= g["hi"])).astype(float)
                with np.errstate(divide="ignore"):
                    for m, v in (("mae", e), ("mape", e / g["y"]), ("coverage", inside)):
                        vals[m] += v.mean() * take
                need -= take
                if need <= 0:
                    break
            assert abs(r.mae - vals["mae"] / w) < 1e-9 and abs(r.coverage - vals["coverage"] / w) < 1e-9
            assert np.isnan(r.mape) if k == "z" else abs(r.mape - vals["mape"] / w) < 1e-9


def test_future_regressors_are_those_of_the_series(spark):
    rows = [(e, dt.date(2019, 1, 6) + dt.timedelta(days=7 * i), float(i % 5), 10.0 * e) for e in (1, 2) for i in range(60)]
    ts = spark.createDataFrame(rows, "e int, ds date, y double, temp double")
    fut = pf.forecast_with_future(ts, 4, 7, ["e"], ["temp"])
    assert fut.count() == 2 * 64
    from panelrisk.operators import joins

    filled = joins.month_mean_fill(fc.make_future(ts, 4, 7, "ds", ["e"]), ts, "ds", ["temp"], ["e"]).toPandas()
    assert (filled["temp"] == 10.0 * filled["e"]).all() and len(filled) == 8


@pytest.fixture(scope="module")
def panel(spark):
    from panelrisk.session import cut_lineage
    from panelrisk.sources.fixture import fixture_panel

    return cut_lineage(fixture_panel(spark, "/root/testdata/sf0.001"))


def test_forecast_options(spark, panel):
    from panelrisk.spec import FIXTURE_SPEC as S

    entity = panel.agg(F.min("entity_id")).first()[0]
    out = pf.forecast_fleet(panel, S, None, freq="D", with_weather=True, multiplicative=True, entity=entity, cv=True)
    series = out["series"].toPandas()
    events = series["y"].sum()
    assert events == pf.events.with_events(panel, S).filter(F.col("entity_id") == entity).agg(F.sum("event")).first()[0]
    assert out["forecast"].count() == len(series) + 30
    assert {"trend", "yearly", "weekly"} < set(out["components"].columns)
    cv = out["cv"].toPandas()
    assert abs(out["cv_mae"].first()[0] - cv["mae"].mean()) < 1e-12 and cv["coverage"].between(0, 1).all()
    with pytest.raises(ValueError, match="unknown"):
        pf.forecast_fleet(panel, S, entity=-1)


def test_both_halves_of_the_experiment_matrix(spark, panel):
    from panelrisk.operators import metrics
    from panelrisk.plans.experiments import experiment_matrix, weekly_series
    from panelrisk.spec import FIXTURE_SPEC as S

    names = ("full", "until_entity")
    out = experiment_matrix(panel, S, ("logreg",), names)
    table = out["classification"].toPandas()
    assert sorted(table["dataset"]) == sorted(names)
    assert out["best"].toPandas().set_index("dataset")["pr_auc"].to_dict() == table.set_index("dataset")["pr_auc"].to_dict()
    got = out["forecast"].toPandas().set_index("dataset")
    for name in names:
        # the grouped run gives what the series gives by itself
        one = weekly_series(panel, S, [name]).drop("dataset")
        err = metrics.forecast_errors(pf.holdout_predictions(one), "y", "pred", ["model"]).toPandas().set_index("model")
        assert abs(got.loc[name, "model_mae"] - err.loc["seasonal_model", "mae"]) < 1e-8
        assert abs(got.loc[name, "snaive_mae"] - err.loc["seasonal_naive", "mae"]) < 1e-8
        assert abs(got.loc[name, "cv_mae"] - pf.cv_performance(one, 8).toPandas()["mae"].mean()) < 1e-8
        assert got.loc[name, "beats_naive"] == int(err.loc["seasonal_model", "mae"] < err.loc["naive_mean", "mae"])
