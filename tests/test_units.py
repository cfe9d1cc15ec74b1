"""Unit tests on hand-made frames: value rules, traps and the distributed primitives."""

import datetime as dt
import math
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelrisk.functions.calendar import week_ending_sunday
from panelrisk.operators import events, forecast, metrics, positions, series, thresholds, windows
from panelrisk.spec import PanelSpec

SPEC = PanelSpec()


def _panel(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


def test_counter_reset_misses_consecutive_events(spark):
    # counter 5,6,0,0,1,0: drops at index 2 and 5 only; the second 0 is not a drop
    d0 = dt.date(2024, 1, 1)
    rows = [(1, d0 + dt.timedelta(days=i), c) for i, c in enumerate([5, 6, 0, 0, 1, 0])]
    df = _panel(spark, rows, ["entity_id", "date", "days_since_last_event"])
    got = [r.event for r in events.with_events(df, SPEC).orderBy("date").collect()]
    assert got == [0, 0, 1, 0, 0, 1]


def test_nan_and_null_flags_are_zero(spark):
    from panelrisk.functions.columns import thermal_columns

    df = spark.createDataFrame([(float("nan"), 50), (None, 50), (31.0, 50), (-1.0, 50)], "temp double, humidity int")
    df = df.withColumn("temp", F.when(F.isnan("temp"), None).otherwise(F.col("temp")))  # V1: NaN → NULL at load
    out = df.select(*thermal_columns(F.col("temp"), F.col("humidity"))).collect()
    assert [r.is_hot for r in out] == [0, 0, 1, 0]
    assert [r.is_cold for r in out] == [0, 0, 0, 1]


def test_row_windows_match_pandas(spark):
    rng = random.Random(1)
    d0 = dt.date(2024, 1, 1)
    rows, day = [], 0
    for i in range(120):
        day += rng.choice([1, 1, 2, 5])  # gaps: row windows, not calendar windows
        v = None if rng.random() < 0.1 else rng.randint(0, 100)
        rows.append((7, d0 + dt.timedelta(days=day), v, rng.choice([3, 2, 1, 0])))
    df = spark.createDataFrame(rows, "entity_id long, date date, use_today long, days_since_last_event long")
    out = df.select("date", windows.rolling_std_before("use_today", SPEC, 30, 5).alias("s")).orderBy("date").toPandas()
    pdf = pd.DataFrame(rows, columns=["e", "d", "u", "c"]).sort_values("d")
    exp = pdf["u"].astype(float).shift(1).rolling(30, min_periods=5).std()
    np.testing.assert_allclose(out["s"].astype(float).values, exp.values, rtol=1e-9, equal_nan=True)


def test_weekly_label_is_ending_sunday(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2023, 1, 2),), (dt.date(2023, 1, 8),)], "d date")
    got = [r.w for r in df.select(week_ending_sunday(F.col("d")).alias("w")).collect()]
    exp = [pd.Timestamp(x).to_period("W-SUN").end_time.date() for x in ["2023-01-01", "2023-01-02", "2023-01-08"]]
    assert got == exp


def test_positions_with_hot_ties_equal_global_row_number(spark):
    rng = random.Random(3)
    rows = [(i, 0.5 if rng.random() < 0.4 else round(rng.random(), 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "entity_id long, score double")
    got = positions.with_positions(df, "score", descending=True, tiebreak="entity_id", n_ranges=8).toPandas()
    exp = sorted(rows, key=lambda r: (-r[1], r[0]))
    exp_pos = {r[0]: i for i, r in enumerate(exp)}
    assert all(exp_pos[e] == p for e, p in zip(got["entity_id"], got["pos"]))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = np.round(rng.random(2000), 2)  # many ties
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(vals)], "x double, g long")
    probs = [0.0, 0.001, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = positions.exact_quantiles(df, "x", probs, ["g"]).toPandas()
    for (g, q), v in zip(zip(got["g"], got["q"]), got["value"]):
        exp = np.quantile(vals[np.arange(len(vals)) % 3 == g], q)
        assert math.isclose(v, exp, rel_tol=1e-12, abs_tol=1e-12)


def _brute_auc_ap(y, s):
    y, s = np.asarray(y), np.asarray(s)
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        dr = ((s == t) & (y == 1)).sum() / (y == 1).sum()
        ap += dr * (y[sel] == 1).mean()
    return auc, ap


def test_auc_ap_with_ties_match_brute_force(spark):
    rng = np.random.default_rng(7)
    y = (rng.random(600) < 0.3).astype(int)
    s = np.round(rng.random(600) * 0.5 + y * 0.2, 1)  # heavy ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    r = metrics.auc_ap(df, "y", "s").collect()[0]
    auc, ap = _brute_auc_ap(y, s)
    assert math.isclose(r.roc_auc, auc, rel_tol=1e-12)
    assert math.isclose(r.average_precision, ap, rel_tol=1e-12)


def test_grid_thresholds_match_literal_loop(spark):
    rng = np.random.default_rng(11)
    y = (rng.random(800) < 0.25).astype(int)
    s = np.round(rng.random(800) * 0.6 + y * 0.25, 3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    grid = thresholds.grid_table(df, "y", "s")
    ths = np.unique(np.quantile(s, np.linspace(0.001, 0.999, 400)))

    def pr(t):
        pred = s >= t
        tp = (pred & (y == 1)).sum()
        p = tp / pred.sum() if pred.sum() else 0.0
        r = tp / (y == 1).sum()
        return p, r

    best = None
    for t in ths:  # highest feasible threshold for recall >= .8
        p, r = pr(t)
        if r >= 0.8:
            best = (t, p)
    got = thresholds.recall_threshold(grid, 0.8).collect()[0]
    assert math.isclose(got.threshold, best[0], rel_tol=1e-12) and math.isclose(got.precision, best[1], rel_tol=1e-12)
    lowest = next(((t, *pr(t)) for t in ths if (s >= t).sum() > 0 and pr(t)[0] >= 0.5), None)
    got = thresholds.precision_threshold(grid, 0.5).collect()[0]
    if lowest is None:
        assert got.threshold is None
    else:
        assert math.isclose(got.threshold, lowest[0], rel_tol=1e-12)


def test_fixed_mode_without_feasible_threshold_gives_no_alarms(spark):
    from panelrisk.functions.columns import alarm
    from panelrisk.plans.train import choose_threshold

    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3)], "y int, s double")  # no positives: recall 0
    th = choose_threshold(df, "y", "s", "fixed", recall_target=0.8)
    assert th.collect()[0].threshold is None  # T5: NULL threshold
    flags = df.crossJoin(th).select(alarm(F.col("s"), F.col("threshold")).alias("a")).collect()
    assert all(r.a == 0 for r in flags)


def test_interpolation_matches_pandas(spark):
    vals = [None, 1.0, None, None, 4.0, None, 10.0, None, None]
    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(d0 + dt.timedelta(days=i), v) for i, v in enumerate(vals)], "ds date, x double")
    got = series.interpolate_linear(df, ["x"]).orderBy("ds").toPandas()["x"].values
    exp = pd.Series(vals, dtype=float).interpolate().ffill().bfill().values
    np.testing.assert_allclose(got, exp)


def test_seasonal_naive_falls_back_to_train_mean(spark):
    d0 = dt.date(2024, 1, 7)
    ys = [float(i % 5) for i in range(40)]
    ts = spark.createDataFrame([(d0 + dt.timedelta(days=7 * i), y) for i, y in enumerate(ys)], "ds date, y double")
    sp = forecast.holdout_split(ts)
    out = forecast.seasonal_naive(sp, 52).filter("split = 'holdout'").orderBy("ds").toPandas()
    assert np.allclose(out["snaive"].values, np.mean(ys[:32]))  # < 1 season of history (T6)


def test_cutoffs_follow_published_example(spark):
    # span 735 days, horizon 56, period 73, initial 367 → 5 cutoffs
    d0 = dt.date(2023, 1, 1)
    ts = spark.createDataFrame([(d0,), (d0 + dt.timedelta(days=735),)], "ds date")
    cuts = forecast.cutoffs(ts, 56).collect()
    assert len(cuts) == 5


def test_label_leak_check():
    from panelrisk.plans.features import feature_columns

    class Fake:
        columns = ["entity_id", "date", "event_next_30d", "event_next_7d", "temp"]

    assert feature_columns(Fake(), SPEC) == ["temp"]
    for leak in ("EVENT_NEXT_30D", "event_next_7d_mean", "lag_event_next_30d"):
        Fake.columns = ["entity_id", "date", "event_next_30d", "temp", leak]
        with pytest.raises(AssertionError):
            feature_columns(Fake(), SPEC)
    short = replace(SPEC, label="y", other_label="fail")
    Fake.columns = ["entity_id", "date", "y", "fail", "humidity", "entity_type", "days_since_last_failure"]
    assert feature_columns(Fake(), short) == ["humidity", "entity_type", "days_since_last_failure"]
    for leak in ("y_lag", "last-Y", "Fail"):
        Fake.columns = ["entity_id", "date", "y", leak]
        with pytest.raises(AssertionError):
            feature_columns(Fake(), short)


def test_vehicle_files_round_trip_into_43_features(spark, tmp_path):
    """A vehicle-day CSV (';' + decimal comma, optional text columns) → 43 model features."""
    from panelrisk.plans.features import engineer_features, feature_columns
    from panelrisk.sources import csv
    from panelrisk.sources.fixture import fixture_panel
    from panelrisk.spec import VEHICLE_SPEC

    ren = {"entity_id": "vehicle_id", "entity_type": "vehicle_type", "entity_age": "vehicle_age",
           "use_today": "km_today", "use_last_7d": "km_last_7d", "use_last_30d": "km_last_30d",
           "use_since_last_maintenance": "km_since_last_maintenance",
           "days_since_last_event": "days_since_last_failure", "event_next_7d": "failure_next_7d",
           "event_next_30d": "failure_next_30d"}
    p = fixture_panel(spark, "/root/testdata/sf0.001")
    for a, b in ren.items():
        p = p.withColumnRenamed(a, b)
    p = p.select(*[f.name for f in csv.VEHICLE_SCHEMA]).withColumn("mevsim", F.lit("kis")) \
        .withColumn("cevre_temizligi", F.lit("temiz"))
    path = str(tmp_path / "vehicles")
    csv.write_panel_csv(p, path)
    back = csv.read_vehicle_csv(spark, path)
    assert back.count() == p.count()
    feats = engineer_features(back, VEHICLE_SPEC)
    cols = feature_columns(feats, VEHICLE_SPEC)
    assert "mevsim" not in cols and "cevre_temizligi" in cols
    assert len(cols) == 44  # 43 features + the optional text category


def test_positions_with_many_ranges_use_two_level_lookup(spark):
    rng = random.Random(9)
    rows = [(i, 7.0 if rng.random() < 0.33 else float(rng.randint(0, 500)), i % 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "entity_id long, score double, g long")
    got = positions.with_positions(df, "score", by=["g"], tiebreak="entity_id", rows_per_range=20).toPandas()
    for g in (0, 1):
        exp = sorted([r for r in rows if r[2] == g], key=lambda r: (r[1], r[0]))
        exp_pos = {r[0]: i for i, r in enumerate(exp)}
        sub = got[got["g"] == g]
        assert all(exp_pos[e] == p for e, p in zip(sub["entity_id"], sub["pos"]))


def test_positions_of_ids_beyond_double_precision_and_of_strings(spark):
    big = [(2**53 + i, i % 3) for i in (1, 0, 5, 4, 3, 2, 7, 6)] * 2
    got = positions.with_positions(spark.createDataFrame(big, "id long, tb int"), "id", tiebreak="tb").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.pos)] == sorted(i for i, _ in big)
    names = [(f"vehicle-{i:03d}",) for i in range(60)] + [("",), ("é",), ("Z",)]
    got = positions.with_positions(spark.createDataFrame(names, "name string"), "name", n_ranges=4).collect()
    assert [r.name for r in sorted(got, key=lambda r: r.pos)] == sorted((n for n, in names), key=lambda s: s.encode())
    tied = [(i % 2, f"id{(i * 7) % 50:02d}") for i in range(50)]
    got = positions.with_positions(spark.createDataFrame(tied, "k int, name string"), "k", tiebreak="name", n_ranges=4).collect()
    assert [(r.k, r.name) for r in sorted(got, key=lambda r: r.pos)] == sorted(tied)


def test_positions_keep_rows_of_a_null_group(spark):
    rows = [(None, 3.0), (None, 1.0), ("a", 2.0)]
    got = positions.with_positions(spark.createDataFrame(rows, "g string, x double"), "x", by=["g"]).collect()
    assert sorted((r.g or "", r.x, r.pos) for r in got) == [("", 1.0, 0), ("", 3.0, 1), ("a", 2.0, 0)]


def test_groups_of_one_class_do_not_fail(spark):
    rows = [("both", 1, 0.9), ("both", 0, 0.1), ("pos", 1, 0.5), ("pos", 1, 0.4), ("neg", 0, 0.3)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    auc = {r.g: r for r in metrics.auc_ap(df, "y", "s", ["g"]).collect()}
    assert auc["both"].roc_auc == 1.0 and auc["pos"].roc_auc is None and auc["neg"].roc_auc is None
    assert auc["neg"].average_precision == 0.0
    assert {r.fpr for r in metrics.roc_curve(df.filter("g = 'pos'"), "y", "s").collect()} == {None}
    assert {r.recall for r in metrics.pr_curve(df.filter("g = 'neg'"), "y", "s").collect()} == {None}


def test_rule_without_rows_has_no_rate(spark):
    from panelrisk.operators.aggregates import rule_lift

    got = rule_lift(spark.createDataFrame([(1, 1), (2, 0)], "x int, y int"), {"none": F.col("x") > 9, "all": F.col("x") > 0}, "y").collect()
    by = {r.rule: r for r in got}
    assert (by["none"].n, by["none"].rate, by["none"].lift) == (0, None, None) and by["all"].lift == 1.0


def test_undersampling_divides_directly(spark):
    from panelrisk.operators.sampling import undersample_to_ratio

    spec = PanelSpec(entity="e", date="d")
    rows = [(i, dt.date(2024, 1, 1), int(i < 7)) for i in range(300)]
    kept = undersample_to_ratio(spark.createDataFrame(rows, "e long, d date, y int"), spec, "y", 0.07)
    assert {r.y: r["count"] for r in kept.groupBy("y").count().collect()} == {1: 7, 0: int(7 / 0.07)}


def test_whole_numbers_from_decimal_text(spark):
    from panelrisk.sources.csv import whole_number

    good = spark.createDataFrame([("45",), (" -7 ",), ("45,0",), ("",), (None,)], "v string")
    assert [r.n for r in good.select(whole_number(F.col("v"), "v").cast("long").alias("n")).collect()] == [45, -7, 45, None, None]
    with pytest.raises(Exception, match="not a whole number"):
        spark.createDataFrame([("4x",)], "v string").select(whole_number(F.col("v"), "v")).collect()


def test_standardising_scales_codes_too(spark):
    from panelrisk.operators import prep

    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (6.0, "b"), (3.0, "c")], "x double, k string")
    p = prep.fit_preprocessor(df, ["x"], ["k"], standardize=True)
    out = prep.transform(df, p, standardize=True).toPandas()
    assert np.allclose(out.mean(), 0) and np.allclose(out.std(ddof=0), 1)


def test_oversampling_interpolates_between_neighbours(spark):
    from panelrisk.operators.oversampling import smote_minority

    spec = PanelSpec(entity="e", date="d")
    rng = random.Random(1)
    rows = [(i, dt.date(2024, 1, 1), int(i < 40), rng.random() + 5 * (i % 2), float(i % 2), "ab"[i % 2]) for i in range(300)]
    rows.append((999, dt.date(2024, 1, 1), 1, None, 1.0, "a"))
    df = spark.createDataFrame(rows, "e long, d date, y int, x double, z double, k string")
    out = smote_minority(df, spec, "y", ["x", "z"], ["k"], leaf=16).toPandas()
    assert (out.y == 0).sum() == (out.y == 1).sum() == 260
    made = out[out.y == 1].dropna().iloc[40:]
    assert made.x.between(0, 6).all() and set(made.k) == {"a", "b"}
    assert (made[made.z == 1.0].k == "b").mean() > 0.9  # the two clusters stay apart
    assert smote_minority(df, spec, "y", ["x", "z"], ["k"], ratio=0.1).count() == len(rows)
    again = smote_minority(df, spec, "y", ["x", "z"], ["k"], leaf=16).toPandas()
    assert sorted(map(tuple, out.dropna().to_numpy().tolist())) == sorted(map(tuple, again.dropna().to_numpy().tolist()))


def test_ordinal_codes_reach_the_rows(spark):
    """Train's dictionary, and all rows of both splits encoded with it: NULL as the mode, an unseen category -1."""
    import datetime as dt

    from panelrisk.queries.q_models import encoded_rows

    day = dt.date(2020, 1, 1)
    made = [(1, "train", "b", 10), (2, "train", "a", 9), (3, "train", "b", 10), (4, "test", None, 9), (5, "test", "new", 11)]
    f = spark.createDataFrame([(e, day, s, k, w) for e, s, k, w in made], "entity_id long, date date, split string, kind string, code_no int")
    got = {(r.part, r.entity_id, r.feature, r.value, r.code) for r in encoded_rows(f, ["kind", "code_no"]).collect()}
    codes = {"a": 0, "b": 1, "9": 0, "10": 1}
    want = {("dictionary", -1, "kind" if v.isalpha() else "code_no", v, c) for v, c in codes.items()}
    for e, s, k, w in made:
        want |= {(s, e, "kind", k or "b", codes.get(k or "b", -1)), (s, e, "code_no", str(w), codes.get(str(w), -1))}
    assert got == want
