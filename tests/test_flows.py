"""Raw lines, decimals, stored models and the restartable stream."""

import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelrisk.operators import artifact
from panelrisk.sources import csv
from panelrisk.spec import FIXTURE_SPEC as S
from panelrisk.streaming import score as stream


def test_raw_lines_keep_their_order_over_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    header = "id;x"
    files = {"part-0": 5000, "part-1": 3, "part-2": 40000, "part-3": 0}
    want, n = [], 0
    for name, rows in files.items():
        lines = [f"{name}-{i};{'y' * (i % 7)}" for i in range(rows)]
        if rows > 2:
            lines[1], lines[2] = header, ""  # a data line that looks like the header stays
        want += [x for x in lines if x]
        (folder / name).write_text("﻿" * (name == "part-0") + "\n".join([header, *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        got_header, body = csv.read_raw_lines(spark, str(folder))
        assert got_header == header
        assert [r.line for r in body.orderBy("line_no").collect()] == want
        csv.write_raw_lines(got_header, body, str(tmp_path / "copy"))
        again, back = csv.read_raw_lines(spark, str(tmp_path / "copy"))
        assert again == header and [r.line for r in back.orderBy("line_no").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_unreadable_decimals_stop_the_read(spark):
    good = [("12,5", 12.5), ("0;8", 0.8), (" -3 ", -3.0), ("1e-3", 0.001), ("", None), (None, None), ("NaN", None), (",5", 0.5)]
    got = spark.createDataFrame(good, "t string, want double").select(csv.decimal_text(F.col("t"), "t").alias("v"), "want").collect()
    assert all(r.v == r.want for r in got)
    for bad in ("abc", "1.234,5", "--1", "1,2,3"):
        with pytest.raises(PySparkException, match="not a decimal number"):
            spark.createDataFrame([(bad,)], "t string").select(csv.decimal_text(F.col("t"), "t")).collect()


def test_stored_model_scores_new_rows_alike(spark, tmp_path):
    rows = [(i, float(i % 17) if i % 11 else None, "abc"[i % 3] if i % 13 else None, float(i % 17 > 8)) for i in range(300)]
    feat = spark.createDataFrame(rows, "id long, x double, c string, label double")
    for name, over in (("gbt", dict(maxIter=3)), ("logreg", {}), ("random_forest", dict(numTrees=3, maxDepth=3))):
        fitted = artifact.refit(feat, ["x"], ["c"], name, over)
        fitted.save(str(tmp_path / name), spark)
        new = spark.createDataFrame([(1, 3.0, "a"), (2, None, None), (3, 16.0, "never seen"), (4, float("nan"), "c")], "id long, x double, c string")
        back = artifact.load(spark.newSession(), str(tmp_path / name))
        want = {r.id: r.score for r in fitted.score(new, ["id"]).collect()}
        assert {r.id: r.score for r in back.score(new, ["id"]).collect()} == want and len(want) == 4
        with pytest.raises(ValueError, match="missing"):
            back.score(new.drop("c"), ["id"])
        with pytest.raises(ValueError, match="another kind"):
            back.score(new.withColumn("x", F.col("x").cast("string")), ["id"])
    p = fitted.preprocessor
    assert {(r.value, r.code) for r in p.dictionary.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def panel(spark, days, entities=3):
    rows = [(e, dt.date(2020, 1, 1) + dt.timedelta(d), (7 * d + e) % 40, d % (5 + e)) for d in days for e in range(entities)]
    return spark.createDataFrame(rows, "entity_id long, date date, use_today long, days_since_last_event int")


class Stop(Exception):
    pass


@pytest.mark.parametrize("stop_at", [0, 2])
def test_stream_that_is_stopped_and_started_again(spark, tmp_path, stop_at):
    history, months = panel(spark, range(40)), [range(40, 50), range(50, 51), range(51, 70), range(70, 75)]
    scorer = lambda d: d.withColumn("score", F.col("past_event_rate") * 2)
    batch = stream.features_for_batch(panel(spark, range(40, 75)), *stream.initial_state(history, S), S)
    want = sorted(map(tuple, scorer(batch).collect()))
    incoming = str(tmp_path / "in")
    for i, days in enumerate(months):
        extra = panel(spark, [60], 1) if i == 3 else panel(spark, [])  # a row that comes too late
        panel(spark, days).unionByName(extra).coalesce(1).write.mode("append").parquet(incoming)
        newest = max((os.path.join(incoming, f) for f in os.listdir(incoming) if f.endswith(".parquet")), key=lambda f: os.stat(f).st_mtime_ns)
        os.utime(newest, (1e9 + i, 1e9 + i))

    def stop(batch_id):
        if batch_id == stop_at:
            raise Stop("killed before the batch was committed")

    base = str(tmp_path / "base")
    run = lambda **k: stream.stream_features(spark, history, incoming, history.schema, S, base, scorer, **k)
    with pytest.raises(Exception, match="killed"):
        run(after_batch=stop)
    for _ in range(2):  # the second time there is nothing new
        out, late = run()
        assert sorted(map(tuple, out.select(*batch.columns, "score").collect())) == want
        assert [(r.entity_id, r.date) for r in late.collect()] == [(0, dt.date(2020, 3, 1))]
    assert sorted(os.listdir(f"{base}/state/tail")) == [f"v={i}" for i in (1, 2, 3)]


def test_permutation_importance_swaps_one_feature_at_a_time(spark):
    """Against the same re-pairing made by hand, feature by feature."""
    from panelrisk.operators import metrics, models, prep
    from panelrisk.plans.importance import permutation_importance

    rows = [(i, float(i % 17), float((i * 7) % 11), "ab"[i % 2], float(i % 17 > 8)) for i in range(200)]
    feat = spark.createDataFrame(rows, "id long, x double, z double, c string, label double")
    p = prep.fit_preprocessor(feat, ["x", "z"], ["c"])
    m = models.fit("gbt", prep.assemble(prep.transform(feat, p, ["label"]), p), dict(maxIter=2, maxDepth=2))
    got = {r.feature: r.ap_drop for r in permutation_importance(m, p, feat, "label", ["id"]).collect()}
    keyed = feat.withColumn("o", F.xxhash64("id")).withColumn("h", F.xxhash64("id", F.lit(42))).toPandas()
    by_key, by_hash = keyed.sort_values("o"), keyed.sort_values("h")

    def ap(frame):
        d = spark.createDataFrame(frame[["id", "x", "z", "c", "label"]])
        return metrics.auc_ap(models.score(m, prep.assemble(prep.transform(d, p, ["label"]), p)), "label", "score").first().average_precision

    for c in ("x", "z", "c"):
        swapped = by_key.copy()
        swapped[c] = by_hash[c].to_numpy()
        assert abs(got[c] - (ap(by_key) - ap(swapped))) < 1e-9
    assert got["x"] > 0.1 > abs(got["z"]) + abs(got["c"])


def test_confusion_cells_and_operating_points(spark):
    from panelrisk.plans.reports import confusion_cells, operating_point_report

    rows = [("test", 1, 1), ("test", 1, 0), ("test", 0, 0), ("test", 0, 0), ("train", 0, 1)]
    cells = {(r.split, r.predicted, r.actual): r.n for r in confusion_cells(spark.createDataFrame(rows, "split string, y int, alarm int"), "y", "alarm").collect()}
    assert cells == {("test", 1, 1): 1, ("test", 1, 0): 0, ("test", 0, 1): 1, ("test", 0, 0): 2, ("train", 1, 1): 0, ("train", 1, 0): 1, ("train", 0, 1): 0, ("train", 0, 0): 0}
    long = [("d", "m", s, float(i % 3 == 0), i / 50 + (s == "train")) for s in ("train", "validation", "test") for i in range(50)]
    out = operating_point_report(spark.createDataFrame(long, "dataset string, model string, split string, label double, score double"), target_precision=0.3).collect()
    n = {s: sum(r.section == s for r in out) for s in ("top", "honest", "curve")}
    assert n == {"top": 4, "honest": 1, "curve": 50} and all(r.threshold < 1.0 for r in out if r.threshold is not None)


def test_whole_training_flow(spark):
    from panelrisk.operators.trees import FitSpec
    from panelrisk.plans.train import train_full
    from panelrisk.sources.fixture import fixture_panel

    sf = "/root/testdata/sf0.001"
    panel = fixture_panel(spark, sf).cache()
    end = dt.date(2001, 6, 1)
    out = train_full(panel, S, FitSpec(trees=6, leaves=6), test_end=end, test_neg_keep=0.5, smote_ratio=0.6, undersample_ratio=0.75, early_stop=True, threshold_mode="precision", precision_target=0.4)
    assert 1 <= out["settings"].trees <= 6
    report = {(r.split, r.row): r.support for r in out["report"].collect()}
    plain = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    cut = plain.lo + dt.timedelta(days=int(0.8 * (plain.hi - plain.lo).days))
    rows = panel.select("date", F.col(S.label).alias("y")).collect()
    train, test = [r.y for r in rows if r.date <= cut], [r.y for r in rows if cut < r.date <= end]
    pos, neg = sum(train), len(train) - sum(train)
    made = int(neg * 0.6)
    supports = lambda split: sorted(v for (s, k), v in report.items() if s == split)
    assert made in supports("train") and int(made / 0.75) in supports("train") and pos < made  # both classes as asked for
    assert sum(test) in supports("test") and round((len(test) - sum(test)) * 0.5) in supports("test")
    latest = out["latest"].collect()
    assert sorted(r.risk_rank for r in latest) == list(range(1, panel.select("entity_id").distinct().count() + 1))
    with pytest.raises(ValueError, match="larger"):
        train_full(panel, S, smote_ratio=0.8, undersample_ratio=0.5)
