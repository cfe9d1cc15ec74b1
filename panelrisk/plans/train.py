"""Threshold modes and the training/report flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import thresholds


def choose_threshold(train_scored: DataFrame, label: str, score: str, mode: str, alarm_rate: float = 0.10,
                     recall_target: float = 0.80, precision_target: float = 0.60) -> DataFrame:
    """One-row DataFrame ``threshold`` chosen on train scores.

    * ``alarm``: quantile(score, 1 - alarm_rate)
    * ``fixed``: highest grid threshold with train recall >= recall_target
      (NULL when none → no alarms)
    * ``precision``: lowest grid threshold with train precision >= target,
      falling back to the top 10 % of train scores, whatever ``alarm_rate`` is
    """
    if mode == "alarm":
        return thresholds.alarm_rate_threshold(train_scored, score, alarm_rate)
    grid = thresholds.grid_table(train_scored, label, score)
    if mode == "fixed":
        return thresholds.recall_threshold(grid, recall_target).select("threshold")
    if mode == "precision":
        top = thresholds.alarm_rate_threshold(train_scored, score, 0.10)
        p = thresholds.precision_threshold(grid, precision_target).select(F.col("threshold").alias("_p"))
        return p.crossJoin(top).select(F.coalesce("_p", "threshold").alias("threshold"))
    raise ValueError(f"unknown threshold mode {mode!r}")


from dataclasses import replace  # noqa: E402

from panelrisk.operators import fits, metrics, models, prep, sampling, splits  # noqa: E402
from panelrisk.operators.oversampling import smote_minority  # noqa: E402
from panelrisk.plans.features import derive_features, feature_columns, split_feature_kinds  # noqa: E402
from panelrisk.plans.score import score_latest  # noqa: E402
from panelrisk.session import cut_lineage  # noqa: E402
from panelrisk.spec import PanelSpec  # noqa: E402


def feature_frame(panel: DataFrame, spec: PanelSpec, train_frac: float = 0.8, test_end=None) -> DataFrame:
    """Feature table with the calendar ``split`` and a double ``label`` (written once, read by every fit)."""
    panel = cut_lineage(panel)
    f = derive_features(panel, spec)  # as many rows as the panel, so the panel's dates give the span
    f = splits.calendar_split(f, spec, train_frac, test_end, span_of=panel)
    f = f.filter(F.col("split").isNotNull()).withColumn("label", F.col(spec.label).cast("double"))
    return cut_lineage(f)


def prepare_matrices(feat: DataFrame, spec: PanelSpec, standardize: bool = False, keep=()):
    """Fit the preprocessor on train; return (preprocessor, assembled train, assembled test)."""
    cols = [c for c in feature_columns(feat, spec) if c not in ("split", "label")]
    num, cat = split_feature_kinds(cols, spec)
    train = feat.filter("split = 'train'")
    p = prep.fit_preprocessor(train, num, cat, standardize=standardize)
    keys = [spec.entity, spec.date, "split", "label", *keep]

    def mat(df):
        return prep.assemble(prep.transform(df, p, keys, standardize=standardize), p).select(*keys, "features")

    return p, cut_lineage(mat(train)), cut_lineage(mat(feat.filter("split = 'test'")))


def train_and_report(panel: DataFrame, spec: PanelSpec, model: str = "gbt", overrides: dict | None = None,
                     threshold_mode: str = "alarm", alarm_rate: float = 0.10, recall_target: float = 0.80,
                     precision_target: float = 0.60):
    """Main flow (N02): features → split → preprocess → fit → scores → threshold → reports.

    Returns a dict of DataFrames: ``scores`` (both splits), ``threshold``,
    ``metrics`` (AUC/AP per split), ``report`` (classification report per
    split), ``tradeoff`` (precision at recall targets).
    """
    feat = feature_frame(panel, spec)
    p, tr, te = prepare_matrices(feat, spec, standardize=(model == "logreg"))
    m = models.fit(model, tr, overrides)
    scored = cut_lineage(models.score(m, tr).unionByName(models.score(m, te)).drop("features"))
    th = choose_threshold(scored.filter("split = 'train'"), "label", "score", threshold_mode, alarm_rate,
                          recall_target, precision_target)
    flagged = scored.crossJoin(F.broadcast(th)).withColumn(
        "alarm", F.coalesce((F.col("score") >= F.col("threshold")), F.lit(False)).cast("int"))
    if threshold_mode == "alarm":  # per-split quantile, as in the original alarm mode
        per = thresholds.alarm_rate_threshold(scored, "score", alarm_rate, ["split"])
        flagged = scored.join(F.broadcast(per), "split").withColumn(
            "alarm", (F.col("score") >= F.col("threshold")).cast("int"))
    return {
        "model": m,
        "preprocessor": p,
        "scores": scored,
        "threshold": th,
        "metrics": metrics.auc_ap(scored, "label", "score", ["split"]),
        "report": metrics.classification_report(flagged, "label", "alarm", ["split"]),
        "tradeoff": thresholds.recall_tradeoff(thresholds.grid_table(scored, "label", "score", ["split"]),
                                               [0.9, 0.8, 0.7, 0.6, 0.5], ["split"]),
    }


def train_full(panel: DataFrame, spec: PanelSpec, settings: fits.FitSpec | None = None, test_end=None, test_neg_keep: float = 1.0,
               smote_ratio: float | None = None, undersample_ratio: float | None = None, trials: int = 0, early_stop: bool = False,
               threshold_mode: str = "alarm", alarm_rate: float = 0.10, recall_target: float = 0.80, precision_target: float = 0.60,
               fit_rows: int | None = None) -> dict:
    """The whole training flow (N02): calendar split with an optional end of test, thinned test negatives,
    over- and undersampling of train, search, early stopping, thresholds and reports, refit on all rows, latest scoring.

    Only train is resampled, on imputed and coded features; undersampling without
    oversampling is left out, and its ratio must be the larger one. The search
    runs on the train rows as they came. Early stopping picks the number of trees
    on the last quarter of train (AUC, 50 trees of patience), never on test. The
    refit learns from every row with that number. Returns DataFrames ``metrics``,
    ``report``, ``tradeoff``, ``threshold`` and ``latest``, and ``settings``.
    """
    if smote_ratio is not None and undersample_ratio is not None and undersample_ratio <= smote_ratio:
        raise ValueError(f"undersample ratio {undersample_ratio} must be larger than the oversampling ratio {smote_ratio}")
    settings = settings or fits.SPECS["gbt"]
    keys = [spec.entity, spec.date]
    feat = feature_frame(panel, spec, test_end=test_end)
    num, cat = split_feature_kinds([c for c in feature_columns(feat, spec) if c not in ("split", "label")], spec)
    train = feat.filter("split = 'train'")
    if trials:
        from panelrisk.plans.cv import search_space, tune_expanding

        best = tune_expanding(train, spec, trials).orderBy(F.desc_nulls_last("mean_ap"), "trial").first()  # one row per trial
        settings = search_space(trials)[best.trial]

    p = prep.fit_preprocessor(train, num, cat)
    numbers, codes = [f"num__{c}" for c in num], [f"cat__{c}" for c in cat]
    ready = lambda d: prep.transform(d, p, [*keys, "split", "label"])
    learn, test = cut_lineage(ready(train)), ready(feat.filter("split = 'test'"))
    if test_neg_keep < 1:
        test = sampling.thin_negatives(test, spec, "label", test_neg_keep)
    if smote_ratio is not None:
        learn = smote_minority(learn, spec, "label", numbers, codes, smote_ratio)
        if undersample_ratio is not None:
            learn = sampling.undersample_to_ratio(learn, spec, "label", undersample_ratio)

    def fitted(rows: DataFrame, learned: str, chosen: fits.FitSpec) -> tuple[DataFrame, DataFrame]:
        """(binned rows, models) of a fit on the rows ``learned``."""
        rows = rows.withColumn("dataset", F.lit("train")).withColumn("part", F.when(F.expr(learned), 0).otherwise(1))
        b = cut_lineage(fits.bin_rows(rows, numbers, codes, ["dataset", "part", *keys, "split", "label"], "part = 0"))
        return b, fits.fit_many(b.filter("part = 0"), [fits.Fit("train", "model", chosen)], keys, fit_rows)

    if early_stop:
        tail = splits.validation_tail(learn, spec).drop("pos")
        b, m = fitted(tail.withColumn("split", F.col("role")), "role = 'fit'", settings)
        trees, _ = fits.best_prefix(cut_lineage(fits.staged_auc(b.filter("part = 1"), bytes(m.first().model))))
        settings = replace(settings, trees=max(1, trees))
    b, m = fitted(cut_lineage(learn.unionByName(test)), "split = 'train'", settings)
    scored = cut_lineage(fits.score_many(b, m, [*keys, "split", "label"]).drop("dataset", "model"))

    th = choose_threshold(scored.filter("split = 'train'"), "label", "score", threshold_mode, alarm_rate, recall_target, precision_target)
    if threshold_mode == "alarm":  # every split its own quantile
        th = thresholds.alarm_rate_threshold(scored, "score", alarm_rate, ["split"])
        flagged = scored.join(F.broadcast(th), "split")  # two rows
    else:
        flagged = scored.crossJoin(F.broadcast(th))
    flagged = flagged.withColumn("alarm", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).cast("int"))
    every, again = fitted(cut_lineage(ready(feat)), "true", settings)
    names = feat.select(*keys, spec.entity_type)
    scorer = lambda d: fits.score_many(d, again, keys).join(names, keys)
    return {
        "settings": settings,
        "threshold": th,
        "metrics": metrics.auc_ap(scored, "label", "score", ["split"]),
        "report": metrics.classification_report(flagged, "label", "alarm", ["split"]),
        "tradeoff": thresholds.recall_tradeoff(thresholds.grid_table(scored, "label", "score", ["split"]), [0.9, 0.8, 0.7, 0.6, 0.5], ["split"]),
        "latest": score_latest(every, spec, scorer, alarm_rate),
    }
