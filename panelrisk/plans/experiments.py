"""Experiment matrix: datasets × models → one long metric table.

All (dataset, model) groups are evaluated in the same jobs: every metric
operator takes the group columns as ``by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import fits, metrics, thresholds
from panelrisk.session import cut_lineage


def experiment_table(long: DataFrame, label: str, score: str = "score", by=("dataset", "model"),
                     split: str = "split") -> DataFrame:
    """roc_auc, pr_auc, base_rate, prec/rec/lift at top 10 %, train precision at recall .80.

    ``long`` has one row per (group…, row) with ``split`` train/test.
    ``train_prec_at_recall80`` is measured on train (as published).
    """
    by = list(by)
    long = cut_lineage(long.select(*by, split, label, score))  # read by five metric jobs
    test = long.filter(F.col(split) == "test")
    train = long.filter(F.col(split) == "train")
    ra = metrics.auc_ap(test, label, score, by).withColumnRenamed("average_precision", "pr_auc")
    tk = metrics.at_top_rates(test, label, score, [0.10], by).select(
        *by, F.col("precision").alias("prec_top10"), F.col("recall").alias("rec_top10"))
    base = test.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("base_rate"))
    gr = thresholds.recall_threshold(thresholds.grid_table(train, label, score, by), 0.80, by).select(
        *by, F.col("precision").alias("train_prec_at_recall80"))
    out = ra.join(tk, by).join(base, by).join(gr, by, "left")
    return out.withColumn("lift_top10", F.try_divide("prec_top10", "base_rate"))


def scored_long(panel: DataFrame, spec, model_names=("gbt", "logreg"), specs: dict[str, fits.FitSpec] | None = None,
                datasets=None, honest: bool = False, fit_rows: int | None = None) -> DataFrame:
    """Every model on every dataset variant: long (dataset, model, split, label, score) table.

    The tree models of all datasets are fitted side by side over one binned
    table, on all its train rows unless ``fit_rows`` asks for a sample, and score
    it together (``operators.fits``); logistic regression is
    MLlib's. ``ensemble`` is the soft vote of ``models.ENSEMBLE``. With
    ``honest``, models and preprocessing learn from the first three quarters of
    train only, and the last quarter comes back as split ``validation``.
    """
    from concurrent.futures import ThreadPoolExecutor

    from panelrisk.operators import models, splits
    from panelrisk.plans.features import feature_columns, split_feature_kinds
    from panelrisk.plans.train import feature_frame
    from panelrisk.sources.variants import VARIANTS, dataset_variants

    variants = dataset_variants(panel, spec)
    specs = {**fits.SPECS, **(specs or {})}
    names = list(dict.fromkeys([m for n in model_names for m in (models.ENSEMBLE if n == "ensemble" else (n,))]))
    rows = [spec.entity, spec.date]
    keep = [*rows, "split", "label"]

    def prepare(ds: str) -> tuple[DataFrame | None, DataFrame | None]:
        feat = feature_frame(variants.filter(F.col("dataset") == ds).drop("dataset"), spec)
        num, cat = split_feature_kinds([c for c in feature_columns(feat, spec) if c not in ("split", "label")], spec)
        if honest:
            train = splits.validation_tail(feat.filter("split = 'train'"), spec).withColumn("split", F.when(F.col("role") == "fit", "train").otherwise("validation"))
            feat = cut_lineage(train.drop("role", "pos").unionByName(feat.filter("split = 'test'")))
        part = F.when(F.col("split") == "train", 0).otherwise(1)
        feat = feat.withColumn("dataset", F.lit(ds)).withColumn("part", part)
        own = linear = None
        if any(n in specs for n in names):
            own = cut_lineage(fits.bin_rows(feat, num, cat, ["dataset", "part", *keep], "split = 'train'"))
        if "logreg" in names:
            linear = _logreg_scores(feat, num, cat, keep).select(F.lit(ds).alias("dataset"), F.lit("logreg").alias("model"), *keep, "score")
        return own, linear

    # the datasets are independent: their jobs are submitted side by side
    with ThreadPoolExecutor(max_workers=4) as pool:
        prepared = list(pool.map(prepare, datasets or VARIANTS))
    linear = [x for _, x in prepared if x is not None]
    binned = None
    for own, _ in prepared:
        binned = own if binned is None or own is None else binned.unionAll(own)
    parts = linear
    if binned is not None:
        asked = [fits.Fit(ds, n, specs[n]) for ds in datasets or VARIANTS for n in names if n in specs]
        scored = fits.score_many(binned, fits.fit_many(binned.filter("part = 0"), asked, rows, fit_rows), keep)
        if "ensemble" in model_names:
            members = scored.filter(F.col("model").isin(*models.ENSEMBLE))
            vote = members.groupBy("dataset", *keep).agg((F.sum("score") / len(models.ENSEMBLE)).alias("score"))
            scored = scored.unionByName(vote.withColumn("model", F.lit("ensemble")))
        parts = [scored, *linear]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("model").isin(*model_names)).select("dataset", "model", "split", "label", "score")


def _logreg_scores(feat: DataFrame, num: list[str], cat: list[str], keep: list[str]) -> DataFrame:
    from panelrisk.operators import models, prep

    train = feat.filter("split = 'train'")
    p = prep.fit_preprocessor(train, num, cat, standardize=True)
    matrix = lambda d: prep.assemble(prep.transform(d, p, keep, standardize=True), p)
    m = models.fit("logreg", cut_lineage(matrix(train).select("label", "features")))
    return cut_lineage(models.score(m, matrix(feat)).select(*keep, "score"))


def honest_table(long: DataFrame, label: str = "label", score: str = "score", target_precision: float = 0.60,
                 by=("dataset", "model")) -> DataFrame:
    """Per group: the threshold chosen on the validation rows, and what it gives on test (J06 for fitted models).

    Without a threshold that reaches the target, threshold and test figures are NULL.
    """
    by = list(by)
    grid = thresholds.grid_table(long.filter("split = 'validation'"), label, score, by)
    chosen = thresholds.precision_threshold(grid, target_precision, by).select(
        *by, F.col("threshold").alias("honest_threshold"), F.col("precision").alias("validation_precision"))
    test = long.filter("split = 'test'").join(F.broadcast(chosen), by)  # one row per group
    hit = F.col(score) >= F.col("honest_threshold")
    s = lambda c: F.sum(F.when(c, 1).otherwise(0))
    found = test.groupBy(*by).agg(
        F.try_divide(s(hit & (F.col(label) == 1)), s(hit)).alias("honest_precision"),
        F.try_divide(s(hit & (F.col(label) == 1)), s(F.col(label) == 1)).alias("honest_recall"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("honest_alarm_rate"))
    return long.select(*by).distinct().join(chosen, by, "left").join(found, by, "left")


def target_table(long: DataFrame, label: str = "label", score: str = "score", target_precision: float = 0.60,
                 by=("dataset", "model")) -> DataFrame:
    """Per (dataset, model) on test: oracle ceiling (best recall at precision >= target, max precision),
    precision at the top 1/2/3/5 %, and the honest threshold where ``long`` has validation rows (L05)."""
    by = list(by)
    long = cut_lineage(long)
    test = long.filter("split = 'test'")
    ceiling = metrics.max_recall_at_precision(test, label, score, [target_precision], by).drop("target")
    tops = metrics.at_top_rates(test, label, score, [0.01, 0.02, 0.03, 0.05], by)
    wide = tops.groupBy(*by).pivot("rate", [0.01, 0.02, 0.03, 0.05]).agg(F.first("precision"))
    wide = wide.toDF(*by, "prec_top1", "prec_top2", "prec_top3", "prec_top5")
    return ceiling.join(wide, by).join(honest_table(long, label, score, target_precision, by), by)


def weekly_series(panel: DataFrame, spec, datasets=None) -> DataFrame:
    """The weekly event counts of every dataset variant: (dataset, ds, y)."""
    from panelrisk.operators import forecast as fc
    from panelrisk.sources.variants import VARIANTS, dataset_variants

    variants = dataset_variants(panel, spec)
    out = None
    for ds in datasets or VARIANTS:
        own = variants.filter(F.col("dataset") == ds).drop("dataset")
        one = fc.build_timeseries(own, spec, "W", False).select(F.lit(ds).alias("dataset"), "ds", "y")
        out = one if out is None else out.unionByName(one)
    return out


def experiment_matrix(panel: DataFrame, spec, model_names=("gbt", "logreg"), datasets=None, **fit) -> dict[str, DataFrame]:
    """Both halves of the experiments over all dataset variants (N06): ``classification`` (one row per dataset and
    model), ``best`` (the model of the largest pr_auc per dataset; ties: first name) and ``forecast``."""
    from panelrisk.plans.forecast import forecast_matrix

    table = cut_lineage(experiment_table(scored_long(panel, spec, model_names, datasets=datasets, **fit), "label"))
    best = table.filter(F.col("pr_auc").isNotNull()).groupBy("dataset").agg(
        F.min_by(F.struct(*[c for c in table.columns if c != "dataset"]), F.struct(-F.col("pr_auc"), "model")).alias("b"))
    return {"classification": table, "best": best.select("dataset", "b.*"),
            "forecast": forecast_matrix(weekly_series(panel, spec, datasets))}
