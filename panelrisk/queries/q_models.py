"""Preprocessing (exact) and model queries (rows-only) on the fixture feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import models, prep
from panelrisk.plans.features import engineer_features, feature_columns, split_feature_kinds
from panelrisk.plans.train import feature_frame, prepare_matrices
from panelrisk.queries import register
from panelrisk.queries.common import typed, typed_sql
from panelrisk.queries.q_features import DERIVED, IDS, RAW
from panelrisk.queries.sql_features import FEATURES_SQL
from panelrisk.session import cut_lineage
from panelrisk.sources.fixture import fixture_panel
from panelrisk.spec import FIXTURE_SPEC as S

DN = "CAST(date - DATE '1970-01-01' AS DOUBLE)"
KINDS = dict(RAW + DERIVED)
FEATS = [n for n, _ in RAW + DERIVED]
NUM = [c for c in FEATS if c not in S.categorical]
CAT = [c for c in FEATS if c in S.categorical]
FSPLIT_SQL = f"""{FEATURES_SQL},
fb AS (SELECT MIN({DN}) AS d0, MAX({DN}) AS d1 FROM feat),
fs AS (SELECT feat.*, CASE WHEN {DN} - d0 <= 0.8 * (d1 - d0) THEN 'train' ELSE 'test' END AS split FROM feat, fb),
ftr AS (SELECT * FROM fs WHERE split = 'train'),
med AS (SELECT feature, quantile_cont(value, 0.5) AS median FROM
        (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUM)} FROM ftr)
         ON {', '.join(NUM)} INTO NAME feature VALUE value) GROUP BY feature),
cc AS (SELECT feature, value, TRY_CAST(value AS DOUBLE) AS num, COUNT(*) AS n FROM
        (UNPIVOT (SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in CAT)} FROM ftr)
         ON {', '.join(CAT)} INTO NAME feature VALUE value) GROUP BY feature, value),
mo AS (SELECT feature, value AS mode FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY n DESC,
         num ASC NULLS LAST, value) AS r FROM cc) WHERE r = 1),
dc AS (SELECT feature, value, DENSE_RANK() OVER (PARTITION BY feature ORDER BY num ASC NULLS LAST, value) - 1 AS code FROM cc)"""


def feat_split(spark, sf):
    return feature_frame(fixture_panel(spark, sf), S)


@register("impute_median", f"WITH {FSPLIT_SQL}\nSELECT feature, ROUND(median, 6) + 0.0 AS median FROM med")
def q_impute_median(spark, sf):
    tr = feat_split(spark, sf).filter("split = 'train'")
    return typed(prep.numeric_medians(tr, NUM), [("feature", "s"), ("median", "d")])


@register("impute_mode", f"WITH {FSPLIT_SQL}\nSELECT feature, mode FROM mo")
def q_impute_mode(spark, sf):
    tr = feat_split(spark, sf).filter("split = 'train'")
    return prep.category_modes(tr, CAT)


def _encode_sql():
    known = ", ".join(f"COALESCE(CAST({c} AS VARCHAR), (SELECT mode FROM mo WHERE feature = '{c}')) AS {c}" for c in CAT)
    return f"""WITH {FSPLIT_SQL}
SELECT 'dictionary' AS part, CAST(-1 AS BIGINT) AS entity_id, DATE '1970-01-01' AS date, feature, value, CAST(code AS INTEGER) AS code FROM dc
UNION ALL
SELECT u.split, CAST(u.entity_id AS BIGINT), u.date, u.feature, u.value, CAST(COALESCE(dc.code, -1) AS INTEGER)
FROM (UNPIVOT (SELECT split, entity_id, date, {known} FROM fs) ON {', '.join(CAT)} INTO NAME feature VALUE value) u
LEFT JOIN dc ON dc.feature = u.feature AND dc.value = u.value"""


@register("ordinal_encode", _encode_sql())
def q_ordinal_encode(spark, sf):
    """The dictionary of train, and every row's categories as their codes in it (unseen: -1)."""
    return encoded_rows(feat_split(spark, sf), CAT)


def encoded_rows(f, cats):
    cols = [("part", "s"), ("entity_id", "l"), ("date", "t"), ("feature", "s"), ("value", "s"), ("code", "i")]
    p = prep.fit_preprocessor(f.filter("split = 'train'"), [], cats)
    learned = p.dictionary.select(F.lit("dictionary").alias("part"), F.lit(-1).alias("entity_id"), F.lit("1970-01-01").alias("date"), "feature", "value", "code")
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(p.modes.get(c))).alias("value"), F.col(f"cat__{c}").alias("code")) for c in cats])
    rows = prep.encode(f, p).select(F.col("split").alias("part"), "entity_id", "date", F.inline(each)).filter("value IS NOT NULL")
    return typed(learned, cols).unionByName(typed(rows, cols))


def _transform_sql():
    parts = ["entity_id", "date"]
    for c in NUM:
        parts.append(f"ROUND(COALESCE(CAST({c} AS DOUBLE), (SELECT median FROM med WHERE feature = '{c}')), 6) + 0.0 AS num__{c}")
    for c in CAT:
        parts.append(f"CAST(COALESCE((SELECT code FROM dc WHERE feature = '{c}' AND dc.value = COALESCE(CAST(fs.{c} AS VARCHAR), "
                     f"(SELECT mode FROM mo WHERE feature = '{c}'))), -1) AS DOUBLE) AS cat__{c}")
    return f"WITH {FSPLIT_SQL}\nSELECT {', '.join(parts)} FROM fs WHERE split = 'test'"


@register("column_transform", _transform_sql())
def q_column_transform(spark, sf):
    f = feat_split(spark, sf)
    p = prep.fit_preprocessor(f.filter("split = 'train'"), NUM, CAT)
    out = prep.transform(f.filter("split = 'test'"), p, ["entity_id", "date"])
    return typed(out, IDS + [(c, "d") for c in p.output_columns])


STD = ["use_today", "temp", "use_roll30_std"]


@register("standardize", f"""WITH {FSPLIT_SQL},
imp AS (SELECT split, entity_id, date, {', '.join(f"COALESCE(CAST({c} AS DOUBLE), (SELECT median FROM med WHERE feature = '{c}')) AS {c}" for c in STD)} FROM fs),
ms AS (SELECT {', '.join(f'AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}' for c in STD)} FROM imp WHERE split = 'train')
SELECT entity_id, date, {', '.join(f'ROUND(({c} - m_{c}) / s_{c}, 6) + 0.0 AS num__{c}' for c in STD)} FROM imp, ms WHERE split = 'test'""")
def q_standardize(spark, sf):
    f = feat_split(spark, sf)
    tr = f.filter("split = 'train'")
    p = prep.Preprocessor(STD, [])
    p.medians = {r.feature: r.median for r in prep.numeric_medians(tr, STD).collect()}
    imp = prep.transform(tr, p)
    row = imp.agg(*[x for c in STD for x in (F.avg(f"num__{c}").alias(f"m_{c}"), F.stddev_pop(f"num__{c}").alias(f"s_{c}"))]).collect()[0]
    p.means = {c: row[f"m_{c}"] for c in STD}
    p.stds = {c: row[f"s_{c}"] for c in STD}
    out = prep.transform(f.filter("split = 'test'"), p, ["entity_id", "date"], standardize=True)
    return typed(out, IDS + [(f"num__{c}", "d") for c in STD])


@register("class_weight", f"""WITH {FSPLIT_SQL},
cw AS (SELECT SUM(CASE WHEN event_next_30d = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN event_next_30d = 1 THEN 0 ELSE 1 END) AS neg FROM ftr)
SELECT 'scale_pos' AS scheme, 1 AS label, ROUND(CAST(neg AS DOUBLE) / GREATEST(pos, 1), 6) AS weight FROM cw
UNION ALL SELECT 'scale_pos', 0, 1.0 FROM cw
UNION ALL SELECT 'balanced', 1, ROUND(CAST(pos + neg AS DOUBLE) / (2 * pos), 6) FROM cw
UNION ALL SELECT 'balanced', 0, ROUND(CAST(pos + neg AS DOUBLE) / (2 * neg), 6) FROM cw""")
def q_class_weight(spark, sf):
    tr = feat_split(spark, sf).filter("split = 'train'")
    outs = []
    for scheme in ("scale_pos", "balanced"):
        w = models.with_class_weight(tr, "label", scheme).groupBy(F.col("label").cast("int").alias("label")).agg(
            F.first("weight").alias("weight")).withColumn("scheme", F.lit(scheme))
        outs.append(w)
    return typed(outs[0].unionByName(outs[1]), [("scheme", "s"), ("label", "i"), ("weight", "d")])


# Registered fits use all train rows and the full schedules of models.CONFIGS.


def matrices(spark, sf, standardize=False):
    return prepare_matrices(feat_split(spark, sf), S, standardize=standardize)


def _model_query(key: str, name: str):
    @register(key)
    def q(spark, sf):
        p, tr, te = matrices(spark, sf, standardize=(name == "logreg"))
        m = models.fit(name, tr)
        return models.score(m, te).select("entity_id", "date", "label", "score")

    return q


_model_query("model_logreg", "logreg")
_model_query("model_gbt", "gbt")
_model_query("model_gbt_regularized", "gbt_regularized")
_model_query("model_gbt_depth4", "gbt_depth4")
_model_query("model_gbt_depth6", "gbt_depth6")
_model_query("model_gbt_hist", "gbt_hist")


def binned_table(spark, sf):
    """The feature table in bins, learned from train; part 0 = train, 1 = test."""
    from panelrisk.operators import fits

    f = feat_split(spark, sf).withColumn("dataset", F.lit("panel"))
    f = f.withColumn("part", F.when(F.col("split") == "train", 0).otherwise(1))
    return cut_lineage(fits.bin_rows(f, NUM, CAT, ["dataset", "part", "entity_id", "date", "split", "label"], "split = 'train'"))


def _tree_scores(spark, sf, names):
    """Test rows scored by fits that share one binned table: (model, entity_id, date, label, score)."""
    from panelrisk.operators import fits

    b = binned_table(spark, sf)
    fitted = fits.fit_many(b.filter("part = 0"), [fits.Fit("panel", n, fits.SPECS[n]) for n in names], ["entity_id", "date"])
    return fits.score_many(b.filter("part = 1"), fitted, ["entity_id", "date", "label"]).drop("dataset")


@register("model_random_forest")
def q_model_random_forest(spark, sf):
    return _tree_scores(spark, sf, ["random_forest"]).drop("model")


@register("model_soft_vote")
def q_model_soft_vote(spark, sf):
    s = _tree_scores(spark, sf, models.ENSEMBLE)
    return s.groupBy("entity_id", "date").agg((F.sum("score") / len(models.ENSEMBLE)).alias("score"))


@register("score_rows")
def q_score_rows(spark, sf):
    p, tr, te = matrices(spark, sf)
    m = models.fit("gbt_regularized", tr)
    return models.score(m, tr.unionByName(te)).select("entity_id", "date", "split", "score")


@register("early_stopping")
def q_early_stopping(spark, sf):
    """AUC of every prefix on the validation tail of train; the best one before 50 trees bring none scores test."""
    from panelrisk.operators import fits, splits
    from panelrisk.operators.trees import Trees

    f = feat_split(spark, sf)
    train = splits.validation_tail(f.filter("split = 'train'"), S)
    part = F.when(F.col("split") == "test", 2).otherwise(F.when(F.col("role") == "validation", 1).otherwise(0))
    rows = train.drop("pos").unionByName(f.filter("split = 'test'").withColumn("role", F.lit(None).cast("string")))
    rows = cut_lineage(rows.withColumn("dataset", F.lit("panel")).withColumn("part", part))
    b = cut_lineage(fits.bin_rows(rows, NUM, CAT, ["dataset", "part", "entity_id", "date", "label"], "part = 0"))
    fitted = fits.fit_many(b.filter("part = 0"), [fits.Fit("panel", "gbt", fits.SPECS["gbt"])], ["entity_id", "date"])
    model = bytes(fitted.first().model)
    trees, _ = fits.best_prefix(cut_lineage(fits.staged_auc(b.filter("part = 1"), model)))
    short = fits.first_trees(Trees.load(model), max(1, trees))
    kept = spark.createDataFrame([("panel", "gbt", 0, 0, len(short.roots), bytearray(short.dump()))], fitted.select("dataset", "fit", "piece", "upto", "trees", "model").schema)
    scored = fits.score_many(b.filter("part = 2"), kept, ["entity_id", "date"])
    return scored.select("entity_id", "date", "score", F.lit(len(short.roots)).alias("trees"))


@register("feature_importance")
def q_feature_importance(spark, sf):
    p, tr, te = matrices(spark, sf)
    m = models.fit("gbt", tr)
    return models.feature_importance(m, p.output_columns, spark)


@register("final_refit")
def q_final_refit(spark, sf):
    """Refit on all rows (train + test), score every entity's latest row (I10 → N03)."""
    from panelrisk.plans.score import score_latest

    from panelrisk.operators import artifact

    f = feat_split(spark, sf)
    model = artifact.refit(f, NUM, CAT, "gbt_regularized")
    scorer = lambda d: model.score(d, ["date", "entity_id", "entity_type"])
    return score_latest(f.drop("label"), S, scorer, alarm_rate=0.10)


@register("train_and_report")
def q_train_and_report(spark, sf):
    """Split, oversampling and undersampling of train, early stopping, reports, refit and latest scoring in one flow."""
    from panelrisk.operators import fits
    from panelrisk.plans.train import train_full

    out = train_full(fixture_panel(spark, sf), S, fits.SPECS["gbt_regularized"], smote_ratio=0.5, undersample_ratio=0.8, early_stop=True, threshold_mode="fixed")
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    report = out["report"].select(F.lit("report").alias("part"), "split", "row", "precision", "recall", "f1", F.col("support").cast("long").alias("support"), none("long", "entity_id"), none("double", "score"), none("int", "alarm_flag"))
    latest = out["latest"].select(F.lit("latest").alias("part"), none("string", "split"), none("string", "row"), none("double", "precision"), none("double", "recall"), none("double", "f1"), none("long", "support"), "entity_id", "score", "alarm_flag")
    return report.unionByName(latest)


@register("predict_file")
def q_predict_file(spark, sf):
    """Refit on all rows, store the model, and score a file that was written after the fit.

    The file is read back, its features are made anew, and the reloaded model
    scores every row; alarm by the file's own score quantile.
    """
    from panelrisk.operators import artifact
    from panelrisk.plans.score import score_file
    from panelrisk.queries.q_io import PANEL_SCHEMA
    from panelrisk.sources import csv

    folder = csv.scratch_path(spark, "model")
    artifact.refit(feat_split(spark, sf), NUM, CAT, "gbt_regularized").save(folder, spark)
    path = csv.scratch_path(spark, "new-file")
    csv.write_panel_csv(fixture_panel(spark, sf), path)
    model = artifact.load(spark, folder)
    rows = engineer_features(csv.read_panel_csv(spark, path, PANEL_SCHEMA), S)
    return score_file(rows, S, lambda d: model.score(d, ["date", "entity_id", "entity_type"]), 0.10)
