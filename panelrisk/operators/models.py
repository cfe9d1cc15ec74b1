"""Classifiers on MLlib.

The boosters of the original pipeline are re-aimed to MLlib's GBT (grown by
``operators.boosting``) and random forest; logistic regression reproduces the C=1 objective with
``regParam = 1/Σw`` on standardized inputs and balanced weights.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import boosting

SEED = 42

# Fixed model configurations (trees, depth, learning rate, leaf size, sampling).
CONFIGS = {
    "gbt": dict(maxIter=200, stepSize=0.03, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8"),
    "gbt_regularized": dict(maxIter=120, stepSize=0.02, maxDepth=3, minInstancesPerNode=200, subsamplingRate=0.7,
                            featureSubsetStrategy="0.7"),
    "gbt_depth4": dict(maxIter=200, stepSize=0.03, maxDepth=4, subsamplingRate=0.8, featureSubsetStrategy="0.8"),
    "gbt_depth6": dict(maxIter=300, stepSize=0.03, maxDepth=6),
    "gbt_hist": dict(maxIter=300, stepSize=0.03, maxDepth=4, maxBins=255),
    "random_forest": dict(numTrees=400, minInstancesPerNode=20, maxDepth=30),
    "logreg": dict(maxIter=1000),
}
ENSEMBLE = ("gbt", "gbt_depth4", "gbt_depth6")  # members of the soft vote


def build(name: str, weight_col: str | None = "weight", overrides: dict | None = None, reg_param: float = 0.0):
    cfg = dict(CONFIGS[name])
    cfg.update(overrides or {})
    common = dict(featuresCol="features", labelCol="label")
    if weight_col:
        common["weightCol"] = weight_col
    if name == "logreg":
        return LogisticRegression(standardization=False, elasticNetParam=0.0, regParam=reg_param, **common, **cfg)
    if name == "random_forest":
        return RandomForestClassifier(seed=SEED, **common, **cfg)
    return GBTClassifier(seed=SEED, **common, **cfg)


def with_class_weight(df: DataFrame, label: str, scheme: str = "scale_pos", out: str = "weight") -> DataFrame:
    """Weight column.

    ``scale_pos``: positives weigh neg/max(pos,1), negatives 1 (booster style).
    ``balanced``: each class weighs n/(2·n_class).
    """
    c = df.agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_neg"),
    )
    d = df.crossJoin(F.broadcast(c))
    if scheme == "balanced":
        n = F.col("_pos") + F.col("_neg")
        w = F.when(F.col(label) == 1, n / (2 * F.col("_pos"))).otherwise(n / (2 * F.col("_neg")))
    else:
        w = F.when(F.col(label) == 1, F.col("_neg") / F.greatest(F.col("_pos"), F.lit(1))).otherwise(1.0)
    return d.withColumn(out, w.cast("double")).drop("_pos", "_neg")


def fit(name: str, train: DataFrame, overrides: dict | None = None, weight_scheme: str | None = None):
    """Fit a named model on ``features``/``label`` (adds the weight column)."""
    scheme = weight_scheme or ("balanced" if name in ("logreg", "random_forest") else "scale_pos")
    t = with_class_weight(train, "label", scheme)
    reg = 0.0
    if name == "logreg":
        reg = 1.0 / t.agg(F.sum("weight")).collect()[0][0]  # sklearn C=1 ⇔ regParam = 1/Σw
    estimator = build(name, "weight", overrides, reg)
    return boosting.fit(estimator, t) if isinstance(estimator, GBTClassifier) else estimator.fit(t)


def score(model, df: DataFrame, out: str = "score") -> DataFrame:
    """P(label = 1)."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def soft_vote(scored: list[DataFrame], keys: list[str], out: str = "score") -> DataFrame:
    """Mean of member probabilities joined on the row keys."""
    base = None
    for i, s in enumerate(scored):
        s = s.select(*keys, F.col("score").alias(f"_s{i}"))
        base = s if base is None else base.join(s, keys)
    mean = sum((F.col(f"_s{i}") for i in range(len(scored))), F.lit(0.0)) / len(scored)
    return base.select(*keys, mean.alias(out))


def tree_split_counts(model, n_features: int) -> list[int]:
    """Number of internal nodes splitting on each feature, over all trees."""
    import re

    counts = [0] * n_features
    trees = getattr(model, "trees", None) or []
    for t in trees:
        for m in re.finditer(r"If \(feature (\d+) ", t.toDebugString):
            counts[int(m.group(1))] += 1
    # every internal node appears twice in the dump (If / Else)
    return counts


def feature_importance(model, names: list[str], spark) -> DataFrame:
    """(feature, gain, split, gain_pct) (I12); gain = MLlib impurity importance."""
    imp = model.featureImportances.toArray().tolist() if hasattr(model, "featureImportances") else \
        [abs(x) for x in model.coefficients.toArray().tolist()]
    splits = tree_split_counts(model, len(names))
    rows = list(zip(names, [float(x) for x in imp], splits))
    df = spark.createDataFrame(rows, "feature string, gain double, split long")
    from pyspark.sql import Window

    return df.withColumn("gain_pct", F.col("gain") / F.sum("gain").over(Window.partitionBy()) * 100)
