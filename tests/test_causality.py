"""Changing rows after day d must not change any feature at or before d,
except the monthly temperature deviation, which by design uses all rows (trap T1)."""

from pyspark.sql import functions as F

from panelrisk.plans.features import DERIVED, engineer_features
from panelrisk.sources.fixture import fixture_panel
from panelrisk.spec import FIXTURE_SPEC as S

SF = "/root/testdata/sf0.001"


def test_features_do_not_look_ahead(spark):
    panel = fixture_panel(spark, SF).cache()
    try:
        _check(panel)
    finally:
        panel.unpersist()  # a cached panel would replace the scans in later plan-shape tests


def _check(panel):
    cut = panel.selectExpr("percentile_approx(date, 0.6)").collect()[0][0]
    later = F.col("date") > F.lit(cut)
    changed = panel.withColumn("use_today", F.when(later, F.col("use_today") * 3 + 11).otherwise(F.col("use_today"))) \
        .withColumn("days_since_last_event", F.when(later, F.lit(0)).otherwise(F.col("days_since_last_event"))) \
        .withColumn("temp", F.when(later, F.col("temp") + 40).otherwise(F.col("temp")))
    cols = [c for c in DERIVED if c != "temp_dev_from_month"]
    a = engineer_features(panel, S).filter(~later).select("entity_id", "date", *cols)
    b = engineer_features(changed, S).filter(~later).select("entity_id", "date", *cols)
    diff = a.exceptAll(b).count() + b.exceptAll(a).count()
    assert diff == 0
    # and the exception is real: the monthly deviation does move
    dev_a = engineer_features(panel, S).filter(~later).agg(F.sum("temp_dev_from_month")).collect()[0][0]
    dev_b = engineer_features(changed, S).filter(~later).agg(F.sum("temp_dev_from_month")).collect()[0][0]
    assert abs(dev_a - dev_b) > 1e-6
