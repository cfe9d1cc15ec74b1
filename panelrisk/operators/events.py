"""Events derived from counters, and the forward-looking event label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.spec import PanelSpec


def entity_order(spec: PanelSpec):
    return Window.partitionBy(spec.entity).orderBy(spec.date)


def counter_reset_event(spec: PanelSpec) -> Column:
    """1 when the counter dropped below its previous value (an event happened).

    First row of an entity and NULL comparisons give 0, like a pandas
    comparison with NaN.
    """
    prev = F.lag(spec.counter).over(entity_order(spec))
    return F.coalesce((F.col(spec.counter) < prev).cast("int"), F.lit(0))


def with_events(df: DataFrame, spec: PanelSpec, name: str = "event") -> DataFrame:
    return df.withColumn(name, counter_reset_event(spec))


def forward_event_label(df: DataFrame, spec: PanelSpec, event_col: str, horizons=(7, 30),
                        prefix: str = "label_") -> DataFrame:
    """``label_h`` = an event exists within the next ``h`` days (strictly after today).

    ``label_complete_h`` marks rows whose full horizon lies inside the data
    (right-censoring of the last ``h`` days).
    """
    # later rows come first in this order: a growing frame, summed up once, instead of a shrinking one
    ahead = Window.partitionBy(spec.entity).orderBy(F.col(spec.date).desc()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.min(F.when(F.col(event_col) == 1, F.col(spec.date))).over(ahead)
    out = df.withColumn("_next_event", nxt)
    max_d = df.agg(F.max(spec.date).alias("_max_date"))  # one row, broadcast
    out = out.crossJoin(F.broadcast(max_d))
    for h in horizons:
        out = out.withColumn(
            f"{prefix}{h}", F.coalesce((F.datediff("_next_event", spec.date) <= h).cast("int"), F.lit(0))
        ).withColumn(f"{prefix}complete_{h}", (F.datediff("_max_date", spec.date) >= h).cast("int"))
    return out.drop("_next_event", "_max_date")
