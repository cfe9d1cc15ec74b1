"""Single-entity mode of the forecast flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import events
from panelrisk.spec import PanelSpec


def only_entity(panel: DataFrame, spec: PanelSpec, entity) -> DataFrame:
    """Rows of one entity. An unknown id raises, listing known ids."""
    own = panel.filter(F.col(spec.entity) == F.lit(entity))
    if not own.limit(1).collect():
        known = [r[0] for r in panel.select(spec.entity).distinct().orderBy(spec.entity).limit(20).collect()]
        raise ValueError(f"unknown {spec.entity} {entity!r}; known ids start with {known}")
    return own


def entity_events(panel: DataFrame, spec: PanelSpec, entity) -> DataFrame:
    """Events of one entity. The windows partition by the entity key, so filtering the panel first
    changes nothing in them, and the filter reaches the scan."""
    return events.with_events(only_entity(panel, spec, entity), spec)
