"""panelrisk — Spark-native analytics for entity-by-day panels.

Leakage-free window features, calendar splits, class balancing, preprocessing,
MLlib classifiers, threshold selection, ranking metrics and count forecasts,
all expressed as DataFrame plans.
"""

from panelrisk.spec import PanelSpec, FIXTURE_SPEC, VEHICLE_SPEC

__all__ = ["PanelSpec", "FIXTURE_SPEC", "VEHICLE_SPEC"]
