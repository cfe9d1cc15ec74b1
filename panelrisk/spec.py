"""Panel specification: which column plays which role.

The library is not tied to one domain: an *entity* is observed once per *date*;
*usage* columns are daily/trailing amounts, *counters* reset at events, the
*exogenous* columns (weather) are identical fleet-wide for a date.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "entity_id"
    date: str = "date"
    entity_type: str = "entity_type"
    age: str = "entity_age"
    usage_today: str = "use_today"
    usage_7d: str = "use_last_7d"
    usage_30d: str = "use_last_30d"
    days_since_maint: str = "days_since_last_maintenance"
    usage_since_maint: str = "use_since_last_maintenance"
    counter: str = "days_since_last_event"
    temp: str = "temp"
    weather_type: str = "weather_type"
    wind: str = "wind_speed"
    humidity: str = "humidity"
    label: str = "event_next_30d"
    other_label: str = "event_next_7d"
    # columns treated as categories (ordinal-encoded, mode-imputed)
    categorical: tuple[str, ...] = ("entity_type", "weather_type", "season")
    # optional raw columns dropped by feature engineering if present
    redundant: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    def with_label(self, label: str, other: str | None) -> "PanelSpec":
        return replace(self, label=label, other_label=other)


# Column names of the fixture panel built from the driver tables.
FIXTURE_SPEC = PanelSpec()

# Column names of the original vehicle-day CSV files.
VEHICLE_SPEC = PanelSpec(
    entity="vehicle_id",
    date="date",
    entity_type="vehicle_type",
    age="vehicle_age",
    usage_today="km_today",
    usage_7d="km_last_7d",
    usage_30d="km_last_30d",
    days_since_maint="days_since_last_maintenance",
    usage_since_maint="km_since_last_maintenance",
    counter="days_since_last_failure",
    label="failure_next_30d",
    other_label="failure_next_7d",
    categorical=("vehicle_type", "weather_type", "season", "cevre_temizligi"),
    redundant=("mevsim",),
)
