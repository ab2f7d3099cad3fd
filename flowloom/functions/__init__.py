"""Column expressions; all of them stay inside the JVM."""

from flowloom.functions.columns import (
    fixed,
    json_field,
    money,
    net_value,
    period_start,
    ratio,
    route_label,
    seconds,
    time_parts,
    value_band,
)

__all__ = [
    "fixed",
    "json_field",
    "money",
    "net_value",
    "period_start",
    "ratio",
    "route_label",
    "seconds",
    "time_parts",
    "value_band",
]
