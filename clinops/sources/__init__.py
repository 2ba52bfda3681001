"""Sources: parquet scans and the logical clinic views bound onto them."""

from clinops.sources.tables import (
    OPS_AS_OF,
    OPS_TABLES,
    PG_TABLES,
    RAW_TABLES,
    VIEWS,
    WEAR_AS_OF_TS,
    UnboundTable,
    daily_wellness_view,
    duck_view_sql,
    duck_with,
    load_view,
    raw,
    view_as_of,
)

__all__ = [
    "OPS_AS_OF", "OPS_TABLES", "PG_TABLES", "RAW_TABLES", "VIEWS", "WEAR_AS_OF_TS",
    "UnboundTable", "daily_wellness_view", "duck_view_sql", "duck_with", "load_view",
    "raw", "view_as_of",
]
