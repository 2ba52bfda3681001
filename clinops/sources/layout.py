"""Physical layouts that let repeated joins skip their shuffle.

Patient-keyed facts (readings, clinical events, daily rows) meet on
``patient_no`` in the patient 360, latest-reading and sync jobs.  Writing
them once bucketed by that key with the same bucket count co-partitions
them: later aggregations and sort-merge joins on the key read the buckets
directly, with no exchange, however large the tables grow.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

TARGET_BUCKET_BYTES = 256 * 1024 ** 2


def bucket_count(total_bytes: float, target_bytes: int = TARGET_BUCKET_BYTES, minimum: int = 8) -> int:
    """Power-of-two bucket count giving ~``target_bytes`` per bucket; use the
    same count for every table that joins on the key."""
    need = max(minimum, math.ceil(total_bytes / target_bytes))
    return 1 << (need - 1).bit_length()


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str,
                  sort_keys: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as an external table bucketed (and sorted) by ``keys``
    under ``path`` and return the catalog table."""
    w = df.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, *keys)
    w = w.sortBy(*(sort_keys or keys))
    w.saveAsTable(table)
    return df.sparkSession.table(table)
