"""Small shared Column/DataFrame helpers."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def ts_lit(value: _dt.datetime | _dt.date | str) -> Column:
    """A TIMESTAMP_NTZ literal (no session-zone conversion, pushable)."""
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def date_lit(value: _dt.date | _dt.datetime | str) -> Column:
    if isinstance(value, _dt.datetime):
        value = value.date()
    return F.expr(f"DATE'{value}'")


def month_key(c: Column) -> Column:
    """'yyyy-MM' of a DATE / TIMESTAMP_NTZ without any time-zone conversion."""
    return F.substring(F.to_date(c).cast("string"), 1, 7)


def day_key(c: Column) -> Column:
    """'yyyy-MM-dd' of a DATE / TIMESTAMP_NTZ without any time-zone conversion."""
    return F.to_date(c).cast("string")


def as_datetime(value: _dt.date | _dt.datetime) -> _dt.datetime:
    if isinstance(value, _dt.datetime):
        return value
    return _dt.datetime.combine(value, _dt.time())


def as_date(value: _dt.date | _dt.datetime) -> _dt.date:
    return value.date() if isinstance(value, _dt.datetime) else value


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a frame whose size is bounded by construction (a top-N or a
    per-partition summary); callers state the bound next to the call."""
    return F.broadcast(df)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does ``path`` exist in its file system?  Anything but "no" as an answer
    (no permission, store down) raises, so a read error is never taken for an
    empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def when_empty(frame: DataFrame, fallback: DataFrame) -> DataFrame:
    """``frame`` plus ``fallback``'s rows when ``frame`` is empty.

    Emptiness is tested with a left-anti join on a constant key against one
    row of ``frame`` — no driver round trip.
    """
    probe = frame.limit(1).select(F.lit(1).alias("__k"))
    extra = (fallback.withColumn("__k", F.lit(1))
             .join(probe, "__k", "left_anti").drop("__k"))
    return frame.unionByName(extra)
