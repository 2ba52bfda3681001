"""Table profiles kept up to date from partial aggregates.

The profile of a table (row count, today's rows, newest row, daily trend) is a merge of counts and maxima.  They
are stored per partition of the table and created day, so a run reads only the partitions whose files have changed
since the last one (new, rewritten or appended to); the profile itself is an aggregate of the small store.

A partition's *state* is a digest of its files' names, sizes and times, taken from the listing alone.  Partials
carry the state they were made from and count only while the manifest names that state: a partition that is
rewritten, emptied or removed drops out by itself.  The manifest is committed last, so an interrupted run is
repeated by the next one and nothing counts twice.

Partition values must be plain (dates, numbers, names): they are compared as they stand in the folder names.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinops.functions.common import as_date, date_lit, path_exists
from clinops.functions.display import format_timestamp_ntz
from clinops.operators.upsert import latest_version, read_snapshot, write_snapshot

PARTIAL_SCHEMA = "state long, created_day date, n long, newest timestamp_ntz, part string"


def partition_states(spark: SparkSession, path: str, part_col: str) -> DataFrame:
    """(part, state, files) of a table partitioned by ``part_col``; lists files and reads none."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(path).select("path", "length", "modificationTime"))
    return files.groupBy(F.regexp_extract("path", f"/{part_col}=([^/]*)/", 1).alias("part")).agg(
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("state"), F.count("*").alias("files"))


def changed_partitions(states: DataFrame, store_path: str) -> DataFrame:
    """The partitions whose state the store's manifest does not hold."""
    known = read_snapshot(states.sparkSession, f"{store_path}/manifest")
    return states if known is None else states.join(known.select("part", "state"), ["part", "state"], "left_anti")


def update_profile(spark: SparkSession, table_path: str, store_path: str, part_col: str = "day",
                   created: str = "created_date") -> list[str]:
    """Bring the store up to date with the table; returns the partitions that were read."""
    from clinops.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    states = partition_states(spark, table_path, part_col).checkpoint(eager=True)
    # one short name per changed folder; the driver lists the folders in any case
    changed = {r.part: r.state for r in changed_partitions(states, store_path).collect()}
    if changed:
        folders = [f"{table_path.rstrip('/')}/{part_col}={p}" for p in sorted(changed)]
        rows = spark.read.option("basePath", table_path).parquet(*folders)
        part = F.regexp_extract("_metadata.file_path", f"/{part_col}=([^/]*)/", 1)
        made = rows.groupBy(part.alias("part"), F.to_date(created).alias("created_day")).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col(created)).cast("timestamp_ntz").alias("newest"))
        made = made.join(states.select("part", "state"), "part").select("state", "created_day", "n", "newest", "part")
        (made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part")
         .parquet(f"{store_path}/partials"))
    version = latest_version(spark, f"{store_path}/manifest")
    write_snapshot(states, f"{store_path}/manifest", 0 if version is None else int(version) + 1)
    return sorted(changed)


def partials(spark: SparkSession, store_path: str) -> DataFrame:
    """(part, created_day, n, newest) of the table as the last committed run saw it."""
    path = f"{store_path}/partials"
    manifest = read_snapshot(spark, f"{store_path}/manifest")
    if manifest is None or not path_exists(spark, path):
        return spark.createDataFrame([], PARTIAL_SCHEMA).drop("state")
    stored = spark.read.schema(PARTIAL_SCHEMA).parquet(path)
    return stored.join(manifest.select("part", "state"), ["part", "state"], "left_semi").drop("state")


def stored_stats(partial: DataFrame, name: str, as_of, caption: str | None = None, ordinal: int = 1) -> DataFrame:
    """The row that ``operators.profile.table_stats`` gives for the table."""
    total = partial.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(F.when(F.col("created_day") >= date_lit(as_date(as_of)), F.col("n"))), F.lit(0)).alias("today_count"),
        F.max("newest").alias("newest"))
    return total.select(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("table_name"),
                        F.lit(caption or name).alias("table_name_kr"), "total_count", "today_count",
                        format_timestamp_ntz(F.col("newest")).alias("last_created_at"))


def stored_trend(partial: DataFrame, name: str, as_of, days: int = 14) -> DataFrame:
    """The rows that ``operators.profile.table_daily_trend`` gives for the table."""
    low = date_lit(as_date(as_of) - _dt.timedelta(days=days - 1))
    return partial.where(F.col("created_day") >= low).groupBy(F.col("created_day").cast("string").alias("day")).agg(
        F.sum("n").alias("count")).select(F.lit(name).alias("table_name"), "day", "count")
