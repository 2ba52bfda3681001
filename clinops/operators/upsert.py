"""Table maintenance as DataFrame transforms (MERGE is unavailable on plain
parquet tables, so upsert is a keyed full outer join).

All functions return the new table state; writing it is the caller's step
(``write_snapshot``): a new folder per version, committed last, so a lost
executor or a crash before the commit leaves the previous version intact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinops.functions.common import bounded_broadcast, path_exists

KEY_FLOOR = 10_000_000


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str],
           with_action: bool = False, source_order: list[str] | None = None) -> DataFrame:
    """Insert source rows with new keys; for existing keys overwrite only
    ``update_cols`` and keep every other target value.

    One shuffle join on the key columns.  The result has the target's
    columns (plus ``action`` = insert/update/keep when asked).  The source is
    reduced to one row per key: the last by ``source_order`` (sequential
    ``ON DUPLICATE KEY`` semantics), else the largest row.  Keys match by
    plain equality, as a unique key does: a NULL key part matches nothing, so
    such source rows are inserted and such target rows are kept.  An update
    column that the source lacks, or that the target lacks, is an error.
    """
    absent = [c for c in [*keys, *update_cols] if c not in source.columns or c not in target.columns]
    if absent:
        raise ValueError(f"columns missing from the source or the target: {absent}")
    s = source.select(*[c for c in source.columns if c in target.columns or c in (source_order or [])])
    s = _one_per_key(s, keys, F.max_by(F.struct(*s.columns), F.struct(*source_order)) if source_order
                     else F.max(F.struct(*s.columns))).withColumn("__s", F.lit(True))
    t = target.withColumn("__t", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in keys])
    j = t.alias("t").join(s.alias("s"), same, "full_outer")
    in_s, in_t = F.col("s.__s").isNotNull(), F.col("t.__t").isNotNull()
    cols = []
    for c in target.columns:
        tc, sc = F.col(f"t.`{c}`"), F.col(f"s.`{c}`") if c in source.columns else F.lit(None)
        if c in update_cols:
            e = F.when(in_s, sc).otherwise(tc)
        else:
            e = F.when(in_t, tc).otherwise(sc)
        cols.append(e.cast(target.schema[c].dataType).alias(c))
    if with_action:
        cols.append(F.when(in_s & in_t, F.lit("update")).when(in_s, F.lit("insert"))
                    .otherwise(F.lit("keep")).alias("action"))
    return j.select(*cols)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``INSERT IGNORE``: rows whose key is absent from ``target`` (first
    occurrence per key within ``rows``), appended to ``target``."""
    new = new_rows(target, rows, keys)
    return target.unionByName(new, allowMissingColumns=True)


def _whole_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])


def _one_per_key(rows: DataFrame, keys: list[str], pick: Column) -> DataFrame:
    """One row per key by the aggregate ``pick``; rows with a NULL key part are
    all kept (a unique key does not compare them)."""
    whole = _whole_key(keys)
    one = rows.where(whole).groupBy(*keys).agg(pick.alias("__r")).select("__r.*")
    return one.unionByName(rows.where(~whole))


def _first(rows: DataFrame, order: str | None) -> Column:
    whole = F.struct(*rows.columns)
    return F.min_by(whole, F.col(order)) if order else F.min(whole)


def first_per_key(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The row of each key with the smallest ``order`` value (or the smallest
    row), so that a recomputed task picks the same row."""
    return _one_per_key(rows, keys, _first(rows, order))


def new_rows(target: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows whose key is not in ``target``, one per key, by a left-anti join.

    Rows with a NULL key part are apart: nothing equals them, so all are new,
    unless ``order`` names an id that both sides have; then those ids already
    in the target are left out, which keeps a replay a no-op."""
    whole = _whole_key(keys)
    some = rows.where(whole).groupBy(*keys).agg(_first(rows, order).alias("__r")).select("__r.*")
    # Reduce the (large) target to the keys the batch actually has: a semi-join
    # whose build side is the batch, so a small batch is broadcast (AQE) and
    # the target is scanned but never shuffled; the anti-join then meets a
    # key set no larger than the batch.
    present = target.select(*keys).join(some.select(*keys), keys, "left_semi")
    new = some.join(present, keys, "left_anti")
    loose = rows.where(~whole)
    if order and order in target.columns and order not in keys:
        loose = loose.join(target.where(~whole).select(order), order, "left_anti")
    return new.unionByName(loose)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Keep the complement of ``predicate`` (a NULL predicate keeps the row,
    as SQL DELETE would not delete it)."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def append_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Multi-row insert: ``rows`` appended by column name (missing → NULL)."""
    return target.unionByName(rows, allowMissingColumns=True)


def append_to(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append sink: new files next to the existing ones (no rewrite)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def create_if_absent(spark, path: str, schema: T.StructType, partition_by: list[str] | None = None) -> bool:
    """``CREATE TABLE IF NOT EXISTS``: an empty parquet table where there is
    none; says whether it was made.  An existing table is left as it is."""
    if path_exists(spark, path):
        return False
    append_to(spark.createDataFrame([], schema), path, partition_by)
    return True


def add_columns_if_absent(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``ADD COLUMN IF NOT EXISTS`` for each (name → SQL type)."""
    for name, dtype in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return df


def evolve_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive evolution: old rows get NULL for columns only the new data has."""
    return old.unionByName(new, allowMissingColumns=True)


def assign_keys(df: DataFrame, order_cols: list[str], key_name: str,
                existing_max: DataFrame | None = None, floor: int = KEY_FLOOR,
                checkpoint: bool = True) -> DataFrame:
    """Dense surrogate keys ``base + 1 + i`` in ``order_cols`` order, where
    base = coalesce(max existing key, floor).

    No single-partition window: rows are range-partitioned and sorted, each
    partition numbers its rows locally (``monotonically_increasing_id``), and
    a prefix sum over the per-partition counts (one row per partition) gives
    each partition's offset.  ``order_cols`` must be unique so the order is
    total.  The sorted frame is checkpointed to the reliable checkpoint
    folder so partition contents are fixed even if an executor is lost.
    """
    spark = df.sparkSession
    if checkpoint:
        from clinops.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
    ordered = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    ordered = ordered.withColumn("__pid", F.spark_partition_id()).withColumn(
        "__mid", F.monotonically_increasing_id())
    if checkpoint:
        ordered = ordered.checkpoint(eager=True)
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    counts = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # bounded: one row per partition
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    if existing_max is None:
        base = spark.range(1).select(F.lit(floor).cast("bigint").alias("__base"))
    else:
        base = existing_max.select(F.coalesce(F.col(existing_max.columns[0]).cast("bigint"),
                                              F.lit(floor).cast("bigint")).alias("__base"))
    base = base.withColumn("__k", F.lit(1))
    numbered = (ordered.join(bounded_broadcast(offsets), "__pid")
                .withColumn("__k", F.lit(1)).join(bounded_broadcast(base), "__k"))
    return (numbered.withColumn(key_name, F.col("__base") + F.col("__off") + local + 1)
            .drop("__pid", "__mid", "__off", "__base", "__k"))


def merge_into_partitions(target_path: str, source: DataFrame, keys: list[str], update_cols: list[str],
                          partition_col: str) -> None:
    """Upsert ``source`` into a parquet table partitioned by ``partition_col``,
    reading and rewriting ONLY the partitions the source touches.

    The touched partitions are selected with a null-safe semi-join on the
    partition column (dynamic partition pruning skips the other folders),
    merged with ``upsert``, materialised to the reliable checkpoint folder
    (the write replaces files the merge read from) and written back with
    dynamic partition overwrite.  A key must not change its partition.

    The result has the target's columns: those the source lacks keep their
    stored values, a source column the target lacks is an error, and so is
    any failure to read an existing table; stored rows are then untouched.
    """
    from clinops.session import ensure_checkpoint_dir
    spark = source.sparkSession
    ensure_checkpoint_dir(spark)
    if path_exists(spark, target_path):
        current = spark.read.parquet(target_path)
        extra = [c for c in source.columns if c not in current.columns]
        if extra:
            raise ValueError(f"the table at {target_path} has no columns {extra}")
        parts = source.select(partition_col).distinct()
        same = F.col(f"c.`{partition_col}`").eqNullSafe(F.col(f"p.`{partition_col}`"))
        touched = current.alias("c").join(parts.alias("p"), same, "left_semi").select(*current.columns)
    else:
        touched = source.limit(0)
    merged = upsert(touched, source, keys, update_cols).checkpoint(eager=True)
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(target_path))


def with_key_bucket(df: DataFrame, keys: list[str], buckets: int, name: str = "key_bucket") -> DataFrame:
    """Partition column for keyed tables with no natural date (patients,
    profiles): a stable hash bucket of the key.  With the table partitioned by
    it, ``merge_into_partitions`` rewrites only the buckets a batch's keys fall
    into instead of the whole table."""
    return df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(int(buckets))))


def dedupe_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order`` (partial aggregation, no per-key sort)."""
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return agg.select("__r.*")


def write_snapshot(df: DataFrame, base_path: str, version: int | str,
                   partition_by: list[str] | None = None) -> str:
    """Write ``df`` as version ``version`` under ``base_path`` and commit it
    by writing the ``_LATEST`` pointer last.  Readers follow the pointer, so
    an interrupted write is never visible."""
    path = f"{base_path.rstrip('/')}/v={version}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(str(version),)], T.StructType([T.StructField("version", T.StringType())])) \
        .coalesce(1).write.mode("overwrite").json(f"{base_path.rstrip('/')}/_LATEST")
    return path


def latest_version(spark, base_path: str) -> str | None:
    """Latest committed version under ``base_path`` (None when there is none)."""
    pointer = f"{base_path.rstrip('/')}/_LATEST"
    if not path_exists(spark, pointer):
        return None
    v = spark.read.json(pointer).first()
    return None if v is None else v["version"]


def read_snapshot(spark, base_path: str) -> DataFrame | None:
    """Rows of the latest committed version (None when there is none)."""
    version = latest_version(spark, base_path)
    return None if version is None else spark.read.parquet(f"{base_path.rstrip('/')}/v={version}")
