"""Identifier index: (kind, value) → patient_no, stored in hash buckets.

``resolve_patient`` scans the patient tables for every request batch.  The index holds their identifiers apart, in
``buckets`` folders by the hash of kind and value; a batch reads only the folders its values fall into, sorted by
kind and value, and a change of some patients rewrites only the folders of their old and new identifiers.

Every folder holds one row without a value, so that a bucket that loses its last identifier is still rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinops.functions.common import union_all
from clinops.operators.patient import lookup_keys

BUCKETS = 256
COLUMNS = ["by", "key", "patient_no"]


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("by", "key"), F.lit(buckets)).cast("int")


def identifiers(patients: DataFrame, profiles: DataFrame) -> DataFrame:
    """(by, key, patient_no) of all patients, one row per identifier."""
    def one(kind: str, df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(
            F.lit(kind).alias("by"), F.col(column).cast("string").alias("key"), F.col("patient_no").cast("bigint").alias("patient_no"))

    return union_all([one("patient_no", patients, "patient_no"), one("app_user_id", profiles, "app_user_id"),
                      one("email", patients, "patient_email"), one("tel", patients, "patient_tel")])


def _write(rows: DataFrame, path: str) -> None:
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "by", "key", "patient_no")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def build_index(patients: DataFrame, profiles: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of all patients."""
    rows = identifiers(patients, profiles).distinct().withColumn("bucket", _bucket(buckets))
    blank = rows.sparkSession.range(buckets).select(
        F.lit(None).cast("string").alias("by"), F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("bigint").alias("patient_no"), F.col("id").cast("int").alias("bucket"))
    _write(rows.unionByName(blank), path)


def _some_buckets(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The index rows in the buckets of ``wanted`` (at most as many numbers as there are folders come to the driver)."""
    numbers = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers))


def refresh_index(path: str, before: DataFrame, after: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace the identifiers of changed patients: ``before`` and ``after`` are their ``identifiers``.  Doing it
    again changes nothing."""
    from clinops.session import ensure_checkpoint_dir

    spark = before.sparkSession
    ensure_checkpoint_dir(spark)
    gone = before.join(after, COLUMNS, "left_anti").withColumn("bucket", _bucket(buckets))
    new = after.distinct().withColumn("bucket", _bucket(buckets))
    touched = gone.select("bucket").unionByName(new.select("bucket"))
    names = [*COLUMNS, "bucket"]
    current = _some_buckets(spark, path, touched).select(*names)
    kept = current.join(gone.unionByName(new), names, "left_anti")  # rows without a value match nothing and stay
    _write(kept.unionByName(new.select(*names)).checkpoint(eager=True), path)


def resolve_indexed(requests: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """What ``resolve_patient`` answers, from the index: (by, value, patient_no or NULL), smallest number first."""
    req = lookup_keys(requests)
    wanted = req.where(F.col("key").isNotNull()).select("by", "key").distinct().withColumn("bucket", _bucket(buckets))
    index = _some_buckets(requests.sparkSession, path, wanted)
    best = wanted.join(index, ["bucket", "by", "key"]).groupBy("by", "key").agg(F.min("patient_no").alias("patient_no"))
    return req.join(best, ["by", "key"], "left").select("by", "value", "patient_no")
