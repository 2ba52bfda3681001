"""Batch sync jobs with crash-safe write order.

The reference marked each source row right after its target statement and
could lose rows when a later failure rolled the target back (quirk Q6).
These jobs write in the safe order, target first and markers second, and both
writes are keyed, so a crash between them, or a rerun, never duplicates or
loses a row:

1. read the pending source rows, test them against the job's rules and
   materialise them, each with the reason it is refused or none, to the
   reliable checkpoint folder;
2. write the good ones to the target (append of rows not there yet, or a
   keyed merge of the partitions they lie in);
3. store refused rows in the rejects table, once per key and reason;
4. set the markers of the good rows, rewriting only the source partitions
   (days) that hold them.  Refused rows stay pending and are tried again.

If a job stops after step 2, the next run finds the same pending rows; the
keyed write puts none of them down twice, and step 4 completes the markers.

Counters are taken by ``observe`` in the jobs that write, so no table is
read again to be counted.  (A stage that runs twice after a lost executor may
count its rows twice; the tables themselves are exact.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clinops.functions.common import as_datetime, path_exists, ts_lit
from clinops.operators import sync
from clinops.operators.upsert import append_to, merge_into_partitions
from clinops.session import ensure_checkpoint_dir

DAY = "day"
Rules = list[tuple[str, Column]]


def _read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.parquet(path) if path_exists(spark, path) else spark.createDataFrame([], like.schema)


def _observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def _examined(batch: DataFrame, rules: Rules | None) -> tuple[DataFrame, dict[str, int]]:
    """The batch with the reason of each refused row, materialised, and its counters."""
    tagged, seen = _observed(sync.with_reason(batch, rules or []), examined=F.count(F.lit(1)), errors=F.count("reason"))
    tagged = tagged.checkpoint(eager=True)
    return tagged, {name: int(n) for name, n in seen.get.items()}


def _append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    rows, seen = _observed(rows, n=F.count(F.lit(1)))
    append_to(rows, path, partition_by)
    return int(seen.get["n"])


def _store_rejects(tagged: DataFrame, path: str | None, keys: list[str], errors: int) -> None:
    """Refused rows not stored before under the same key and reason (NULL key parts are equal here)."""
    if not path or not errors:
        return
    bad = tagged.where(F.col("reason").isNotNull())
    names = [*keys, "reason"]
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names]
    old = _read_or_empty(tagged.sparkSession, path, bad)
    append_to(bad.alias("b").join(old.alias("o"), same, "left_anti"), path)


def _mark(source: DataFrame, source_path: str, done: DataFrame, keys: list[str], marker: str, now: Column,
          touch: tuple[str, ...] = ()) -> int:
    """Set the marker (and the ``touch`` columns) of the rows in ``done`` that have none; the count of them."""
    hit = done.select(*keys).distinct().join(source, keys).where(F.col(marker).isNull())
    set_ = {c: now for c in (marker, *touch)}
    marks, seen = _observed(hit.withColumns(set_).select(*source.columns), n=F.count(F.lit(1)))
    marks = marks.checkpoint(eager=True)
    merge_into_partitions(source_path, marks, keys, list(set_), DAY)
    return int(seen.get["n"])


def run_vitals_sync(spark: SparkSession, source_path: str, target_path: str, as_of_ts, limit: int | None = None,
                    stop_after_target: bool = False, rules: Rules | None = None,
                    rejects_path: str | None = None) -> dict[str, int]:
    """Readings → operations side, insert-ignore by (patient_no, measured_at);
    returns its counters.  ``stop_after_target`` ends the run between the two
    writes (used to test crash recovery)."""
    ensure_checkpoint_dir(spark)
    source = spark.read.parquet(source_path)
    pending = sync.pending(source.drop(DAY), "synced_to_mysql_at", ["vital_id"], limit)
    tagged, counts = _examined(sync.vital_copy_rows(pending, as_of_ts), rules)
    good = tagged.where(F.col("reason").isNull()).drop("reason")
    target = _read_or_empty(spark, target_path, good.withColumn(DAY, F.to_date("measured_at")))
    new = sync.new_rows(target.drop(DAY), good, ["patient_no", "measured_at"], order="vital_id")
    counts["inserted"] = _append(new.withColumn(DAY, F.to_date("measured_at")), target_path, [DAY])
    if stop_after_target:
        return counts | {"marked": 0}
    _store_rejects(tagged, rejects_path, ["vital_id"], counts["errors"])
    # the id alone names a reading; measured_at may be NULL
    counts["marked"] = _mark(source, source_path, good, ["vital_id"], "synced_to_mysql_at", ts_lit(as_datetime(as_of_ts)))
    return counts


def run_daily_sync(spark: SparkSession, source_path: str, target_path: str, as_of_ts, limit: int | None = None,
                   stop_after_target: bool = False, rules: Rules | None = None,
                   rejects_path: str | None = None) -> dict[str, int]:
    """Daily rows → operations side, upsert by (patient_no, summary_date).  Both tables are partitioned by ``day``
    (the summary date).  Rows without a whole key are refused."""
    ensure_checkpoint_dir(spark)
    keys = ["patient_no", "summary_date"]
    source = spark.read.parquet(source_path)
    pending = sync.pending(source.drop(DAY), "synced_to_mysql_at", keys, limit)
    whole = [r for r in sync.daily_rules() if r[0].startswith("missing")]
    tagged, counts = _examined(sync.daily_copy_rows(pending, as_of_ts), rules or whole)
    good = tagged.where(F.col("reason").isNull()).drop("reason")
    counts["copied"] = counts["examined"] - counts["errors"]
    if counts["copied"]:
        merge_into_partitions(target_path, good.withColumn(DAY, F.col("summary_date")), keys, sync.DAILY_UPDATE_COLS, DAY)
    if stop_after_target:
        return counts | {"marked": 0}
    _store_rejects(tagged, rejects_path, keys, counts["errors"])
    counts["marked"] = _mark(source, source_path, good, keys, "synced_to_mysql_at", ts_lit(as_datetime(as_of_ts)))
    return counts


def run_treatments_sync(spark: SparkSession, source_path: str, events_path: str, as_of_ts, limit: int | None = None,
                        stop_after_target: bool = False, rules: Rules | None = None,
                        rejects_path: str | None = None) -> dict[str, int]:
    """Treatments → clinical events of the app side, once per source id, with dense new event ids.  Treatments
    are partitioned by ``day`` of the visit."""
    ensure_checkpoint_dir(spark)
    source = spark.read.parquet(source_path)
    tagged, counts = _examined(sync.pending_treatments(source.drop(DAY), limit), rules)
    good = tagged.where(F.col("reason").isNull()).drop("reason")
    like = sync.treatment_event_rows(good, as_of_ts).withColumn("clinical_event_id", F.lit(0).cast("bigint"))
    events = _read_or_empty(spark, events_path, like)
    new = sync.numbered_events(sync.with_copied(good, events), events, as_of_ts)
    counts["inserted"] = _append(new.select(*events.columns), events_path)
    counts["skipped_existing"] = counts["examined"] - counts["errors"] - counts["inserted"]
    if stop_after_target:
        return counts | {"marked": 0}
    _store_rejects(tagged, rejects_path, ["treatment_id"], counts["errors"])
    counts["marked"] = _mark(source, source_path, good, ["treatment_id"], "synced_to_postgres_at",
                             ts_lit(as_datetime(as_of_ts)), ("last_modified_date",))
    return counts
