"""Structured Streaming versions of the trickle paths.

The reference polls on a clock (vitals every 5 minutes, syncs twice a day)
and marks rows with a NULL "synced" column.  Here a stream's checkpoint
replaces the marker, and every sink write is idempotent so a replayed
micro-batch (after a lost executor or a restart) changes nothing:

* daily rollup — each stored (patient, day) row remembers the last batch
  of each stream that touched it (``applied``); a replay skips rows already
  updated by that batch.  Only the days present in a batch are read and rewritten
  (dynamic partition overwrite on ``summary_date``).
* insert-ignore copy — repeated deliveries are dropped in the state store; new
  rows are anti-joined against the target's partitions for the batch's days
  before the append, so a replay appends nothing.
* trailing-24h heart rate — sums per 5-minute slot in the state store; each
  batch upserts the slots it changed (whole sums, so a replay changes nothing)
  and rewrites the 24-hour means of the days they reach.
* ledger — run transitions in any order, folded per run in the state store;
  each batch upserts the runs it changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clinops.functions.common import path_exists
from clinops.operators.ledger import ledger_state
from clinops.operators.sync import daily_rollup_delta
from clinops.operators.upsert import first_per_key, merge_into_partitions, new_rows, with_key_bucket
from clinops.sources.tables import VIEWS, _pick

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_stream(spark: SparkSession, path: str, schema: T.StructType = EVENTS_SCHEMA,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream with an explicit schema (no inference)."""
    r = spark.readStream.format("parquet").schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def start_ingest(readings: DataFrame, path: str, checkpoint_path: str, ts_col: str = "measured_at",
                 available_now: bool = True) -> StreamingQuery:
    """Trickle ingest: append readings to a parquet table partitioned by day.
    The file sink commits each micro-batch through its own log, so a replay
    after a failure writes nothing twice."""
    out = readings.withColumn("day", F.to_date(F.col(ts_col)))
    w = (out.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint_path).partitionBy("day").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 minutes")
    return w.start()


def wellness_increments(events: DataFrame) -> DataFrame:
    """Readings → daily-wellness increments (same binding as the batch view)."""
    return events.selectExpr(
        "user_id AS patient_no", "CAST(ts AS DATE) AS summary_date", "ts AS measured_at", "event_id",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS step_delta",
        "CAST(concat(CAST(5 + event_id % 4 AS STRING), '.', CAST(event_id % 10 AS STRING)) AS DECIMAL(4,1)) "
        "AS sleep_hours",
        "CAST(value AS DECIMAL(7,2)) AS stress_level")


def vital_readings(events: DataFrame) -> DataFrame:
    """Readings → whole vitals rows (the batch view's own binding)."""
    return events.selectExpr(*[f"{_pick(e, 'spark')} AS {n}" for n, e in VIEWS["user_vital_measurement"].columns])


ROLLUP_SCHEMA = T.StructType([
    T.StructField("patient_no", T.LongType()),
    T.StructField("step_count", T.LongType()),
    T.StructField("sleep_hours", T.DecimalType(4, 1)),
    T.StructField("stress_level", T.DecimalType(7, 2)),
    T.StructField("last_reading_at", T.TimestampNTZType()),
    T.StructField("applied", T.MapType(T.StringType(), T.LongType())),
    T.StructField("summary_date", T.DateType()),
])


def _read_store(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], ROLLUP_SCHEMA)
    return spark.read.schema(ROLLUP_SCHEMA).parquet(path)


def stream_identity(spark: SparkSession, checkpoint_path: str) -> str:
    """A name that lives as long as a stream's checkpoint: made on the first
    start, read back on restarts.  A new checkpoint is a new stream, whose
    batch numbers begin at 0 again."""
    path = f"{checkpoint_path.rstrip('/')}/rollup-stream"
    if path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.text(path).first()[0]
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return name


def apply_rollup_batch(batch: DataFrame, batch_id: int, store_path: str, stream: str = "") -> None:
    """Merge one micro-batch of increments into the stored daily rollup.

    Steps add (a missing step counts 0); sleep/stress follow the newest
    reading (stored or new).  Each row keeps the last batch applied per
    stream (``applied``), so a replay of a batch is a no-op while batches of
    another stream, or of the same job under a new checkpoint, still add up.
    """
    spark = batch.sparkSession
    delta = daily_rollup_delta(batch).withColumn("__b", F.lit(int(batch_id)))
    days = delta.select("summary_date").distinct()
    stored = _read_store(spark, store_path).join(days, "summary_date", "left_semi")
    s, d = stored.alias("s"), delta.alias("d")
    j = s.join(d, ["patient_no", "summary_date"], "full_outer")
    seen = F.try_element_at(F.col("s.applied"), F.lit(stream))
    fresh = F.col("d.__b").isNotNull() & (seen.isNull() | (seen < F.col("d.__b")))
    newer = fresh & (F.col("s.last_reading_at").isNull()
                     | (F.col("d.last_reading_at") >= F.col("s.last_reading_at")))
    others = F.map_filter(F.coalesce(F.col("s.applied"), F.create_map().cast("map<string,bigint>")),
                          lambda k, _: k != F.lit(stream))
    mine = F.create_map(F.lit(stream), F.col("d.__b").cast("bigint"))
    merged = j.select(
        "patient_no",
        F.when(fresh, F.coalesce(F.col("s.step_count"), F.lit(0)) + F.coalesce(F.col("d.step_delta"), F.lit(0)))
         .otherwise(F.col("s.step_count")).cast("bigint").alias("step_count"),
        F.when(newer, F.col("d.sleep_hours")).otherwise(F.col("s.sleep_hours")).alias("sleep_hours"),
        F.when(newer, F.col("d.stress_level")).otherwise(F.col("s.stress_level")).alias("stress_level"),
        F.when(newer, F.col("d.last_reading_at")).otherwise(F.col("s.last_reading_at")).alias("last_reading_at"),
        F.when(fresh, F.map_concat(others, mine)).otherwise(F.col("s.applied")).alias("applied"),
        "summary_date")
    # Materialise before overwriting the partitions it was read from.
    from clinops.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    merged = merged.checkpoint(eager=True)
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("summary_date").parquet(store_path))


def start_daily_rollup(increments: DataFrame, store_path: str, checkpoint_path: str,
                       available_now: bool = True) -> StreamingQuery:
    stream = stream_identity(increments.sparkSession, checkpoint_path)
    w = (increments.writeStream.foreachBatch(lambda df, bid: apply_rollup_batch(df, bid, store_path, stream))
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 minutes")
    return w.start()


HR_STEP = "5 minutes"
HR_DAY_SECONDS = 24 * 3600
HR_SCHEMA = T.StructType([
    T.StructField("slot", T.TimestampNTZType()),
    T.StructField("stream", T.StringType()),
    T.StructField("s", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("day", T.DateType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of the streams started from here lives in RocksDB (off the heap, changes uploaded per batch),
    unless the session names a provider of its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ROCKSDB)


def hr_slot_sums(readings: DataFrame) -> DataFrame:
    """Heart-rate sums per 5-minute slot: a stateful aggregate on a stream, the same frame in a batch.

    No watermark, so the state never drops a late reading; it holds one row per slot (288 a day), however many
    readings there are, and readings are combined in their tasks before they reach the state."""
    hr = F.col("heart_rate_bpm")
    some = readings.where(hr.isNotNull() & F.col("measured_at").isNotNull())
    return some.groupBy(F.window("measured_at", HR_STEP).start.alias("slot")).agg(
        F.sum(hr).cast("bigint").alias("s"), F.count(hr).alias("n"))


def _overwrite_days(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def apply_hr_slots(changed: DataFrame, store_path: str, means_path: str | None = None, stream: str = "") -> None:
    """Store the changed slots of one micro-batch and bring the 24-hour means up to date.

    The rows are whole slot sums, so storing them again (a replayed batch) changes nothing.  A slot has one row
    per stream.  Only the days of the changed slots are rewritten; their means reach one day further."""
    from clinops.session import ensure_checkpoint_dir
    spark = changed.sparkSession
    ensure_checkpoint_dir(spark)
    changed = changed.select("slot", F.lit(stream).alias("stream"), "s", "n", F.to_date("slot").alias("day")).checkpoint(eager=True)
    days = changed.select("day").distinct()
    if path_exists(spark, store_path):
        stored = spark.read.schema(HR_SCHEMA).parquet(store_path).join(days, "day", "left_semi")
        kept = stored.join(changed, ["slot", "stream"], "left_anti").select(*changed.columns)
        _overwrite_days(kept.unionByName(changed).checkpoint(eager=True), store_path)
    else:
        _overwrite_days(changed, store_path)
    if means_path:
        near = lambda lo, hi: days.select(  # noqa: E731 - the days from lo to hi around the changed ones
            F.explode(F.expr(f"transform(sequence({lo}, {hi}), k -> date_add(day, k))")).alias("day")).distinct()
        slots = spark.read.schema(HR_SCHEMA).parquet(store_path).join(near(-1, 1), "day", "left_semi")
        _overwrite_days(hr_24h_means(slots).join(near(0, 1), "day", "left_semi"), means_path)


def start_hr_slots(readings: DataFrame, store_path: str, checkpoint_path: str, available_now: bool = True,
                   means_path: str | None = None) -> StreamingQuery:
    """Slot sums kept in the state store; every batch upserts the slots it changed (update mode)."""
    spark = readings.sparkSession
    keep_state_on_disk(spark)
    stream = stream_identity(spark, checkpoint_path)

    def sink(df: DataFrame, _: int) -> None:
        apply_hr_slots(df, store_path, means_path, stream)

    w = hr_slot_sums(readings).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 minutes")
    return w.start()


def hr_24h_means(slots: DataFrame) -> DataFrame:
    """(day, window_end, n, avg_hr_24h): mean heart rate of the 24 hours that end with each stored slot.

    Windows are cut by day: 24 hours back from a slot lie in its own day and the day before, so every day is
    a group of at most two days' slots (576 rows), however long the history."""
    slots = slots.groupBy("slot").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    day = F.to_date("slot")
    two = slots.withColumn("day", F.explode(F.array(day, F.date_add(day, 1))))
    at = (F.datediff(day, F.lit("2000-01-01").cast("date")).cast("bigint") * HR_DAY_SECONDS
          + F.hour("slot") * 3600 + F.minute("slot") * 60)
    w = Window.partitionBy("day").orderBy(at).rangeBetween(300 - HR_DAY_SECONDS, 0)
    means = two.select("day", "slot", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"))
    return means.where(F.col("day") == day).select(
        "day", (F.col("slot") + F.expr(f"INTERVAL {HR_STEP}")).alias("window_end"), "n",
        F.bround(F.col("s") / F.col("n"), 1).alias("avg_hr_24h"))


SYNC_KEYS = ["patient_no", "measured_at"]


def apply_sync_batch(batch: DataFrame, batch_id: int, target_path: str) -> None:
    """Insert-ignore one micro-batch into the target (keyed on patient and
    reading time); only the target partitions of the batch's days are read."""
    spark = batch.sparkSession
    rows = batch.withColumn("measured_day", F.to_date("measured_at"))
    if path_exists(spark, target_path):
        days = rows.select("measured_day").distinct()
        target = spark.read.parquet(target_path)
        same_day = F.col("t.measured_day").eqNullSafe(F.col("d.measured_day"))
        existing = target.alias("t").join(days.alias("d"), same_day, "left_semi")
        new = new_rows(existing, rows, SYNC_KEYS, order="vital_id")
    else:
        new = first_per_key(rows, SYNC_KEYS, order="vital_id")
    new.write.mode("append").partitionBy("measured_day").parquet(target_path)


def first_deliveries(readings: DataFrame, remember: str = "1 hour") -> DataFrame:
    """Readings without those delivered again within ``remember``.

    The watermark runs on the time of arrival, not on the reading's own time: no row is ever late, so the state
    drops repeats only, and a key leaves the state ``remember`` after it came.  The id is part of the key: two
    readings of one patient and time are told apart here, and the keyed copy keeps the smaller id; readings
    with a NULL key part stay apart too."""
    arrived = readings.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", remember)
    return arrived.dropDuplicatesWithinWatermark([*SYNC_KEYS, "vital_id"]).drop("__arrived")


def start_sync(readings: DataFrame, target_path: str, checkpoint_path: str,
               available_now: bool = True, remember: str = "1 hour") -> StreamingQuery:
    """Exactly-once copy.  Repeated deliveries end in the state store; what is
    repeated after that, or under another id, meets the keyed anti-join
    against the target.  A late reading is simply one not copied yet."""
    keep_state_on_disk(readings.sparkSession)
    w = (first_deliveries(readings, remember).writeStream
         .foreachBatch(lambda df, bid: apply_sync_batch(df, bid, target_path))
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 minutes")
    return w.start()


LEDGER_BUCKETS = 64


def apply_ledger_batch(changed: DataFrame, store_path: str, buckets: int = LEDGER_BUCKETS) -> None:
    """Upsert the runs one micro-batch changed; only their key buckets are read and rewritten."""
    keyed = with_key_bucket(changed, ["batch_log_id"], buckets)
    columns = [c for c in changed.columns if c != "batch_log_id"]
    merge_into_partitions(store_path, keyed, ["batch_log_id"], columns, "key_bucket")


def start_ledger(transitions: DataFrame, store_path: str, checkpoint_path: str, available_now: bool = True) -> StreamingQuery:
    """Current state of every run from a stream of its transitions (batch_log_id, seq, status, at, error_message,
    next_retry_at).  The fold depends on ``seq`` alone, so transitions may come late, out of order or twice; no
    watermark, so none is lost; the state holds one row per run."""
    keep_state_on_disk(transitions.sparkSession)
    w = (ledger_state(transitions).writeStream.outputMode("update")
         .foreachBatch(lambda df, _: apply_ledger_batch(df, store_path))
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 minutes")
    return w.start()
