"""Wearable-side aggregates and newest-row lists."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinops.functions.common import as_datetime, date_lit, ts_lit
from clinops.functions.display import format_date, format_timestamp_ntz
from clinops.functions.labels import category_label, status_label
from clinops.operators.mask import sanitize

# Units of the long (normal-form) vitals layout.
VITAL_UNITS = {
    "heart_rate_bpm": "bpm",
    "blood_pressure_systolic": "mmHg",
    "blood_pressure_diastolic": "mmHg",
    "body_temp_c": "°C",
    "stress_score": "score",
}


def vitals_aggregate(vitals: DataFrame, daily: DataFrame, as_of_ts) -> DataFrame:
    """Total / today / unsynced vitals and the trailing-24h mean heart rate in
    ONE scan (the reference issues four statements), plus unsynced daily rows."""
    now = as_datetime(as_of_ts)
    m = F.col("measured_at")
    hr = F.col("heart_rate_bpm")
    recent_hr = F.when((m >= ts_lit(now - _dt.timedelta(hours=24))) & hr.isNotNull(), hr)
    v = vitals.agg(
        F.count(F.lit(1)).alias("total_vitals"),
        F.count_if(F.to_date(m) == date_lit(now.date())).alias("today_vitals"),
        F.count_if(F.col("synced_to_mysql_at").isNull()).alias("pending_mysql_sync"),
        F.bround(F.avg(recent_hr), 1).alias("avg_heart_rate_24h"),
    ).withColumn("__k", F.lit(1))
    d = (daily.agg(F.count_if(F.col("synced_to_mysql_at").isNull()).alias("pending_daily_mysql_sync"))
         .withColumn("__k", F.lit(1)))
    # one-row ⋈ one-row on a constant key
    return v.join(d, "__k").drop("__k")


def pending_sync(vitals: DataFrame) -> DataFrame:
    """Vitals not yet copied to the operations side (marker IS NULL)."""
    return (vitals.where(F.col("synced_to_mysql_at").isNull())
            .select("vital_id", "patient_no", "measured_at", "created_date", "intt_cd"))


def _ordinal(order: tuple, wanted: bool) -> list:
    """Place of each row in a newest-n list (the window spans the n listed rows only)."""
    return [F.row_number().over(Window.partitionBy().orderBy(*order)).alias("ordinal")] if wanted else []


def recent_vitals(vitals: DataFrame, n: int = 12, with_keys: bool = False,
                  with_order: bool = False) -> DataFrame:
    """Newest ``n`` readings, captioned time, sync flag, wearable mask."""
    order = (F.col("measured_at").desc(), F.col("vital_id").desc())
    top = vitals.orderBy(*order).limit(n)
    shaped = top.select(
        *_ordinal(order, with_order),
        "vital_id", "patient_no",
        format_timestamp_ntz(F.col("measured_at")).alias("measured_at"),
        "heart_rate_bpm", "blood_pressure_systolic", "blood_pressure_diastolic",
        F.col("body_temp_c").cast("double").alias("body_temp_c"),
        F.col("stress_score").cast("double").alias("stress_score"),
        "source_channel",
        F.col("synced_to_mysql_at").isNotNull().alias("synced_mysql"))
    return sanitize(shaped, profile="wearable", key_sidecars=("patient_no",) if with_keys else ())


def recent_events(events: DataFrame, n: int = 15, with_keys: bool = False,
                  with_order: bool = False) -> DataFrame:
    """Newest ``n`` clinical events with labels, wearable mask and the
    'any row carries a source treatment id' flag over that short list."""
    order = (F.col("occurred_on").desc(), F.col("clinical_event_id").desc())
    top = events.orderBy(*order).limit(n)
    shaped = top.select(
        *_ordinal(order, with_order),
        "clinical_event_id", "patient_no", "category",
        format_date(F.col("occurred_on")).alias("occurred_on"),
        "department", "title", "status", "source_mysql_treatment_id",
        category_label(F.col("category")).alias("category_kr"),
        status_label(F.col("status")).alias("status_kr"),
        # bounded: the window spans the n listed rows only
        F.max(F.col("source_mysql_treatment_id").isNotNull()).over(Window.partitionBy())
        .alias("include_mysql_treatment_id_column"))
    return sanitize(shaped, profile="wearable", key_sidecars=("patient_no",) if with_keys else ())


def recent_wellness(daily: DataFrame, n: int = 10, with_keys: bool = False,
                    with_order: bool = False) -> DataFrame:
    """Newest ``n`` daily rows (date desc, patient asc), masked."""
    order = (F.col("summary_date").desc(), F.col("patient_no").asc())
    top = daily.orderBy(*order).limit(n)
    shaped = top.select(
        *_ordinal(order, with_order),
        "patient_no", format_date(F.col("summary_date")).alias("summary_date"),
        "step_count", "step_goal",
        F.col("sleep_hours").cast("double").alias("sleep_hours"),
        F.col("stress_level").cast("double").alias("stress_level"),
        F.col("synced_to_mysql_at").isNotNull().alias("synced_mysql"))
    return sanitize(shaped, profile="wearable", key_sidecars=("patient_no",) if with_keys else ())


def clinical_by_category(events: DataFrame) -> DataFrame:
    """Count of clinical events per category with its label."""
    agg = events.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    return agg.select(F.coalesce(F.col("category"), F.lit("None")).alias("category"),
                      category_label(F.coalesce(F.col("category"), F.lit("None"))).alias("label_kr"),
                      "count")


def etl_state(state: DataFrame) -> DataFrame:
    """Latest cursor per job (max of (updated_at, cursor) — no sort, partial
    aggregation per job code)."""
    latest = state.groupBy("job_code").agg(
        F.max(F.struct("updated_at", "cursor_value")).alias("s"))
    return latest.select("job_code", F.col("s.cursor_value").alias("cursor_value"),
                         format_timestamp_ntz(F.col("s.updated_at")).alias("updated_at"))


_LATEST_FIELDS = ("vital_id", "measured_at", "heart_rate_bpm", "blood_pressure_systolic",
                  "blood_pressure_diastolic", "body_temp_c", "stress_score", "source_channel")


def latest_vitals(vitals: DataFrame) -> DataFrame:
    """Newest reading per patient via ``max_by`` on (measured_at, vital_id):
    a partial aggregate, so a patient with a third of all rows is reduced
    map-side instead of being sorted in one task."""
    latest = vitals.groupBy("patient_no").agg(
        F.max_by(F.struct(*_LATEST_FIELDS), F.struct("measured_at", "vital_id")).alias("v"))
    return latest.select(
        "patient_no", "v.vital_id",
        format_timestamp_ntz(F.col("v.measured_at")).alias("measured_at"),
        "v.heart_rate_bpm", "v.blood_pressure_systolic", "v.blood_pressure_diastolic",
        F.col("v.body_temp_c").cast("double").alias("body_temp_c"),
        F.col("v.stress_score").cast("double").alias("stress_score"),
        "v.source_channel")


def hour_index(ts_col) -> F.Column:
    """Whole hours since 2000-01-01 (dialect-neutral bucket key)."""
    return (F.datediff(F.to_date(ts_col), F.lit("2000-01-01").cast("date")).cast("bigint") * 24
            + F.hour(ts_col))


def hourly_hr_sliding(vitals: DataFrame, hours: int = 24) -> DataFrame:
    """Trailing-24h mean heart rate at every hour (batch twin of the
    streaming sliding window).

    Readings are first reduced to (sum, count) per hour — one row per hour
    however many readings — and the trailing range window then runs over
    that small hourly series.
    """
    hr = F.col("heart_rate_bpm")
    hourly = (vitals.where(hr.isNotNull())
              .groupBy(hour_index(F.col("measured_at")).alias("hour_idx"))
              .agg(F.sum(hr).alias("s"), F.count(hr).alias("n")))
    w = Window.orderBy("hour_idx").rangeBetween(-(hours - 1), 0)
    return hourly.select(
        "hour_idx",
        F.sum("n").over(w).alias("n_readings"),
        F.bround(F.sum("s").over(w) / F.sum("n").over(w), 1).alias("avg_hr_24h"))


def vitals_long(vitals: DataFrame) -> DataFrame:
    """Wide readings → (patient_no, measured_at, metric_type, value, unit),
    non-null values only."""
    metrics = list(VITAL_UNITS)
    wide = vitals.select("vital_id", "patient_no", "measured_at",
                         *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot(["vital_id", "patient_no", "measured_at"], metrics, "metric_type", "value")
    units = F.create_map(*[F.lit(x) for kv in VITAL_UNITS.items() for x in kv])
    return (long.where(F.col("value").isNotNull())
            .withColumn("unit", units[F.col("metric_type")]))
