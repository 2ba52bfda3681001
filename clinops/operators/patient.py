"""Patient lookups: identifier resolution, masked card, patient 360.

The reference answers one patient per request with six point queries; here
each builds for all patients at once.  Every per-patient input is reduced to
one row per patient *before* the joins (partial aggregation handles hot
patients), so the joins are 1:0..1 on ``patient_no``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinops.functions.common import as_date, date_lit, union_all
from clinops.functions.display import drop_hashes, format_cells, format_date, format_timestamp_ntz
from clinops.functions.labels import status_label
from clinops.functions.text import ustrip
from clinops.operators.mask import sanitize

LOOKUP_KINDS = ("patient_no", "app_user_id", "email", "tel")


def lookup_keys(requests: DataFrame) -> DataFrame:
    """Requests with the ``key`` that their kind is looked up by: the stripped value, never a blank one; a
    patient_no must parse as an integer; an unknown kind has none."""
    v = ustrip(F.col("value"))
    key = (F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
           .when(F.col("by") == "patient_no", F.expr("try_cast(value_s AS BIGINT)").cast("string"))
           .when(F.col("by").isin(*LOOKUP_KINDS[1:]), v))
    return requests.withColumn("value_s", v).withColumn("key", key)


def resolve_patient(requests: DataFrame, patients: DataFrame, profiles: DataFrame) -> DataFrame:
    """requests(by, value) → (by, value, patient_no or NULL).

    Value is stripped; blank never matches; a patient_no value must parse as
    an integer.  The distinct request keys of each kind are joined to that
    kind's identifier column — when requests are few (the usual case) AQE
    broadcasts them and the patient tables are scanned but never shuffled;
    when they are many it is one sort-merge join per kind.  Ambiguous keys
    resolve to the smallest patient_no (quirk Q14).
    """
    req = lookup_keys(requests)
    wanted = req.where(F.col("key").isNotNull()).select("by", "key").distinct()
    sources = {
        "patient_no": patients.select(F.col("patient_no").cast("string").alias("key"), "patient_no"),
        "app_user_id": profiles.select(F.col("app_user_id").alias("key"), "patient_no"),
        "email": patients.select(F.col("patient_email").alias("key"), "patient_no"),
        "tel": patients.select(F.col("patient_tel").alias("key"), "patient_no"),
    }
    hits = union_all([wanted.where(F.col("by") == kind).join(src, "key") for kind, src in sources.items()])
    best = hits.groupBy("by", "key").agg(F.min("patient_no").alias("patient_no"))
    return req.join(best, ["by", "key"], "left").select("by", "value", "patient_no")


def _masked_side(df: DataFrame, key_alias: str) -> DataFrame:
    keyed = df.withColumn(key_alias, F.col("patient_no"))
    return drop_hashes(format_cells(sanitize(keyed, hashes=False)))


def patient_card(patients: DataFrame, profiles: DataFrame) -> DataFrame:
    """Masked, display-formatted patient joined with its masked profile
    (hash side-cars dropped).  Masking runs per side before the join so the
    rules see the original column names; profile columns get ``profile_``."""
    p = _masked_side(patients, "__pk")
    pr = _masked_side(profiles, "__pk")
    pr = pr.select("__pk", *[F.col(c).alias(f"profile_{c}") for c in pr.columns if c != "__pk"])
    return p.join(pr, "__pk", "left").drop("__pk")


def patient_events(events: DataFrame) -> DataFrame:
    """Event history in display order (patient, category, date desc, id desc).

    A global sort: range partitioning splits on the whole sort key, so one
    patient's long history spreads over many tasks instead of one group.
    """
    return (events.select(
        "patient_no", "category", "clinical_event_id", "occurred_on",
        format_date(F.col("occurred_on")).alias("occurred_on_kr"),
        "department", "title", "summary",
        status_label(F.col("status")).alias("status"),
        "institution_name")
        .orderBy("patient_no", "category", F.col("occurred_on").desc(), F.col("clinical_event_id").desc()))


def patient_360(patients: DataFrame, profiles: DataFrame, disability: DataFrame,
                events: DataFrame, vitals: DataFrame, daily: DataFrame, as_of) -> DataFrame:
    """One row per patient: profile, disability, event summary (counts per
    category as sorted ``category:count`` text, newest event), newest vital, today's wellness."""
    as_of = as_date(as_of)
    category = F.coalesce("category", F.lit("None")).alias("category")  # a NULL one is shown as None
    per_cat = events.groupBy("patient_no", category).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("occurred_on", "clinical_event_id", "title")).alias("newest"))
    ev = per_cat.groupBy("patient_no").agg(
        F.sum("n").alias("n_events"),
        F.count(F.lit(1)).alias("n_categories"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))), lambda e: F.concat(
            e["category"], F.lit(":"), e["n"].cast("string"))), ",").alias("events_by_category"),
        F.max("newest").alias("newest"))
    vit = vitals.groupBy("patient_no").agg(
        F.max_by(F.struct("vital_id", "measured_at", "heart_rate_bpm", "blood_pressure_systolic",
                          "blood_pressure_diastolic", "body_temp_c", "stress_score", "source_channel"),
                 F.struct("measured_at", "vital_id")).alias("lv"))
    today = daily.where(F.col("summary_date") == date_lit(as_of)).select(
        "patient_no", F.col("step_count").alias("today_step_count"),
        F.col("step_goal").alias("today_step_goal"),
        F.col("sleep_hours").cast("double").alias("today_sleep_hours"),
        F.col("stress_level").cast("double").alias("today_stress_level"))
    base = patients.select("patient_no", "patient_name")
    prof = profiles.select("patient_no", "app_user_id", "blood_type",
                           F.col("height_cm").cast("double").alias("height_cm"),
                           F.col("weight_kg").cast("double").alias("weight_kg"),
                           F.col("intt_cd").alias("profile_intt_cd"))
    # 1:0..1 in the reference (keyed by patient); min() makes it total if not
    dis = disability.groupBy("patient_no").agg(
        F.min(F.struct("disability_grade", "disability_type", "assistive_device_YN",
                       "disability_device_type")).alias("d"))
    out = (base.join(prof, "patient_no", "left")
           .join(dis, "patient_no", "left")
           .join(ev, "patient_no", "left")
           .join(vit, "patient_no", "left")
           .join(today, "patient_no", "left"))
    return out.select(
        "patient_no", "patient_name", "app_user_id", "blood_type", "height_cm", "weight_kg", "profile_intt_cd",
        F.col("d.disability_grade").alias("disability_grade"),
        F.col("d.disability_type").alias("disability_type"),
        F.col("d.assistive_device_YN").alias("assistive_device_YN"),
        F.col("d.disability_device_type").alias("disability_device_type"),
        F.coalesce(F.col("n_events"), F.lit(0)).cast("bigint").alias("n_events"),
        F.coalesce(F.col("n_categories"), F.lit(0)).cast("bigint").alias("n_categories"),
        "events_by_category",
        format_date(F.col("newest.occurred_on")).alias("latest_event_on"),
        F.col("newest.title").alias("latest_event_title"),
        F.col("lv.vital_id").alias("latest_vital_id"),
        format_timestamp_ntz(F.col("lv.measured_at")).alias("latest_measured_at"),
        F.col("lv.heart_rate_bpm").alias("latest_heart_rate_bpm"),
        F.col("lv.blood_pressure_systolic").alias("latest_blood_pressure_systolic"),
        F.col("lv.blood_pressure_diastolic").alias("latest_blood_pressure_diastolic"),
        F.col("lv.body_temp_c").cast("double").alias("latest_body_temp_c"),
        F.col("lv.stress_score").cast("double").alias("latest_stress_score"),
        F.col("lv.source_channel").alias("latest_source_channel"),
        "today_step_count", "today_step_goal", "today_sleep_hours", "today_stress_level",
    )


def my_health(requests: DataFrame, patients: DataFrame, profiles: DataFrame, disability: DataFrame,
              events: DataFrame, vitals: DataFrame, daily: DataFrame, as_of) -> DataFrame:
    """Patient 360 for identifier requests (by, value): resolved requests are
    joined to the 360 rows; unresolved ones are dropped (the reference
    answers 404)."""
    resolved = resolve_patient(requests, patients, profiles).where(F.col("patient_no").isNotNull())
    # only the asked patients' rows are aggregated
    ids = resolved.select("patient_no").distinct()
    who, ev, vt, dw = (t.join(ids, "patient_no", "left_semi") for t in (patients, events, vitals, daily))
    full = patient_360(who, profiles, disability, ev, vt, dw, as_of)
    return resolved.withColumnRenamed("by", "resolved_by").join(full, "patient_no")


def my_health_events(requests: DataFrame, patients: DataFrame, profiles: DataFrame, events: DataFrame) -> DataFrame:
    """The event lists of identifier requests, flat: one row per request and
    event of its patient.  A long history stays many rows, never one array."""
    resolved = resolve_patient(requests, patients, profiles).where(F.col("patient_no").isNotNull())
    ids = resolved.select("patient_no").distinct()
    listed = (events.join(ids, "patient_no", "left_semi")
              .withColumn("category", F.coalesce("category", F.lit("None"))))
    rows = listed.select(
        "patient_no", "category", "clinical_event_id", format_date(F.col("occurred_on")).alias("occurred_on_kr"),
        "department", "title", "summary", status_label(F.col("status")).alias("status"), "institution_name")
    return resolved.withColumnRenamed("by", "resolved_by").join(rows, "patient_no")


EVENT_ITEM = ("clinical_event_id", "category", "occurred_on", "department", "title", "summary", "status", "institution_name")


def newest_events(events: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest events of every patient and category, with ``rank`` (date desc, id desc).

    The rank limit is applied in every task before the shuffle, so a patient
    with a third of all events sends at most k rows per category and task."""
    w = Window.partitionBy("patient_no", "category").orderBy(F.col("occurred_on").desc(), F.col("clinical_event_id").desc())
    rows = events.withColumn("category", F.coalesce("category", F.lit("None")))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= int(k))


def events_by_category(events: DataFrame, k: int) -> DataFrame:
    """(patient_no, clinical_events_by_category): category → its ``k`` newest events as displayed, newest first.
    The lists hold at most k events; categories are in order of their name."""
    shown = newest_events(events, k).withColumn("status", status_label(F.col("status"))).withColumn(
        "occurred_on", F.coalesce(format_date(F.col("occurred_on")), F.lit("")))
    per = shown.groupBy("patient_no", "category").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.struct(*EVENT_ITEM).alias("event")))).alias("ranked"))
    per = per.select("patient_no", F.struct("category", F.transform("ranked", lambda e: e["event"]).alias("events")).alias("c"))
    return per.groupBy("patient_no").agg(
        F.map_from_entries(F.sort_array(F.collect_list("c"))).alias("clinical_events_by_category"))


def my_health_categories(requests: DataFrame, patients: DataFrame, profiles: DataFrame, events: DataFrame,
                         k: int = 20) -> DataFrame:
    """Per resolved identifier request its patient's newest events by category, nested as the request answers
    them (an empty map for a patient without events)."""
    resolved = resolve_patient(requests, patients, profiles).where(F.col("patient_no").isNotNull())
    asked = events.join(resolved.select("patient_no").distinct(), "patient_no", "left_semi")
    rows = resolved.withColumnRenamed("by", "resolved_by").join(events_by_category(asked, k), "patient_no", "left")
    empty = F.create_map().cast(rows.schema["clinical_events_by_category"].dataType)
    return rows.withColumn("clinical_events_by_category", F.coalesce("clinical_events_by_category", empty))
