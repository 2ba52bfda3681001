"""Two-way incremental sync between the app (wearable) side and the
operations side, as batch DataFrame jobs.

The reference copies row by row and marks each source row as soon as its
target statement ran (quirk Q6: a later rollback loses rows).  Here each
sync returns the rows to write, the new source markers and the outcome
counts; callers write the target first and the markers after it, and a
replay is a no-op because every write is keyed (anti-join / upsert).

Work-batch limits (2000 / 500 rows per run in the reference) are optional:
by default a run processes every pending row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinops.functions.common import as_datetime, bounded_broadcast, ts_lit
from clinops.functions.text import truncate
from clinops.operators.upsert import assign_keys, new_rows, upsert

ETL_TAG = "ETL_SYNC"
# Treatment types copied as clinical categories, the default.
COPIED_CATEGORIES = ("OUTPATIENT", "INPATIENT", "EMERGENCY")
DEFAULT_CATEGORY = "OUTPATIENT"
TITLE_SUFFIX = " 진료 #"
TITLE_MAX = 200

PATIENT_UPDATE_COLS = ["patient_name", "patient_gender", "patient_birth", "patient_address",
                       "patient_last_visit", "last_modified_date", "intt_cd"]
PROFILE_UPDATE_COLS = ["app_user_id", "blood_type", "height_cm", "weight_kg",
                       "last_modified_date", "intt_cd"]
DAILY_UPDATE_COLS = ["step_count", "step_goal", "sleep_hours", "stress_level",
                     "last_modified_date", "intt_cd"]


def _or_default(c: Column, default: Column) -> Column:
    """Python ``value or default``: NULL and '' both take the default."""
    return F.coalesce(F.when(c.cast("string") != "", c), default)


def pending(df: DataFrame, marker: str, order: list[str], limit: int | None = None,
            extra: Column | None = None) -> DataFrame:
    """Rows whose sync marker is NULL; optionally the first ``limit`` by key
    (None: all of them, 0: none)."""
    p = df.where(F.col(marker).isNull() if extra is None else (F.col(marker).isNull() & extra))
    return p if limit is None else p.orderBy(*order).limit(limit)


def upsert_patients(target: DataFrame, source: DataFrame) -> DataFrame:
    """Patient master copy: match on patient_no, overwrite the 7 synced
    columns, keep the rest of the target row; new patients inserted whole."""
    return upsert(target, source, ["patient_no"], PATIENT_UPDATE_COLS, with_action=True)


def upsert_profiles(target: DataFrame, source: DataFrame) -> DataFrame:
    """App profile copy (created_date kept on match)."""
    return upsert(target, source, ["patient_no"], PROFILE_UPDATE_COLS, with_action=True)


def vital_copy_rows(batch: DataFrame, as_of_ts) -> DataFrame:
    """Shape pending readings for the operations table: decimals → double,
    ``created_date or now``, ``intt_cd or 'ETL_SYNC'``."""
    now = ts_lit(as_datetime(as_of_ts))
    return batch.select(
        "vital_id", "patient_no", "measured_at", "heart_rate_bpm",
        "blood_pressure_systolic", "blood_pressure_diastolic",
        F.col("body_temp_c").cast("double").alias("body_temp_c"),
        F.col("stress_score").cast("double").alias("stress_score"),
        "source_channel",
        F.coalesce(F.col("created_date"), now).alias("created_date"),
        _or_default(F.col("intt_cd"), F.lit(ETL_TAG)).alias("intt_cd"))


def sync_vitals(source: DataFrame, target: DataFrame, as_of_ts, limit: int | None = None,
                rules: list[tuple[str, Column]] | None = None) -> dict:
    """Insert-ignore copy of pending readings keyed by (patient_no, measured_at).

    Returns ``inserted`` (rows to append), ``outcomes`` (vital_id, outcome:
    inserted | duplicate | rejected), ``rejected`` (rows that break a rule in
    ``rules``, with the ``reason``) and ``marked`` (the source with markers set
    for every examined row that was not rejected).  Without rules nothing is
    rejected, as in the reference, where only the target can refuse a row.
    """
    batch = vital_copy_rows(pending(source, "synced_to_mysql_at", ["vital_id"], limit), as_of_ts)
    keys = ["patient_no", "measured_at"]
    batch, rejected = quarantine(batch, rules or [])
    inserted = new_rows(target, batch, keys, order="vital_id")
    outcomes = (batch.select("vital_id")
                .join(inserted.select("vital_id", F.lit("inserted").alias("outcome")), "vital_id", "left")
                .select("vital_id", F.coalesce("outcome", F.lit("duplicate")).alias("outcome"))
                .unionByName(rejected.select("vital_id", F.lit("rejected").alias("outcome"))))
    everything = limit is None and not rules
    marked = mark_synced(source, None if everything else batch.select("vital_id"), "vital_id",
                         "synced_to_mysql_at", as_of_ts)
    return {"inserted": inserted, "outcomes": outcomes, "marked": marked, "rejected": rejected}


def mark_synced(source: DataFrame, batch_keys: DataFrame | None, key: str | list[str], marker: str, as_of_ts,
                pending_filter: Column | None = None, touch: list[str] | None = None) -> DataFrame:
    """Set ``marker`` (and the ``touch`` columns) = as_of on rows in the batch
    whose marker is still NULL.

    When the batch is every pending row (``batch_keys`` is None) this is a
    projection — no join, no shuffle.  Any other batch is joined on ``key``
    (one or several columns); Spark broadcasts it when its size allows."""
    now = ts_lit(as_datetime(as_of_ts))
    m = F.col(marker)
    if batch_keys is None:
        hit = m.isNull() if pending_filter is None else (m.isNull() & F.coalesce(pending_filter, F.lit(False)))
        rows = source
    else:
        names = [key] if isinstance(key, str) else list(key)
        rows = source.join(batch_keys.select(*names).distinct().withColumn("__in", F.lit(True)), names, "left")
        hit = F.coalesce(F.col("__in"), F.lit(False)) & m.isNull()
    set_ = {marker, *(touch or [])}
    return rows.select(*[F.when(hit, now).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c)
                         for c in source.columns])


def mark_daily(source: DataFrame, as_of_ts, limit: int | None = None) -> DataFrame:
    """Markers of copied daily rows, keyed by (patient_no, summary_date)."""
    keys = ["patient_no", "summary_date"]
    batch = None if limit is None else pending(source, "synced_to_mysql_at", keys, limit).select(*keys)
    return mark_synced(source, batch, keys, "synced_to_mysql_at", as_of_ts)


def daily_copy_rows(batch: DataFrame, as_of_ts) -> DataFrame:
    now = ts_lit(as_datetime(as_of_ts))
    return batch.select(
        "patient_no", "summary_date", "step_count", "step_goal",
        F.col("sleep_hours").cast("double").alias("sleep_hours"),
        F.col("stress_level").cast("double").alias("stress_level"),
        F.coalesce(F.col("created_date"), now).alias("created_date"),
        F.coalesce(F.col("last_modified_date"), now).alias("last_modified_date"),
        _or_default(F.col("intt_cd"), F.lit(ETL_TAG)).alias("intt_cd"))


def sync_daily(source: DataFrame, target: DataFrame, as_of_ts, limit: int | None = None,
               rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Upsert pending daily rows by (patient_no, summary_date); 6 columns
    overwritten on match.  Result: the new target with ``action``.  Rows that
    break a rule are left out (``rejected_daily`` lists them)."""
    batch = daily_copy_rows(pending(source, "synced_to_mysql_at", ["patient_no", "summary_date"], limit),
                            as_of_ts)
    return upsert(target, quarantine(batch, rules or [])[0], ["patient_no", "summary_date"], DAILY_UPDATE_COLS,
                  with_action=True)


def rejected_daily(source: DataFrame, as_of_ts, rules: list[tuple[str, Column]], limit: int | None = None) -> DataFrame:
    """The pending daily rows that break a rule, with the ``reason``."""
    keys = ["patient_no", "summary_date"]
    return quarantine(daily_copy_rows(pending(source, "synced_to_mysql_at", keys, limit), as_of_ts), rules)[1]


def treatment_event_rows(batch: DataFrame, as_of_ts) -> DataFrame:
    """Treatment → clinical event: category (three codes, else OUTPATIENT),
    date of the visit, title '{dept or type} 진료 #{id}' cut at 200."""
    t = F.col("treatment_type")
    head = F.coalesce(F.when(F.col("treatment_dept") != "", F.col("treatment_dept")), t, F.lit("None"))
    return batch.select(
        "patient_no",
        F.when(t.isin(*COPIED_CATEGORIES), t).otherwise(F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.to_date("treatment_date").alias("occurred_on"),
        F.col("treatment_dept").alias("department"),
        truncate(F.concat(head, F.lit(TITLE_SUFFIX), F.col("treatment_id").cast("string")), TITLE_MAX).alias("title"),
        F.col("treatment_comment").alias("summary"),
        F.col("treatment_status").alias("status"),
        F.lit(None).cast("string").alias("institution_name"),
        F.col("treatment_id").alias("source_mysql_treatment_id"),
        ts_lit(as_datetime(as_of_ts)).alias("created_date"),
        F.lit(ETL_TAG).alias("intt_cd"))


def with_copied(batch: DataFrame, events: DataFrame) -> DataFrame:
    """The treatments of a batch with ``__exists``: an event with their source id is there already.

    Only the event rows whose source id is in the batch are met (semi-join
    with the batch as build side: a small batch is broadcast, the events are
    not shuffled)."""
    existing = (events.where(F.col("source_mysql_treatment_id").isNotNull())
                .select(F.col("source_mysql_treatment_id").alias("treatment_id"))
                .join(batch.select("treatment_id"), "treatment_id", "left_semi").distinct()
                .withColumn("__exists", F.lit(True)))
    return batch.join(existing, "treatment_id", "left")


def numbered_events(tagged: DataFrame, events: DataFrame, as_of_ts) -> DataFrame:
    """Event rows of the treatments not yet copied, with dense ids after the current maximum."""
    return assign_keys(treatment_event_rows(tagged.where(F.col("__exists").isNull()), as_of_ts),
                       ["source_mysql_treatment_id"], "clinical_event_id",
                       existing_max=events.agg(F.max("clinical_event_id").alias("m")), floor=0)


def pending_treatments(treatments: DataFrame, limit: int | None = None) -> DataFrame:
    """Treatments of a patient that are not yet copied."""
    return pending(treatments, "synced_to_postgres_at", ["treatment_id"], limit, extra=F.col("patient_no").isNotNull())


def sync_treatments(treatments: DataFrame, events: DataFrame, as_of_ts, limit: int | None = None,
                    assign_ids: bool = True, rules: list[tuple[str, Column]] | None = None) -> dict:
    """Copy pending treatments (non-NULL patient) into clinical events.

    Treatments already present by source id are skipped; both kinds are
    marked.  Returns ``inserted`` (new event rows, with dense new event ids
    after the current maximum), ``outcomes`` (treatment_id, outcome),
    ``rejected`` (treatments that break a rule, with the ``reason``) and
    ``marked`` (treatments with the new markers; rejected ones stay pending).
    """
    batch, rejected = quarantine(pending_treatments(treatments, limit), rules or [])
    tagged = with_copied(batch, events)
    outcomes = tagged.select("treatment_id", F.when(F.col("__exists"), F.lit("skipped_existing"))
                             .otherwise(F.lit("inserted")).alias("outcome"))
    if assign_ids:
        to_insert = numbered_events(tagged, events, as_of_ts)
    else:
        to_insert = treatment_event_rows(tagged.where(F.col("__exists").isNull()), as_of_ts)
    everything = limit is None and not rules
    marked = mark_synced(treatments, None if everything else batch.select("treatment_id"), "treatment_id",
                         "synced_to_postgres_at", as_of_ts, pending_filter=F.col("patient_no").isNotNull(),
                         touch=["last_modified_date"])
    return {"inserted": to_insert, "outcomes": outcomes, "marked": marked, "rejected": rejected}


def sync_stats(vital_outcomes: DataFrame, treatment_outcomes: DataFrame, daily_merged: DataFrame,
               patients_merged: DataFrame, profiles_merged: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of run counters (examined / inserted / skipped / marked /
    errors).  Duplicates are reported apart from copies (quirk Q7)."""
    written = F.count_if(F.col("action") != "keep")
    v = vital_outcomes.agg(F.count(F.lit(1)).alias("vitals_examined"),
                           F.count_if(F.col("outcome") == "inserted").alias("vitals_copied"),
                           F.count_if(F.col("outcome") == "duplicate").alias("vitals_duplicate"),
                           F.count_if(F.col("outcome") != "rejected").alias("vital_ids_marked"))
    t = treatment_outcomes.agg(F.count(F.lit(1)).alias("examined"),
                               F.count_if(F.col("outcome") == "inserted").alias("inserted"),
                               F.count_if(F.col("outcome") == "skipped_existing").alias("skipped_existing_pg"),
                               F.count(F.lit(1)).alias("marked_mysql"))
    d = daily_merged.agg(written.alias("daily_copied"), written.alias("daily_marked"))
    p = patients_merged.agg(written.alias("patients_upserted"))
    pr = profiles_merged.agg(written.alias("profiles_upserted"))
    e = rejected.agg(F.count(F.lit(1)).alias("errors"))
    out = v.withColumn("__k", F.lit(1))
    for other in (t, d, p, pr, e):
        out = out.join(other.withColumn("__k", F.lit(1)), "__k")
    return out.drop("__k")


# ---- validation / quarantine ----------------------------------------------
def vital_rules() -> list[tuple[str, Column]]:
    """Checks a reading must pass before it is copied (first failure wins)."""
    return [
        ("missing patient_no", F.col("patient_no").isNull()),
        ("missing measured_at", F.col("measured_at").isNull()),
        ("heart_rate_bpm out of range", ~F.col("heart_rate_bpm").between(20, 250)),
        ("body_temp_c out of range", ~F.col("body_temp_c").between(30, 45)),
        ("stress_score out of range", ~F.col("stress_score").between(0, 100)),
    ]


def daily_rules() -> list[tuple[str, Column]]:
    """Checks a daily row must pass before it is copied."""
    return [
        ("missing patient_no", F.col("patient_no").isNull()),
        ("missing summary_date", F.col("summary_date").isNull()),
        ("step_count out of range", F.col("step_count") < 0),
        ("sleep_hours out of range", ~F.col("sleep_hours").between(0, 24)),
        ("stress_level out of range", ~F.col("stress_level").between(0, 100)),
    ]


def treatment_rules() -> list[tuple[str, Column]]:
    """Checks a treatment must pass before it becomes a clinical event."""
    return [
        ("missing treatment_id", F.col("treatment_id").isNull()),
        ("missing treatment_date", F.col("treatment_date").isNull()),
    ]


def with_reason(df: DataFrame, rules=None) -> DataFrame:
    """``df`` with the first failing rule's ``reason`` (NULL: passes all)."""
    rules = rules if rules is not None else vital_rules()
    reason = F.lit(None).cast("string")
    for text, cond in reversed(rules):
        reason = F.when(F.coalesce(cond, F.lit(False)), F.lit(text)).otherwise(reason)
    return df.withColumn("reason", reason)


def quarantine(df: DataFrame, rules=None) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, bad); ``bad`` carries the first failing rule's
    ``reason``.  Replaces the reference's per-row try/except."""
    tagged = with_reason(df, rules)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


# ---- accumulating daily rollup -------------------------------------------
def daily_rollup_delta(increments: DataFrame) -> DataFrame:
    """Per (patient, day): steps added up, sleep/stress of the newest reading."""
    newest = F.struct("measured_at", "event_id")
    return increments.groupBy("patient_no", "summary_date").agg(
        F.sum("step_delta").cast("bigint").alias("step_delta"),
        F.max_by("sleep_hours", newest).alias("sleep_hours"),
        F.max_by("stress_level", newest).alias("stress_level"),
        F.max("measured_at").alias("last_reading_at"))


def daily_wellness_rollup(stored: DataFrame, increments: DataFrame, as_of_ts) -> DataFrame:
    """Accumulating upsert: steps ADD to the stored value, sleep and stress
    are replaced by the newest increment, the sync marker resets to NULL."""
    delta = daily_rollup_delta(increments)
    now = ts_lit(as_datetime(as_of_ts))
    s = stored.alias("s")
    d = delta.alias("d")
    j = s.join(d, ["patient_no", "summary_date"], "full_outer")
    hit = F.col("d.step_delta").isNotNull() | F.col("d.last_reading_at").isNotNull()
    return j.select(
        "patient_no", "summary_date",
        (F.coalesce(F.col("s.step_count"), F.lit(0)) + F.coalesce(F.col("d.step_delta"), F.lit(0)))
        .cast("bigint").alias("step_count"),
        F.coalesce(F.col("s.step_goal"), F.lit(1000)).alias("step_goal"),
        F.when(hit, F.col("d.sleep_hours")).otherwise(F.col("s.sleep_hours")).alias("sleep_hours"),
        F.when(hit, F.col("d.stress_level")).otherwise(F.col("s.stress_level")).alias("stress_level"),
        F.when(hit, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("s.synced_to_mysql_at"))
        .alias("synced_to_mysql_at"),
        F.coalesce(F.col("s.created_date"), now).alias("created_date"),
        F.when(hit, now).otherwise(F.col("s.last_modified_date")).alias("last_modified_date"),
        F.when(hit, F.lit(ETL_TAG)).otherwise(F.col("s.intt_cd")).alias("intt_cd"))


# ---- encounter fan-out ---------------------------------------------------
def encounter_fanout(encounters: DataFrame, as_of_ts, key_base: DataFrame | None = None,
                     department: DataFrame | None = None, min_encounters: int = 2) -> DataFrame:
    """One finished encounter (patient_no, status COMPLETED|CANCELLED) →
    check-in, treatment, out-treatment and prescription rows, as one long
    frame (``record_type``).  Status cascades COMPLETED → DISPENSED, else
    CANCELLED; comments are NULL for completed ones.  Ids are dense after
    the current maximum (``key_base``); the department is the newest one.
    A batch with fewer than ``min_encounters`` rows is refused (bounded probe)."""
    if min_encounters and encounters.limit(min_encounters).count() < min_encounters:
        raise ValueError(f"completion batch needs at least {min_encounters} encounters")
    now = as_datetime(as_of_ts)
    suffix = now.strftime("%Y%m%d%H%M%S")
    keyed = assign_keys(encounters, ["patient_no"], "enc_key", existing_max=key_base)
    if department is not None:
        # one-row frame joined on a constant key
        newest = department.agg(F.max("id").alias("department_id")).withColumn("__k", F.lit(1))
        keyed = keyed.withColumn("__k", F.lit(1)).join(bounded_broadcast(newest), "__k").drop("__k")
    else:
        keyed = keyed.withColumn("department_id", F.lit(None).cast("bigint"))
    st = F.col("status")
    done = st == "COMPLETED"
    recs = F.array(
        F.struct(F.lit("check_in").alias("record_type"), st.alias("status"),
                 F.lit(f"pipeline-{suffix}").alias("comment")),
        F.struct(F.lit("treatment").alias("record_type"), st.alias("status"),
                 F.lit(f"completion-{suffix}").alias("comment")),
        F.struct(F.lit("out_treatment").alias("record_type"), st.alias("status"),
                 F.when(done, F.lit(None).cast("string")).otherwise(F.lit(f"종료-{suffix}")).alias("comment")),
        F.struct(F.lit("prescription").alias("record_type"),
                 F.when(done, F.lit("DISPENSED")).otherwise(F.lit("CANCELLED")).alias("status"),
                 F.when(done, F.lit(None).cast("string")).otherwise(F.lit(f"실패 취소-{suffix}")).alias("comment")),
    )
    return keyed.select(
        "patient_no", F.col("enc_key").alias("treatment_id"), F.col("enc_key").alias("checkIn_id"),
        "department_id",
        F.explode(recs).alias("r"), ts_lit(now).alias("created_date"),
    ).select("patient_no", "treatment_id", "checkIn_id", "department_id",
             "r.record_type", "r.status", "r.comment", "created_date")


DOCTOR_ID = 900001  # Fixed values of the completion batch: its doctor, type and system code.
PIPELINE_TAG = "PIPELINE"
COMPLETED_PERCENT = 70


def newest_encounters(patients: DataFrame, n: int, status: Column | None = None) -> DataFrame:
    """(patient_no, status) of the ``n`` newest patients.  Top-n: every task keeps n rows, none are shuffled but
    those.  Without a ``status`` about 70 of 100 are COMPLETED, by a hash of the patient number."""
    share = F.pmod(F.xxhash64("patient_no"), F.lit(100)) < COMPLETED_PERCENT
    status = F.when(share, "COMPLETED").otherwise("CANCELLED") if status is None else status
    return patients.orderBy(F.col("patient_no").desc_nulls_last()).limit(max(0, int(n))).select(
        "patient_no", status.alias("status"))


def completion_batch(encounters: DataFrame, as_of_ts, check_ins: DataFrame, treatments: DataFrame,
                     prescriptions: DataFrame, department: DataFrame, intt_cd: str = PIPELINE_TAG) -> dict[str, DataFrame]:
    """The rows one completion run writes, per table, with all their columns.

    Check-in, treatment and prescription ids go on from each table's own maximum, newest patient first.  The
    department is the newest one; completed encounters have no comments, cancelled ones say so, and their
    prescriptions are CANCELLED instead of DISPENSED."""
    now = as_datetime(as_of_ts)
    suffix = now.strftime("%Y%m%d%H%M%S")
    at, none = ts_lit(now), F.lit(None)
    keyed = assign_keys(encounters.withColumn("__newest", -F.col("patient_no")), ["__newest"], "__i", floor=0)
    # one row of the current maxima, joined on a constant key
    tops = [t.agg(F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(name)).withColumn("__k", F.lit(1)) for t, c, name in (
        (check_ins, "checkIn_id", "__c"), (treatments, "treatment_id", "__t"), (prescriptions, "prescription_id", "__p"))]
    tops.append(department.agg(F.max("id").alias("department_id")).withColumn("__k", F.lit(1)))
    keyed = keyed.withColumn("__k", F.lit(1))
    for top in tops:
        keyed = keyed.join(bounded_broadcast(top), "__k")
    done = F.col("status") == "COMPLETED"
    said = lambda text: F.when(~done, F.lit(f"{text}-{suffix}"))  # noqa: E731 - completed: no comment
    rows = keyed.select("patient_no", "status", "department_id", (F.col("__c") + F.col("__i")).alias("checkIn_id"),
                        (F.col("__t") + F.col("__i")).alias("treatment_id"),
                        (F.col("__p") + F.col("__i")).alias("prescription_id"))
    stamps = [at.alias("created_date"), at.alias("last_modified_date"), F.lit(intt_cd).alias("intt_cd")]
    return {
        "check_in": rows.select("checkIn_id", "patient_no", none.cast("bigint").alias("user_id"), at.alias("checkIn_date"),
                                F.col("status").alias("checkIn_status"), F.lit(f"pipeline-{suffix}").alias("checkIn_comment"),
                                *stamps),
        "treatments": rows.select(
            "treatment_id", "checkIn_id", "patient_no", F.lit(DOCTOR_ID).cast("bigint").alias("treatment_doc"), "department_id",
            F.lit(DEFAULT_CATEGORY).alias("treatment_type"), F.col("status").alias("treatment_status"),
            at.alias("treatment_date"), at.alias("treatment_start_time"), at.alias("treatment_end_time"),
            F.lit(f"completion-{suffix}").alias("treatment_comment"), none.cast("string").alias("treatment_dept"), *stamps),
        "Out_Treatments": rows.select(
            "treatment_id", "checkIn_id", F.col("status").alias("treatment_status"),
            none.cast("bigint").alias("pre_treatment_id"), said("종료").alias("treatment_comment"), *stamps),
        "Prescription": rows.select(
            "prescription_id", "treatment_id", "patient_no", F.lit(DOCTOR_ID).cast("bigint").alias("prescription_doc"),
            at.alias("prescription_date"), F.when(done, "DISPENSED").otherwise("CANCELLED").alias("prescription_status"),
            F.lit(DEFAULT_CATEGORY).alias("prescription_type"), said("실패 취소").alias("prescription_memo"), *stamps),
    }


def encounter_counts(encounters: DataFrame) -> DataFrame:
    """Completed / cancelled counts of one fan-out batch."""
    return encounters.agg(F.count_if(F.col("status") == "COMPLETED").alias("completed_count"),
                          F.count_if(F.col("status") == "CANCELLED").alias("cancelled_count"),
                          F.count(F.lit(1)).alias("completion_rows"))
