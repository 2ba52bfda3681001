"""Query registry: key → callable(spark, sf_dir) → DataFrame.

Each entry binds the logical views onto the driver's parquet tables, runs
one library operator over the whole tables, and returns the (lazy) result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinops.functions import display, labels
from clinops.operators import identifiers, ledger, metrics, patient, profile, sync, upsert, vitals
from clinops.operators.mask import sanitize
from clinops.plans import profiles, snapshot
from clinops.session import ensure_checkpoint_dir
from clinops.sources.tables import (
    OPS_AS_OF, OPS_TABLES, PG_TABLES, VIEWS, WEAR_AS_OF_TS, daily_wellness_view, load_view, raw, view_as_of,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(key: str):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = fn
        return fn
    return deco


def _v(spark: SparkSession, sf_dir: str, *names: str):
    frames = [load_view(spark, sf_dir, n) for n in names]
    return frames[0] if len(frames) == 1 else frames


# ---- operations metrics ----------------------------------------------------
@register("timeline")
def q_timeline(spark, sf_dir):
    return metrics.timeline(_v(spark, sf_dir, "treatments"), OPS_AS_OF, months=12)


@register("gauge")
def q_gauge(spark, sf_dir):
    return metrics.gauge(_v(spark, sf_dir, "treatments"), OPS_AS_OF)


@register("treatment_mix")
def q_treatment_mix(spark, sf_dir):
    return metrics.treatment_mix(_v(spark, sf_dir, "treatments"))


@register("treatment_mix_share")
def q_treatment_mix_share(spark, sf_dir):
    return metrics.treatment_mix_share(_v(spark, sf_dir, "treatments"))


@register("treatment_mix_folded")
def q_treatment_mix_folded(spark, sf_dir):
    t = _v(spark, sf_dir, "treatments").withColumn("treatment_type", F.expr(
        "CASE treatment_id % 4 WHEN 0 THEN lower(treatment_type) WHEN 1 THEN replace(treatment_type, 'E', 'É') "
        "WHEN 2 THEN initcap(treatment_type) ELSE treatment_type END"))
    return metrics.treatment_mix_folded(t)


@register("production_top")
def q_production_top(spark, sf_dir):
    dept, tr = _v(spark, sf_dir, "department", "treatments")
    return metrics.production_top(dept, tr, n=3)


@register("league_table")
def q_league_table(spark, sf_dir):
    dept, tr = _v(spark, sf_dir, "department", "treatments")
    return metrics.league_rows(metrics.league_table(dept, tr, OPS_AS_OF, n=5, months=6))


@register("league_ranked")
def q_league_ranked(spark, sf_dir):
    dept, tr = _v(spark, sf_dir, "department", "treatments")
    return metrics.league_ranked(metrics.league_table(dept, tr, OPS_AS_OF, n=5, months=6))


@register("kpi_revenue")
def q_kpi_revenue(spark, sf_dir):
    sched, exam = _v(spark, sf_dir, "examination_schedule", "examination")
    return metrics.kpi_revenue(sched, exam)


@register("kpi_growth")
def q_kpi_growth(spark, sf_dir):
    return metrics.kpi_growth(_v(spark, sf_dir, "treatments"), OPS_AS_OF)


# ---- masking / labels / display -------------------------------------------

@register("mask_customers")
def q_mask_customers(spark, sf_dir):
    p = _v(spark, sf_dir, "Patient")
    return sanitize(p.select("patient_no", "patient_name", "patient_gender", "patient_foreign",
                             "created_date", "intt_cd"))


@register("mask_contact")
def q_mask_contact(spark, sf_dir):
    p = _v(spark, sf_dir, "Patient")
    return sanitize(p.select("patient_no", "patient_rrn", "patient_email", "patient_tel",
                             "patient_address", "patient_passport", "patient_birth",
                             F.col("patient_birth").cast("string").alias("patient_birth_text")))


@register("mask_ids")
def q_mask_ids(spark, sf_dir):
    t = _v(spark, sf_dir, "treatments")
    return sanitize(t.select("treatment_id", "patient_no", "treatment_doc", "department_id"))


@register("mask_text_columns")
def q_mask_text_columns(spark, sf_dir):
    t = _v(spark, sf_dir, "treatments")
    return sanitize(t.select(
        "treatment_id", "treatment_comment",
        F.concat(F.lit("C-"), F.col("treatment_id").cast("string")).alias("certificate_number"),
        F.col("treatment_dept").alias("prescription_memo"),
        F.col("treatment_type").alias("clinical_findings")))


@register("mask_events")
def q_mask_events(spark, sf_dir):
    return sanitize(_v(spark, sf_dir, "patient_clinical_event"), profile="wearable")


@register("label_codes")
def q_label_codes(spark, sf_dir):
    e = _v(spark, sf_dir, "patient_clinical_event")
    return e.select("clinical_event_id", "category", labels.category_label(F.col("category")).alias("category_kr"),
                    "status", labels.status_label(F.col("status")).alias("status_kr"))


@register("translate_values")
def q_translate_values(spark, sf_dir):
    t = _v(spark, sf_dir, "treatments").select("treatment_id", "treatment_status", "treatment_type", "intt_cd")
    return labels.translate_values(t, ["treatment_status", "treatment_type", "intt_cd"])


ISO_TEXT = ("CASE WHEN event_id % 5 = 0 THEN concat('Tx-', event_type) "
            "ELSE concat(CAST(CAST(ts AS DATE) AS STRING), 'T', lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', "
            "lpad(CAST(minute(ts) AS STRING), 2, '0'), ':', lpad(CAST(second(ts) AS STRING), 2, '0'), "
            "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+09:00' END) END")


@register("format_datetimes")
def q_format_datetimes(spark, sf_dir):
    ev = raw(spark, sf_dir, "events").selectExpr("event_id", "ts", "CAST(ts AS DATE) AS d", f"{ISO_TEXT} AS iso_text")
    return ev.select("event_id",
                     display.format_datetime(F.col("ts"), ev.schema["ts"].dataType).alias("ts_kr"),
                     display.format_datetime(F.col("d"), ev.schema["d"].dataType).alias("d_kr"),
                     display.format_iso_text(F.col("iso_text")).alias("iso_kr"))


@register("format_odd_values")
def q_format_odd_values(spark, sf_dir):
    """Text that only looks like a date, and decimals far from 1, made of the events' own values."""
    odd = raw(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_id % 9 WHEN 0 THEN concat(CAST(CAST(ts AS DATE) AS STRING), 'T10:00:99') "
        "WHEN 1 THEN concat(CAST(CAST(ts AS DATE) AS STRING), 'T10:00+99:99') "
        "WHEN 2 THEN concat(CAST(CAST(ts AS DATE) AS STRING), ' 10:00|Tab') "
        "WHEN 3 THEN concat(CAST(CAST(ts AS DATE) AS STRING), 'T23:30:00.123456-05:30') "
        "WHEN 4 THEN concat(CAST(CAST(ts AS DATE) AS STRING), 'T24:00') "
        "WHEN 5 THEN '2024-02-30T10:00' WHEN 6 THEN concat(event_type, 'T|') WHEN 7 THEN '' END AS t",
        "CAST(CAST(12345678 + event_id AS DECIMAL(12,0)) + CAST(event_id % 100 AS DECIMAL(12,0)) / 100 AS DECIMAL(16,2)) AS big",
        "CAST(CAST(event_id % 1000 AS DECIMAL(12,0)) / 1000000 AS DECIMAL(10,7)) AS small")
    return odd.select("event_id", display.format_iso_text(F.col("t")).alias("iso_kr"),
                      display.decimal_display(F.col("big")).alias("big"),
                      display.decimal_display(F.col("small")).alias("small"))


@register("format_cells")
def q_format_cells(spark, sf_dir):
    e = _v(spark, sf_dir, "examination")
    return display.format_cells(e.select("examination_id", "examination_name", "examination_price", "created_date"))


# ---- table profiles ----------------------------------------------------------
OPS_BOUND = [n for n, _ in OPS_TABLES if n in VIEWS]
OPS_CAPTIONS = dict(OPS_TABLES)


def _ops_tables(spark, sf_dir):
    return {n: (load_view(spark, sf_dir, n), view_as_of(n)) for n in OPS_BOUND}


@register("table_stats")
def q_table_stats(spark, sf_dir):
    return profiles.bound_table_stats(spark, sf_dir, OPS_BOUND, OPS_CAPTIONS, [n for n, _ in OPS_TABLES])


@register("table_daily_trend")
def q_table_daily_trend(spark, sf_dir):
    return profiles.bound_daily_trend(spark, sf_dir, OPS_BOUND)


@register("table_counts")
def q_table_counts(spark, sf_dir):
    return profiles.bound_table_counts(spark, sf_dir, list(PG_TABLES))


SEARCH_QUERY, SEARCH_PAGE = " A ", 2


@register("table_search")
def q_table_search(spark, sf_dir):
    return profile.table_search(q_table_stats(spark, sf_dir), SEARCH_QUERY, SEARCH_PAGE)


@register("table_recent_rows")
def q_table_recent_rows(spark, sf_dir):
    return profile.table_recent_rows(_v(spark, sf_dir, "treatments"), key="treatment_id", n=20)


# ---- wearable side -----------------------------------------------------------
@register("vitals_aggregate")
def q_vitals_aggregate(spark, sf_dir):
    v, d = _v(spark, sf_dir, "user_vital_measurement", "user_daily_wellness")
    return vitals.vitals_aggregate(v, d, WEAR_AS_OF_TS)


@register("pending_sync")
def q_pending_sync(spark, sf_dir):
    return vitals.pending_sync(_v(spark, sf_dir, "user_vital_measurement"))


@register("recent_vitals")
def q_recent_vitals(spark, sf_dir):
    return vitals.recent_vitals(_v(spark, sf_dir, "user_vital_measurement"), 12)


@register("recent_events")
def q_recent_events(spark, sf_dir):
    return vitals.recent_events(_v(spark, sf_dir, "patient_clinical_event"), 15)


@register("recent_wellness")
def q_recent_wellness(spark, sf_dir):
    return vitals.recent_wellness(_v(spark, sf_dir, "user_daily_wellness"), 10)


@register("clinical_by_category")
def q_clinical_by_category(spark, sf_dir):
    return vitals.clinical_by_category(_v(spark, sf_dir, "patient_clinical_event"))


@register("etl_state")
def q_etl_state(spark, sf_dir):
    return vitals.etl_state(_v(spark, sf_dir, "etl_runtime_state"))


@register("latest_vitals")
def q_latest_vitals(spark, sf_dir):
    return vitals.latest_vitals(_v(spark, sf_dir, "user_vital_measurement"))


@register("hourly_hr_sliding")
def q_hourly_hr_sliding(spark, sf_dir):
    return vitals.hourly_hr_sliding(_v(spark, sf_dir, "user_vital_measurement"))


@register("vitals_long")
def q_vitals_long(spark, sf_dir):
    return vitals.vitals_long(_v(spark, sf_dir, "user_vital_measurement"))


# ---- patient -----------------------------------------------------------------
def lookup_requests(spark, sf_dir):
    """Identifier lookups derived from the customer table (one per patient):
    valid ids, app ids, emails, padded phone numbers and unparsable ids."""
    return raw(spark, sf_dir, "customer").selectExpr(
        "CASE c_custkey % 5 WHEN 0 THEN 'patient_no' WHEN 1 THEN 'app_user_id' WHEN 2 THEN 'email' "
        "WHEN 3 THEN 'tel' ELSE 'patient_no' END AS by",
        "CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS STRING) "
        "WHEN 1 THEN concat('U', CAST(c_custkey AS STRING)) "
        "WHEN 2 THEN CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 45 = 0 THEN '@clinic.example' "
        "ELSE concat(lower(c_mktsegment), CAST(c_custkey AS STRING), '@clinic.example') END "
        "WHEN 3 THEN concat(' ', '010-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '-', "
        "lpad(CAST((c_custkey * 31) % 10000 AS STRING), 4, '0'), ' ') "
        "ELSE concat('x', CAST(c_custkey AS STRING)) END AS value")


@register("resolve_patient_indexed")
def q_resolve_patient_indexed(spark, sf_dir):
    """The same requests answered from an identifier index written for them."""
    p, pr = _v(spark, sf_dir, "Patient", "user_app_profile")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/identifiers-{uuid.uuid4().hex}"
    identifiers.build_index(p, pr, path, 32)
    return identifiers.resolve_indexed(lookup_requests(spark, sf_dir), path, 32)


@register("resolve_patient")
def q_resolve_patient(spark, sf_dir):
    p, pr = _v(spark, sf_dir, "Patient", "user_app_profile")
    return patient.resolve_patient(lookup_requests(spark, sf_dir), p, pr)


@register("patient_card")
def q_patient_card(spark, sf_dir):
    p, pr = _v(spark, sf_dir, "Patient", "user_app_profile")
    return patient.patient_card(p, pr)


@register("patient_360")
def q_patient_360(spark, sf_dir):
    p, pr, dis, ev, vt, dw = _v(spark, sf_dir, "Patient", "user_app_profile", "disability",
                                "patient_clinical_event", "user_vital_measurement", "user_daily_wellness")
    return patient.patient_360(p, pr, dis, ev, vt, dw, WEAR_AS_OF_TS)


@register("patient_events")
def q_patient_events(spark, sf_dir):
    return patient.patient_events(_v(spark, sf_dir, "patient_clinical_event"))


# ---- upsert family / sync ----------------------------------------------------
def ops_patient_target(spark, sf_dir):
    """Operations-side patient copy: an older, partial state of the master."""
    p = _v(spark, sf_dir, "Patient")
    return (p.where(F.col("patient_no") % 3 != 2)
            .withColumn("patient_name", F.lower("patient_name"))
            .withColumn("patient_address", F.lit("OLD"))
            .withColumn("patient_tel", F.lit("000-0000-0000"))
            .withColumn("patient_last_visit", F.lit(None).cast("timestamp_ntz"))
            .withColumn("guardian", F.lit("OLD"))
            .withColumn("last_modified_date", F.col("created_date")))


@register("upsert_patients")
def q_upsert_patients(spark, sf_dir):
    return sync.upsert_patients(ops_patient_target(spark, sf_dir), _v(spark, sf_dir, "Patient"))


@register("upsert_profiles")
def q_upsert_profiles(spark, sf_dir):
    pr = _v(spark, sf_dir, "user_app_profile")
    tgt = (pr.where(F.col("patient_no") % 4 == 0).withColumn("blood_type", F.lit("UNKNOWN"))
           .withColumn("app_user_id", F.lit("OLD")).withColumn("intt_cd", F.lit("MYSQL")))
    return sync.upsert_profiles(tgt, pr)


@register("insert_if_absent")
def q_insert_if_absent(spark, sf_dir):
    t = _v(spark, sf_dir, "treatments").select("treatment_id", "patient_no", "treatment_type", "intt_cd")
    # target: the earlier state of the table (even ids); incoming rows: the whole table
    return upsert.insert_if_absent(t.where(F.col("treatment_id") % 2 == 0), t, ["treatment_id"])


@register("delete_where")
def q_delete_where(spark, sf_dir):
    t = _v(spark, sf_dir, "treatments").select("treatment_id", "treatment_status", "intt_cd")
    return upsert.delete_where(t, (F.col("treatment_status") == "CANCELLED") & (F.col("intt_cd") == "HQ"))


@register("append_rows")
def q_append_rows(spark, sf_dir):
    t = _v(spark, sf_dir, "treatments")
    old = t.where(F.col("treatment_date") < F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).select(
        "treatment_id", "patient_no", "treatment_date", "treatment_comment")
    new = t.where(F.col("treatment_date") >= F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).select(
        "treatment_id", "patient_no", "treatment_date")
    return upsert.append_rows(old, new)


@register("evolve_schema")
def q_evolve_schema(spark, sf_dir):
    p = _v(spark, sf_dir, "Patient").select("patient_no", "patient_gender", "intt_cd")
    old = p.where(F.col("patient_no") % 10 != 0)
    new = upsert.add_columns_if_absent(p.where(F.col("patient_no") % 10 == 0), {"patient_hypass_YN": "string"})
    new = new.withColumn("patient_hypass_YN", F.when(F.col("patient_no") % 20 == 0, "Y").otherwise("N"))
    return upsert.evolve_schema(old, new)


@register("assign_keys")
def q_assign_keys(spark, sf_dir):
    p, t = _v(spark, sf_dir, "Patient", "treatments")
    batch = p.select("patient_no", "patient_name")
    return upsert.assign_keys(batch, ["patient_no"], "treatment_id",
                              existing_max=t.agg(F.max("treatment_id")))


def ops_vital_target(spark, sf_dir):
    v = _v(spark, sf_dir, "user_vital_measurement")
    part = v.where((F.col("vital_id") % 6 == 1) | (F.col("vital_id") % 9 == 0))
    return sync.vital_copy_rows(part, WEAR_AS_OF_TS)


def _vitals_run(spark, sf_dir):
    return sync.sync_vitals(_v(spark, sf_dir, "user_vital_measurement"), ops_vital_target(spark, sf_dir),
                            WEAR_AS_OF_TS)


@register("sync_vitals")
def q_sync_vitals(spark, sf_dir):
    return _vitals_run(spark, sf_dir)["inserted"]


@register("mark_synced")
def q_mark_synced(spark, sf_dir):
    return _vitals_run(spark, sf_dir)["marked"].select("vital_id", "synced_to_mysql_at")


def ops_daily_target(spark, sf_dir):
    d = _v(spark, sf_dir, "user_daily_wellness")
    part = d.where(F.col("patient_no") % 3 == 0).withColumn("step_count", F.col("step_count") - 1)
    return sync.daily_copy_rows(part, WEAR_AS_OF_TS)


@register("sync_daily")
def q_sync_daily(spark, sf_dir):
    return sync.sync_daily(_v(spark, sf_dir, "user_daily_wellness"), ops_daily_target(spark, sf_dir),
                           WEAR_AS_OF_TS)


def _treat_run(spark, sf_dir, assign_ids=True):
    t, e = _v(spark, sf_dir, "treatments", "patient_clinical_event")
    return sync.sync_treatments(t, e, WEAR_AS_OF_TS, assign_ids=assign_ids)


@register("sync_treatments")
def q_sync_treatments(spark, sf_dir):
    return _treat_run(spark, sf_dir)["inserted"]


@register("mark_treatments")
def q_mark_treatments(spark, sf_dir):
    return _treat_run(spark, sf_dir, assign_ids=False)["marked"].select(
        "treatment_id", "synced_to_postgres_at", "last_modified_date")


@register("mark_daily")
def q_mark_daily(spark, sf_dir):
    return sync.mark_daily(_v(spark, sf_dir, "user_daily_wellness"), WEAR_AS_OF_TS).select(
        "patient_no", "summary_date", "synced_to_mysql_at")


@register("sync_stats")
def q_sync_stats(spark, sf_dir):
    vr, tr = _vitals_run(spark, sf_dir), _treat_run(spark, sf_dir, assign_ids=False)
    return sync.sync_stats(vr["outcomes"], tr["outcomes"], q_sync_daily(spark, sf_dir), q_upsert_patients(spark, sf_dir),
                           q_upsert_profiles(spark, sf_dir), vr["rejected"])


@register("sync_stats_checked")
def q_sync_stats_checked(spark, sf_dir):
    """Counters of the vitals run when it refuses bad readings: rejected ones are errors and stay unmarked."""
    v = _v(spark, sf_dir, "user_vital_measurement")
    run = sync.sync_vitals(v, ops_vital_target(spark, sf_dir), WEAR_AS_OF_TS, rules=sync.vital_rules())
    left = run["marked"].agg(F.count_if(F.col("synced_to_mysql_at").isNull()).alias("still_pending"))
    seen = run["outcomes"].agg(F.count(F.lit(1)).alias("vitals_examined"),
                               F.count_if(F.col("outcome") == "inserted").alias("vitals_copied"),
                               F.count_if(F.col("outcome") == "duplicate").alias("vitals_duplicate"),
                               F.count_if(F.col("outcome") == "rejected").alias("errors"))
    return seen.withColumn("__k", F.lit(1)).join(left.withColumn("__k", F.lit(1)), "__k").drop("__k")


@register("sync_quarantine")
def q_sync_quarantine(spark, sf_dir):
    v = _v(spark, sf_dir, "user_vital_measurement")
    batch = sync.vital_copy_rows(sync.pending(v, "synced_to_mysql_at", ["vital_id"]), WEAR_AS_OF_TS)
    return sync.quarantine(batch)[1].select("vital_id", "patient_no", "reason")


@register("daily_wellness_rollup")
def q_daily_wellness_rollup(spark, sf_dir):
    inc = _v(spark, sf_dir, "wellness_increment")
    stored = daily_wellness_view(inc.where(F.col("event_id") % 2 == 0))
    return sync.daily_wellness_rollup(stored, inc.where(F.col("event_id") % 2 == 1), WEAR_AS_OF_TS)


def _encounters(spark, sf_dir):
    p = _v(spark, sf_dir, "Patient")
    return p.select("patient_no", F.when(F.col("patient_no") % 10 < 7, "COMPLETED")
                    .otherwise("CANCELLED").alias("status"))


@register("encounter_fanout")
def q_encounter_fanout(spark, sf_dir):
    t, d = _v(spark, sf_dir, "treatments", "department")
    return sync.encounter_fanout(_encounters(spark, sf_dir), WEAR_AS_OF_TS,
                                 key_base=t.agg(F.max("treatment_id")), department=d)


def _completion(spark, sf_dir):
    p, c, t, rx, d = _v(spark, sf_dir, "Patient", "check_in", "treatments", "Prescription", "department")
    status = F.when(F.col("patient_no") % 10 < 7, "COMPLETED").otherwise("CANCELLED")
    newest = sync.newest_encounters(p, 100, status)  # the newest 100 patients are what one run completes
    return sync.completion_batch(newest, WEAR_AS_OF_TS, c, t, rx, d)


@register("completion_check_ins")
def q_completion_check_ins(spark, sf_dir):
    return _completion(spark, sf_dir)["check_in"]


@register("completion_treatments")
def q_completion_treatments(spark, sf_dir):
    return _completion(spark, sf_dir)["treatments"]


@register("completion_out_treatments")
def q_completion_out_treatments(spark, sf_dir):
    return _completion(spark, sf_dir)["Out_Treatments"]


@register("completion_prescriptions")
def q_completion_prescriptions(spark, sf_dir):
    return _completion(spark, sf_dir)["Prescription"]


@register("encounter_counts")
def q_encounter_counts(spark, sf_dir):
    return sync.encounter_counts(_encounters(spark, sf_dir))


# ---- ledger ----------------------------------------------------------------
@register("ledger_state")
def q_ledger_state(spark, sf_dir):
    return ledger.ledger_state(ledger.transitions(_v(spark, sf_dir, "batch_job_log")))


@register("ledger_backoff")
def q_ledger_backoff(spark, sf_dir):
    return ledger.ledger_backoff(_v(spark, sf_dir, "batch_job_log"))


@register("ledger_due_retries")
def q_ledger_due_retries(spark, sf_dir):
    return ledger.ledger_due_retries(_v(spark, sf_dir, "batch_job_log"), WEAR_AS_OF_TS, limit=10)


@register("ledger_recent")
def q_ledger_recent(spark, sf_dir):
    return ledger.ledger_recent(_v(spark, sf_dir, "batch_job_log"), limit=50, status="failed")


@register("ledger_retry_plan")
def q_ledger_retry_plan(spark, sf_dir):
    return ledger.ledger_retry_plan(_v(spark, sf_dir, "batch_job_log"), WEAR_AS_OF_TS, limit=10)


@register("ledger_payload_json")
def q_ledger_payload_json(spark, sf_dir):
    return ledger.ledger_payload_fields(_v(spark, sf_dir, "batch_job_log"))


# ---- composite snapshots ---------------------------------------------------


def _operations_snapshot(spark, sf_dir):
    dept, tr, sched, exam = _v(spark, sf_dir, "department", "treatments", "examination_schedule", "examination")
    return snapshot.operations_snapshot(dept, tr, sched, exam, OPS_AS_OF)


def _wearable_snapshot(spark, sf_dir):
    return snapshot.wearable_snapshot(spark, lambda n: load_view(spark, sf_dir, n), WEAR_AS_OF_TS,
                                      table_counts=profiles.bound_table_counts(spark, sf_dir, list(PG_TABLES)))


@register("snapshot_json")
def q_snapshot_json(spark, sf_dir):
    return snapshot.to_json_row(_operations_snapshot(spark, sf_dir))


@register("snapshot_cells")
def q_snapshot_cells(spark, sf_dir):
    return snapshot.snapshot_cells(_operations_snapshot(spark, sf_dir))


@register("wearable_snapshot")
def q_wearable_snapshot(spark, sf_dir):
    return snapshot.to_json_row(_wearable_snapshot(spark, sf_dir))


@register("wearable_snapshot_cells")
def q_wearable_snapshot_cells(spark, sf_dir):
    return snapshot.snapshot_cells(_wearable_snapshot(spark, sf_dir))


@register("wearable_kpi_cards")
def q_wearable_kpi_cards(spark, sf_dir):
    v, d = _v(spark, sf_dir, "user_vital_measurement", "user_daily_wellness")
    counts = profiles.bound_table_counts(spark, sf_dir, list(PG_TABLES))
    return profile.kpi_cards(counts, vitals.vitals_aggregate(v, d, WEAR_AS_OF_TS))


@register("ledger_retry_cycle")
def q_ledger_retry_cycle(spark, sf_dir):
    return ledger.ledger_retry_cycle(_v(spark, sf_dir, "batch_job_log"), WEAR_AS_OF_TS, limit=10)


@register("my_health")
def q_my_health(spark, sf_dir):
    p, pr, dis, ev, vt, dw = _v(spark, sf_dir, "Patient", "user_app_profile", "disability",
                                "patient_clinical_event", "user_vital_measurement", "user_daily_wellness")
    return patient.my_health(lookup_requests(spark, sf_dir), p, pr, dis, ev, vt, dw, WEAR_AS_OF_TS)


@register("my_health_events")
def q_my_health_events(spark, sf_dir):
    p, pr, ev = _v(spark, sf_dir, "Patient", "user_app_profile", "patient_clinical_event")
    return patient.my_health_events(lookup_requests(spark, sf_dir), p, pr, ev)


@register("my_health_categories")
def q_my_health_categories(spark, sf_dir):
    p, pr, ev = _v(spark, sf_dir, "Patient", "user_app_profile", "patient_clinical_event")
    out = patient.my_health_categories(lookup_requests(spark, sf_dir), p, pr, ev, k=5)
    by = F.to_json("clinical_events_by_category", {"ignoreNullFields": "false"})
    return out.withColumn("clinical_events_by_category", by)


@register("newest_events")
def q_newest_events(spark, sf_dir):
    top = patient.newest_events(_v(spark, sf_dir, "patient_clinical_event"), 5)
    return top.select("patient_no", "category", "rank", "clinical_event_id", "occurred_on", "title")


@register("ledger_finish")
def q_ledger_finish(spark, sf_dir):
    log = _v(spark, sf_dir, "batch_job_log")
    ended = log.where(F.col("status") == "RUNNING").select(
        "batch_log_id",
        F.when(F.col("batch_log_id") % 2 == 0, F.struct(F.col("job_name").alias("job"), F.lit("완료").alias("note"),
                                                        F.lit(None).cast("string").alias("suffix"))).alias("result"),
        F.when(F.col("batch_log_id") % 2 == 1, F.concat(F.lit("  실패 "), F.col("job_name"), F.lit("  "))).alias("error"))
    out = ledger.finished_rows(log, ended, WEAR_AS_OF_TS)
    return out.select("batch_log_id", "status", "finished_at", "next_retry_at", "result_payload", "error_message",
                      "last_modified_date")


@register("mask_institutions")
def q_mask_institutions(spark, sf_dir):
    return sanitize(_v(spark, sf_dir, "health_checkup_institution"))


@register("mask_certificates")
def q_mask_certificates(spark, sf_dir):
    return sanitize(_v(spark, sf_dir, "diagnosis_certificate"))
