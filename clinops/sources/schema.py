"""Declared schemas of the bound logical tables, as Spark reads them.

A test pins every binding to these, so a change in a binding expression
that alters a column type is caught before it reaches a query.
"""

from pyspark.sql import types as T

_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType()


def _dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


SCHEMAS: dict[str, T.StructType] = {
    "department": T.StructType([
        T.StructField("id", _L),
        T.StructField("department_code", _S),
        T.StructField("department_name", _S),
        T.StructField("department_type", _S),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "Patient": T.StructType([
        T.StructField("patient_no", _L),
        T.StructField("patient_name", _S),
        T.StructField("patient_rrn", _S),
        T.StructField("patient_gender", _S),
        T.StructField("patient_birth", _D),
        T.StructField("patient_address", _S),
        T.StructField("patient_email", _S),
        T.StructField("patient_tel", _S),
        T.StructField("patient_foreign", _S),
        T.StructField("patient_passport", _S),
        T.StructField("patient_hypass_YN", _S),
        T.StructField("patient_last_visit", _TS),
        T.StructField("guardian", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "treatments": T.StructType([
        T.StructField("treatment_id", _L),
        T.StructField("checkIn_id", _L),
        T.StructField("patient_no", _L),
        T.StructField("treatment_doc", _L),
        T.StructField("department_id", _L),
        T.StructField("treatment_type", _S),
        T.StructField("treatment_status", _S),
        T.StructField("treatment_date", _TS),
        T.StructField("treatment_comment", _S),
        T.StructField("treatment_dept", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
        T.StructField("synced_to_postgres_at", _TS),
    ]),
    "examination": T.StructType([
        T.StructField("examination_id", _L),
        T.StructField("examination_name", _S),
        T.StructField("examination_type", _S),
        T.StructField("examination_price", _dec(18, 2)),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "kcd_code": T.StructType([
        T.StructField("id", _L),
        T.StructField("code", _S),
        T.StructField("name_korean", _S),
        T.StructField("name_english", _S),
        T.StructField("category", _S),
        T.StructField("active", _I),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "inpatient_statistics": T.StructType([
        T.StructField("statistics_id", _L),
        T.StructField("statistics_year", _S),
        T.StructField("region_code", _S),
        T.StructField("visit_days", _L),
        T.StructField("benefit_days", _L),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "treatment_department_statistics": T.StructType([
        T.StructField("statistics_id", _L),
        T.StructField("statistics_year", _S),
        T.StructField("region_code", _S),
        T.StructField("department_name", _S),
        T.StructField("patient_count", _L),
        T.StructField("treatment_count", _L),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "examination_schedule": T.StructType([
        T.StructField("examination_schedule_id", _L),
        T.StructField("examination_id", _L),
        T.StructField("treatment_id", _L),
        T.StructField("examination_date", _D),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "check_in": T.StructType([
        T.StructField("checkIn_id", _L),
        T.StructField("patient_no", _L),
        T.StructField("user_id", _L),
        T.StructField("checkIn_date", _TS),
        T.StructField("checkIn_status", _S),
        T.StructField("checkIn_comment", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "Prescription": T.StructType([
        T.StructField("prescription_id", _L),
        T.StructField("treatment_id", _L),
        T.StructField("patient_no", _L),
        T.StructField("prescription_doc", _L),
        T.StructField("prescription_date", _TS),
        T.StructField("prescription_status", _S),
        T.StructField("prescription_type", _S),
        T.StructField("prescription_memo", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "Prescription_Item": T.StructType([
        T.StructField("prescription_item_id", _L),
        T.StructField("prescription_id", _L),
        T.StructField("drug_code", _S),
        T.StructField("drug_name", _S),
        T.StructField("frequency", _I),
        T.StructField("days", _I),
        T.StructField("total_quantity", _I),
        T.StructField("unit", _S),
        T.StructField("special_note", _S),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "examination_result": T.StructType([
        T.StructField("examination_result_id", _L),
        T.StructField("examination_id", _L),
        T.StructField("treatment_id", _L),
        T.StructField("examination_date", _D),
        T.StructField("examination_result", _S),
        T.StructField("examination_normal", _I),
        T.StructField("examination_notes", _S),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "health_checkup_institution": T.StructType([
        T.StructField("institution_id", _L),
        T.StructField("region_code", _S),
        T.StructField("institution_name", _S),
        T.StructField("institution_type", _S),
        T.StructField("address", _S),
        T.StructField("phone_number", _S),
        T.StructField("is_active", _I),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "Out_Treatments": T.StructType([
        T.StructField("treatment_id", _L),
        T.StructField("checkIn_id", _L),
        T.StructField("treatment_status", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "In_Treatments": T.StructType([
        T.StructField("treatment_id", _L),
        T.StructField("checkIn_id", _L),
        T.StructField("treatment_status", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "Emergency_Treatments": T.StructType([
        T.StructField("treatment_id", _L),
        T.StructField("checkIn_id", _L),
        T.StructField("treatment_status", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "Reservation": T.StructType([
        T.StructField("reservation_id", _L),
        T.StructField("patient_no", _L),
        T.StructField("user_id", _L),
        T.StructField("reservation_datetime", _TS),
        T.StructField("reservation_status", _S),
        T.StructField("reservation_YN", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "doctor_treatment": T.StructType([
        T.StructField("doctorTreatment_id", _L),
        T.StructField("patient_no", _L),
        T.StructField("user_id", _L),
        T.StructField("doctorTreatment_starttime", _TS),
        T.StructField("doctorTreatment_endtime", _TS),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "diagnosis_certificate": T.StructType([
        T.StructField("certificate_id", _L),
        T.StructField("certificate_number", _S),
        T.StructField("patient_id", _L),
        T.StructField("doctor_id", _L),
        T.StructField("diagnosis_name", _S),
        T.StructField("diagnosis_date", _D),
        T.StructField("clinical_findings", _S),
        T.StructField("purpose", _S),
        T.StructField("status", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "examination_journal": T.StructType([
        T.StructField("examination_journal_id", _L),
        T.StructField("examination_id", _L),
        T.StructField("treatment_id", _L),
        T.StructField("user_id", _L),
        T.StructField("equipment_id", _L),
        T.StructField("examination_time", _TS),
        T.StructField("examination_equipment_usage", _I),
        T.StructField("examination_notes", _S),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "blood_bank": T.StructType([
        T.StructField("blood_bank_id", _L),
        T.StructField("examination_id", _L),
        T.StructField("treatment_id", _L),
        T.StructField("user_id", _L),
        T.StructField("examination_time", _TS),
        T.StructField("blood_type", _S),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "disability_care_institution": T.StructType([
        T.StructField("institution_id", _L),
        T.StructField("institution_type", _S),
        T.StructField("institution_name", _S),
        T.StructField("service_type", _S),
        T.StructField("address", _S),
        T.StructField("is_active", _I),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "batch_job_log": T.StructType([
        T.StructField("batch_log_id", _L),
        T.StructField("job_name", _S),
        T.StructField("trigger_type", _S),
        T.StructField("status", _S),
        T.StructField("attempt_no", _I),
        T.StructField("max_attempts", _I),
        T.StructField("retry_of_log_id", _L),
        T.StructField("started_at", _TS),
        T.StructField("finished_at", _TS),
        T.StructField("next_retry_at", _TS),
        T.StructField("request_payload", _S),
        T.StructField("result_payload", _S),
        T.StructField("error_message", _S),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "user_app_profile": T.StructType([
        T.StructField("patient_no", _L),
        T.StructField("app_user_id", _S),
        T.StructField("blood_type", _S),
        T.StructField("height_cm", _dec(5, 1)),
        T.StructField("weight_kg", _dec(5, 1)),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "disability": T.StructType([
        T.StructField("disability_id", _L),
        T.StructField("patient_no", _L),
        T.StructField("disability_grade", _S),
        T.StructField("disability_type", _S),
        T.StructField("assistive_device_YN", _S),
        T.StructField("disability_device_type", _S),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "user_vital_measurement": T.StructType([
        T.StructField("vital_id", _L),
        T.StructField("patient_no", _L),
        T.StructField("measured_at", _TS),
        T.StructField("heart_rate_bpm", _I),
        T.StructField("blood_pressure_systolic", _I),
        T.StructField("blood_pressure_diastolic", _I),
        T.StructField("body_temp_c", _dec(4, 1)),
        T.StructField("stress_score", _dec(7, 2)),
        T.StructField("source_channel", _S),
        T.StructField("synced_to_mysql_at", _TS),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "patient_clinical_event": T.StructType([
        T.StructField("clinical_event_id", _L),
        T.StructField("patient_no", _L),
        T.StructField("category", _S),
        T.StructField("occurred_on", _D),
        T.StructField("department", _S),
        T.StructField("title", _S),
        T.StructField("summary", _S),
        T.StructField("status", _S),
        T.StructField("institution_name", _S),
        T.StructField("source_mysql_treatment_id", _L),
        T.StructField("created_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
    "etl_runtime_state": T.StructType([
        T.StructField("job_code", _S),
        T.StructField("cursor_value", _L),
        T.StructField("meta", _S),
        T.StructField("updated_at", _TS),
    ]),
    "wellness_increment": T.StructType([
        T.StructField("patient_no", _L),
        T.StructField("summary_date", _D),
        T.StructField("measured_at", _TS),
        T.StructField("event_id", _L),
        T.StructField("step_delta", _L),
        T.StructField("sleep_hours", _dec(4, 1)),
        T.StructField("stress_level", _dec(7, 2)),
    ]),
    "user_daily_wellness": T.StructType([
        T.StructField("patient_no", _L),
        T.StructField("summary_date", _D),
        T.StructField("step_count", _L),
        T.StructField("step_goal", _I),
        T.StructField("sleep_hours", _dec(4, 1)),
        T.StructField("stress_level", _dec(7, 2)),
        T.StructField("synced_to_mysql_at", _TS),
        T.StructField("created_date", _TS),
        T.StructField("last_modified_date", _TS),
        T.StructField("intt_cd", _S),
    ]),
}
