"""Newest events per patient and category, the completion batch, ledger writes: hand-made cases and plans."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from clinops.operators import ledger, patient, sync
from clinops.sources.tables import load_view
from tests.test_plans import SF, plan

NOW = dt.datetime(2024, 1, 30, 12, 0)
EVENT = ("clinical_event_id long, patient_no long, category string, occurred_on date, department string, title string, "
         "summary string, status string, institution_name string")


def events(spark, rows):
    return spark.createDataFrame([(i, p, c, d, "dep", f"t{i}", None, "COMPLETED", None) for i, p, c, d in rows], EVENT)


def test_newest_events_ties_nulls_and_hot_patient(spark):
    day = dt.date(2024, 1, 1)
    rows = [(i, 1, "OUTPATIENT", day) for i in range(1000)]                      # hot patient, all on one day
    rows += [(2000, 2, None, day), (2001, 2, None, None), (2002, 2, "None", dt.date(2024, 1, 2)), (2003, 2, "EMERGENCY", None)]
    got = patient.newest_events(events(spark, rows), 3).orderBy("patient_no", "category", "rank").collect()
    assert [(r.patient_no, r.category, r.rank, r.clinical_event_id) for r in got] == [
        (1, "OUTPATIENT", 1, 999), (1, "OUTPATIENT", 2, 998), (1, "OUTPATIENT", 3, 997),
        (2, "EMERGENCY", 1, 2003), (2, "None", 1, 2002), (2, "None", 2, 2000), (2, "None", 3, 2001)]
    nested = {r.patient_no: r.clinical_events_by_category for r in patient.events_by_category(events(spark, rows), 2).collect()}
    assert [e.clinical_event_id for e in nested[1]["OUTPATIENT"]] == [999, 998]
    assert list(nested[2]) == ["EMERGENCY", "None"] and nested[2]["EMERGENCY"][0].occurred_on == ""
    assert nested[1]["OUTPATIENT"][0].occurred_on == "2024년 1월 1일"


def test_newest_events_limit_before_the_shuffle(spark):
    p = plan(E.queries()["newest_events"](spark, SF))
    first, exchange = p.rindex("WindowGroupLimit"), p.rindex("Exchange hashpartitioning(patient_no")
    assert "Partial" in p[first:first + 300] and first > exchange               # plans print children last


def test_my_health_categories_of_a_patient_without_events(spark):
    req = spark.createDataFrame([("patient_no", "5"), ("patient_no", "77")], "by string, value string")
    who = spark.createDataFrame([(5, "a@b.c", "010")], "patient_no long, patient_email string, patient_tel string")
    prof = spark.createDataFrame([], "patient_no long, app_user_id string")
    out = patient.my_health_categories(req, who, prof, events(spark, [(1, 6, "A", None)])).collect()
    assert [(r.patient_no, r.clinical_events_by_category) for r in out] == [(5, {})]


def test_iso_caption_plan_has_one_pattern(spark):
    p = E.queries()["format_datetimes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert p.upper().count("RLIKE") + p.count("regexp") <= 2


def test_completion_batch_links_its_rows(spark):
    p, c, t, rx, d = (load_view(spark, SF, n) for n in ("Patient", "check_in", "treatments", "Prescription", "department"))
    newest = sync.newest_encounters(p, 10)
    out = {k: v.collect() for k, v in sync.completion_batch(newest, NOW, c, t, rx, d).items()}
    want = [r.patient_no for r in p.select("patient_no").orderBy(F.desc("patient_no")).limit(10).collect()]
    base = t.agg(F.max("treatment_id")).first()[0]
    assert {r.patient_no: r.treatment_id - base for r in out["treatments"]} == {p: i for i, p in enumerate(want, 1)}
    status = {r.treatment_id: r.treatment_status for r in out["treatments"]}
    checks = {r.checkIn_id: r.checkIn_status for r in out["check_in"]}
    assert len(checks) == len(status) == 10
    for r in out["Out_Treatments"]:
        assert r.treatment_status == status[r.treatment_id] == checks[r.checkIn_id]
        assert (r.treatment_comment is None) == (r.treatment_status == "COMPLETED")
    for r in out["Prescription"]:
        assert r.prescription_status == ("DISPENSED" if status[r.treatment_id] == "COMPLETED" else "CANCELLED")
    assert len({r.prescription_id for r in out["Prescription"]}) == 10
    assert sync.newest_encounters(p, 0).count() == 0


def test_ledger_rows_written_from_start_to_end(spark):
    log = load_view(spark, SF, "batch_job_log")
    top = log.agg(F.max("batch_log_id")).first()[0]
    runs = spark.createDataFrame(
        [("etl.b", "manual", 1, 3, ("한글", None)), ("etl.a", "scheduler", 3, 3, None)],
        "job_name string, trigger_type string, attempt_no int, max_attempts int, request struct<note:string,limit:int>")
    new = ledger.running_rows(runs, log, NOW, ["job_name"])
    assert new.columns == log.columns
    rows = {r.job_name: r for r in new.collect()}
    assert (rows["etl.a"].batch_log_id, rows["etl.b"].batch_log_id) == (top + 1, top + 2)
    assert rows["etl.b"].request_payload == '{"note":"한글","limit":null}' and rows["etl.a"].request_payload is None
    assert rows["etl.a"].status == "RUNNING" and rows["etl.a"].finished_at is None
    ended = spark.createDataFrame([(top + 1, None, "  Error: x  "), (top + 2, (7, "뜻"), None)],
                                  "batch_log_id long, result struct<rows:int,text:string>, error string")
    done = {r.batch_log_id: r for r in ledger.finished_rows(new, ended, NOW).collect()}
    failed, good = done[top + 1], done[top + 2]
    assert (failed.status, failed.error_message, failed.next_retry_at) == ("FAILED", "Error: x", None)  # no attempt left
    assert (good.status, good.error_message) == ("SUCCESS", None)
    assert json.loads(good.result_payload) == {"rows": 7, "text": "뜻"} and "뜻" in good.result_payload
    retry = ledger.finished_rows(new, ended.withColumn("result", F.lit(None).cast("struct<rows:int>"))
                                 .withColumn("error", F.lit("e")), NOW).where(F.col("job_name") == "etl.b").first()
    assert retry.next_retry_at == NOW + dt.timedelta(minutes=ledger.RETRY_DELAY_MIN)


@pytest.mark.parametrize("rules,left", [(False, 1), (True, 2)])
def test_rejected_treatments_stay_pending(spark, rules, left):
    rules = sync.treatment_rules() if rules else None
    t = load_view(spark, SF, "treatments").limit(3).withColumn("synced_to_postgres_at", F.lit(None).cast("timestamp_ntz"))
    rows = t.collect()
    t = t.withColumn("treatment_date", F.when(F.col("treatment_id") != rows[0].treatment_id, F.col("treatment_date")))
    t = t.withColumn("patient_no", F.when(F.col("treatment_id") != rows[1].treatment_id, F.lit(5).cast("bigint")))
    none = spark.createDataFrame([], "clinical_event_id long, source_mysql_treatment_id long")
    run = sync.sync_treatments(t, none, NOW, rules=rules)
    assert run["rejected"].count() == left - 1
    assert run["marked"].where("synced_to_postgres_at is null").count() == left
    assert run["inserted"].count() == 3 - left
