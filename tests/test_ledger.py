import datetime as dt

from clinops.operators import ledger

NOW = dt.datetime(2024, 1, 30, 12, 0)
SCHEMA = ("batch_log_id long, job_name string, trigger_type string, status string, attempt_no int, max_attempts int, "
          "retry_of_log_id long, started_at timestamp_ntz, finished_at timestamp_ntz, next_retry_at timestamp_ntz, "
          "error_message string, result_payload string, created_date timestamp_ntz, last_modified_date timestamp_ntz")


def log(spark):
    t = dt.datetime(2024, 1, 30, 10, 0)
    rows = [
        (1, "etl.a", "scheduler", "FAILED", 1, 3, None, t, t, t + dt.timedelta(minutes=5), "E1", None, t, t),
        (2, "etl.a", "scheduler", "FAILED", 3, 3, None, t, t, None, "E2", None, t, t),                   # attempts used up
        (3, "etl.b", "manual", "FAILED", 1, 3, None, t, t, NOW + dt.timedelta(hours=1), "E3", None, t, t),  # future
        (4, "etl.b", "retry", "RETRIED", 2, 3, 1, t, t, None, "E4", None, t, t),
        (5, "etl.c", "scheduler", "SUCCESS", 1, 3, None, t, t, None, None, '{"job": "x", "n": 1, "z": 2}', t, t),
        (6, "etl.c", "scheduler", "RUNNING", 1, 3, None, t, None, None, None, None, t, t),
        (7, "etl.d", "scheduler", "FAILED", 2, 3, None, t, t, t, "E7", None, t, t),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_due_retries_order_and_min_limit(spark):
    due = ledger.ledger_due_retries(log(spark), NOW, limit=10).collect()
    assert [r.batch_log_id for r in due] == [7, 1]
    assert [r.batch_log_id for r in ledger.ledger_due_retries(log(spark), NOW, limit=0).collect()] == [7]


def test_recent_clamp_and_status(spark):
    assert ledger.ledger_recent(log(spark), limit=500).count() == 7
    assert [r.batch_log_id for r in ledger.ledger_recent(log(spark), limit=2, status="failed").collect()] == [7, 3]


def test_retry_plan_payload(spark):
    plan = ledger.ledger_retry_plan(log(spark), NOW).collect()
    assert [(r.retry_of_log_id, r.attempt_no, r.request_payload) for r in plan] == [
        (7, 3, '{"retry_of_log_id":7,"previous_attempt":2}'), (1, 2, '{"retry_of_log_id":1,"previous_attempt":1}')]


def test_state_fold_and_backoff(spark):
    st = {r.batch_log_id: r for r in ledger.ledger_state(ledger.transitions(log(spark))).collect()}
    assert (st[4].status, st[4].next_retry_at, st[4].error_message, st[4].transitions) == ("RETRIED", None, "E4", 3)
    assert (st[5].status, st[5].error_message) == ("SUCCESS", None)
    assert (st[6].status, st[6].finished_at) == ("RUNNING", None)
    assert st[1].next_retry_at is not None
    bo = {r.batch_log_id: r.next_retry_at for r in ledger.ledger_backoff(log(spark)).collect()}
    assert bo[2] is None and bo[1] == dt.datetime(2024, 1, 30, 10, 5)


def test_payload_fields(spark):
    r = ledger.ledger_payload_fields(log(spark)).collect()[0]
    assert (r.job, r.extra_keys, r.extra) == ("x", "n,z", "n=1,z=2")
    assert (r.suffix, r.payload_batch_log_id, r.check_ins, r.prescription_ids) == (None, None, None, None)


def test_retry_cycle_marks_origins_and_appends_runs(spark):
    out = {r.batch_log_id: r for r in ledger.ledger_retry_cycle(log(spark), NOW, limit=10).collect()}
    assert len(out) == 9
    assert (out[1].status, out[1].next_retry_at, out[1].last_modified_date) == ("RETRIED", None, NOW)
    assert (out[7].status, out[7].next_retry_at) == ("RETRIED", None)
    assert out[3].status == "FAILED"                         # not yet due
    assert (out[8].retry_of_log_id, out[8].attempt_no, out[8].status) == (7, 3, "RUNNING")   # due order: 7 then 1
    assert (out[9].retry_of_log_id, out[9].attempt_no, out[9].trigger_type) == (1, 2, "retry")


def test_pipeline_job_names():
    assert ledger.pipeline_job_name("initial") == "pipeline.initial"
    assert ledger.pipeline_job_name("completion") == "pipeline.completion"
