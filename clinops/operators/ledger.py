"""Batch-run ledger: state transitions, back-off, due retries, recent runs,
retry plan and payload splitting.

The reference updates one ledger row in place (RUNNING → SUCCESS / FAILED →
RETRIED).  Here transitions are append-only events and the current state
of every run is a per-run fold (``max_by`` on the sequence number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinops.functions.common import as_datetime, ts_lit
from clinops.functions.text import ustrip

# Ledger job names of the scheduled and manual runs.
JOB_NAMES = ("pipeline.initial", "pipeline.completion", "etl.wearable_slot",
             "etl.postgres_to_mysql", "etl.mysql_to_postgres")
PIPELINE_JOBS = {"initial": "pipeline.initial", "completion": "pipeline.completion"}


def pipeline_job_name(kind: str) -> str:
    """Ledger name of a pipeline run ('initial' or anything else → completion)."""
    return PIPELINE_JOBS["initial"] if kind == "initial" else PIPELINE_JOBS["completion"]


RECENT_DEFAULT, RECENT_MAX = 50, 200
RETRY_DELAY_MIN, MAX_ATTEMPTS = 5, 3
# Payload fields the run API lifts out of the result payload.
KNOWN_PAYLOAD_FIELDS = ("job", "batch_log_id", "suffix", "patients_inserted_from",
                        "check_ins", "treatments", "prescription_ids")

TRANSITION_COLS = ("batch_log_id", "seq", "status", "at", "error_message", "next_retry_at")
ERROR_TEXT_MAX = 4000


def error_text(c):
    """Stored failure text: stripped, at most 4000 characters."""
    return F.substring(ustrip(c), 1, ERROR_TEXT_MAX)


def transitions(log: DataFrame) -> DataFrame:
    """Append-only events implied by each ledger row: RUNNING at start, then
    SUCCESS/FAILED at finish, then RETRIED when a retry was spawned."""
    st = F.col("status")
    ev = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("RUNNING").alias("status"), F.col("started_at").alias("at"),
                 F.lit(None).cast("string").alias("error_message"),
                 F.lit(None).cast("timestamp_ntz").alias("next_retry_at")),
        F.struct(F.lit(2).alias("seq"),
                 F.when(st == "RETRIED", F.lit("FAILED")).otherwise(st).alias("status"),
                 F.col("finished_at").alias("at"),
                 F.when(st.isin("FAILED", "RETRIED"), error_text(F.col("error_message"))).alias("error_message"),
                 F.when(st == "FAILED", F.col("next_retry_at")).alias("next_retry_at")),
        F.struct(F.lit(3).alias("seq"), F.lit("RETRIED").alias("status"),
                 F.col("last_modified_date").alias("at"),
                 F.lit(None).cast("string").alias("error_message"),
                 F.lit(None).cast("timestamp_ntz").alias("next_retry_at")),
    )
    n = F.when(st == "RUNNING", 1).when(st == "RETRIED", 3).otherwise(2)
    return (log.select("batch_log_id", F.slice(ev, 1, n).alias("ev"))
            .select("batch_log_id", F.explode("ev").alias("e"))
            .select("batch_log_id", "e.*"))


def ledger_state(events: DataFrame) -> DataFrame:
    """Current state per run from its transitions.

    SUCCESS clears retry time and error; FAILED sets both; RETRIED clears the
    retry time and keeps the error; finish time comes from SUCCESS/FAILED."""
    seq, st = F.col("seq"), F.col("status")
    finishing = st.isin("SUCCESS", "FAILED")
    return events.groupBy("batch_log_id").agg(
        F.max_by("status", seq).alias("status"),
        F.max_by(F.col("at"), F.when(finishing, seq)).alias("finished_at"),
        F.max_by("next_retry_at", seq).alias("next_retry_at"),
        F.max_by("error_message", F.when(st != "RETRIED", seq)).alias("error_message"),
        F.max(seq).alias("transitions"))


def backoff(attempt_no, max_attempts, finished_at, delay_minutes: int = RETRY_DELAY_MIN):
    """next_retry_at = finished + delay while attempts remain, else NULL
    (attempts and delay clamped to ≥ 1)."""
    mx = F.greatest(F.lit(1), max_attempts)
    delay = max(1, int(delay_minutes))
    return F.when(attempt_no < mx, finished_at + F.expr(f"INTERVAL {delay} MINUTES"))


def ledger_backoff(log: DataFrame, delay_minutes: int = RETRY_DELAY_MIN) -> DataFrame:
    failed = log.where(F.col("status").isin("FAILED", "RETRIED"))
    return failed.select("batch_log_id", "attempt_no", "max_attempts", "finished_at",
                         backoff(F.col("attempt_no"), F.col("max_attempts"), F.col("finished_at"),
                                 delay_minutes).alias("next_retry_at"))


def due_failures(log: DataFrame, as_of_ts) -> DataFrame:
    now = ts_lit(as_datetime(as_of_ts))
    return log.where((F.col("status") == "FAILED") & F.col("next_retry_at").isNotNull()
                     & (F.col("next_retry_at") <= now) & (F.col("attempt_no") < F.col("max_attempts")))


def ledger_due_retries(log: DataFrame, as_of_ts, limit: int = 10) -> DataFrame:
    """Due failures, oldest retry time first (id tie-break), at least one row
    asked for.  Top-k: TakeOrderedAndProject, k rows per task."""
    return (due_failures(log, as_of_ts)
            .orderBy("next_retry_at", "batch_log_id").limit(max(1, int(limit)))
            .select("batch_log_id", "job_name", "attempt_no", "max_attempts", "next_retry_at"))


def ledger_recent(log: DataFrame, limit: int = RECENT_DEFAULT, status: str | None = None) -> DataFrame:
    """Newest runs by id, optional status filter (upper-cased), 1 ≤ n ≤ 200."""
    n = max(1, min(int(limit), RECENT_MAX))
    df = log.where(F.col("status") == status.upper()) if status else log
    return (df.orderBy(F.col("batch_log_id").desc()).limit(n)
            .select("batch_log_id", "job_name", "trigger_type", "status", "attempt_no", "max_attempts",
                    "retry_of_log_id", "started_at", "finished_at", "next_retry_at", "error_message",
                    "created_date", "last_modified_date"))


def ledger_retry_plan(log: DataFrame, as_of_ts, limit: int = 10) -> DataFrame:
    """New RUNNING rows for the due failures: attempt + 1, linked to the
    origin, request payload {retry_of_log_id, previous_attempt}."""
    due = ledger_due_retries(log, as_of_ts, limit)
    return due.select(
        F.col("batch_log_id").alias("retry_of_log_id"), "job_name",
        F.lit("retry").alias("trigger_type"), F.lit("RUNNING").alias("status"),
        (F.col("attempt_no") + 1).alias("attempt_no"), "max_attempts",
        ts_lit(as_datetime(as_of_ts)).alias("started_at"),
        F.to_json(F.struct(F.col("batch_log_id").alias("retry_of_log_id"),
                           F.col("attempt_no").alias("previous_attempt"))).alias("request_payload"))


def ledger_payload_fields(log: DataFrame) -> DataFrame:
    """Split each result payload: every known field as a column (a payload
    without a job takes the run's own job name), the sorted names of the other
    keys, and those keys with their values as sorted ``key=value`` text."""
    m = F.from_json(F.col("result_payload"), "map<string,string>")
    known = F.array(*[F.lit(k) for k in KNOWN_PAYLOAD_FIELDS])
    rest = F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: ~F.array_contains(known, k))))
    lifted = [F.coalesce(m["job"], F.col("job_name")).alias("job") if k == "job"
              else m[k].alias(f"payload_{k}" if k == "batch_log_id" else k) for k in KNOWN_PAYLOAD_FIELDS]
    text = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))
    return (log.where(F.col("result_payload").isNotNull())
            .select("batch_log_id", *lifted,
                    F.array_join(F.transform(rest, lambda e: e["key"]), ",").alias("extra_keys"),
                    F.array_join(F.transform(rest, text), ",").alias("extra")))


def ledger_json(payload_cols: list[str]) -> F.Column:
    """JSON text of a payload struct (missing values as null, UTF-8 as is)."""
    return F.to_json(F.struct(*payload_cols), {"ignoreNullFields": "false"})


def running_rows(runs: DataFrame, log: DataFrame, as_of_ts, order: list[str]) -> DataFrame:
    """New RUNNING ledger rows, with the next ids in ``order`` (unique columns of ``runs``).

    ``runs``: job_name, trigger_type, attempt_no, max_attempts and, where they have any, retry_of_log_id and a
    ``request`` struct, stored as JSON text."""
    from clinops.operators.upsert import assign_keys

    now = ts_lit(as_datetime(as_of_ts))
    payload = F.when(F.col("request").isNotNull(), ledger_json(["request.*"])) if "request" in runs.columns else F.lit(None)
    rows = runs.withColumns({"request_payload": payload.cast("string"), "status": F.lit("RUNNING"), "started_at": now,
                             "created_date": now, "last_modified_date": now, "intt_cd": F.lit("BATCH")})
    rows = assign_keys(rows, order, "batch_log_id", existing_max=log.agg(F.max("batch_log_id")), floor=0)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields])


def finished_rows(log: DataFrame, outcomes: DataFrame, as_of_ts, delay_minutes: int = RETRY_DELAY_MIN) -> DataFrame:
    """The ledger after its runs ended.  ``outcomes``: batch_log_id and a ``result`` struct (success) or an
    ``error`` text (failure).

    SUCCESS stores the result as JSON text and clears retry time and error; FAILED stores the error text and the
    next retry time while attempts remain.  Runs without an outcome stay as they are."""
    now = ts_lit(as_datetime(as_of_ts))
    ended = outcomes.select("batch_log_id", F.col("error").alias("__error"),
                            F.when(F.col("result").isNotNull(), ledger_json(["result.*"])).alias("__result"),
                            F.lit(True).alias("__ended"))
    j = log.join(ended, "batch_log_id", "left")
    failed, hit = F.col("__error").isNotNull(), F.coalesce(F.col("__ended"), F.lit(False))
    retry = backoff(F.col("attempt_no"), F.col("max_attempts"), now, delay_minutes)
    new = {
        "status": F.when(failed, "FAILED").otherwise("SUCCESS"),
        "finished_at": now,
        "next_retry_at": F.when(failed, retry),
        "result_payload": F.when(failed, F.col("result_payload")).otherwise(F.col("__result")),
        "error_message": F.when(failed, error_text(F.col("__error"))),
        "last_modified_date": now,
    }
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in log.columns])


def ledger_retry_cycle(log: DataFrame, as_of_ts, limit: int = 10, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One retry scan applied to the ledger: the due failures (at most
    ``limit``) become RETRIED with no retry
    time, and one RUNNING row per retry is appended with the next ids in due
    order.  Returns the whole new ledger."""
    from clinops.operators.upsert import assign_keys

    now = ts_lit(as_datetime(as_of_ts))
    due = ledger_due_retries(log, as_of_ts, limit)
    hit = due.select("batch_log_id", F.lit(True).alias("__due"))
    marked = log.join(hit, "batch_log_id", "left")
    is_due = F.coalesce(F.col("__due"), F.lit(False))
    updated = marked.select(*[
        F.when(is_due, F.lit("RETRIED")).otherwise(F.col(c)).alias(c) if c == "status" else
        F.when(is_due, F.lit(None).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c) if c == "next_retry_at" else
        F.when(is_due, now).otherwise(F.col(c)).alias(c) if c == "last_modified_date" else
        F.col(c) for c in log.columns])
    new = due.select(
        "next_retry_at", F.col("batch_log_id").alias("retry_of_log_id"), "job_name",
        F.lit("retry").alias("trigger_type"), F.lit("RUNNING").alias("status"),
        (F.col("attempt_no") + 1).alias("attempt_no"),
        F.lit(max(1, int(max_attempts))).alias("max_attempts"),
        now.alias("started_at"),
        F.to_json(F.struct(F.col("batch_log_id").alias("retry_of_log_id"),
                           F.col("attempt_no").alias("previous_attempt"))).alias("request_payload"),
        now.alias("created_date"), now.alias("last_modified_date"), F.lit("BATCH").alias("intt_cd"))
    keyed = assign_keys(new, ["next_retry_at", "retry_of_log_id"], "batch_log_id",
                        existing_max=log.agg(F.max("batch_log_id")), floor=0)
    keyed = keyed.drop("next_retry_at")
    appended = keyed.select(
        *[F.col(c).cast(log.schema[c].dataType).alias(c) if c in keyed.columns
          else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns])
    return updated.unionByName(appended)
