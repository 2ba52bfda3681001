"""Streaming jobs against their batch twins (file source, availableNow)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinops.operators import ledger
from clinops.sources.tables import daily_wellness_view, load_view, raw
from clinops.streaming import jobs

SF = "/root/testdata/sf0.001"


def _source(spark, parts=3):
    d = tempfile.mkdtemp(prefix="clinops-src-")
    ev = raw(spark, SF, "events")
    for i in range(parts):
        ev.where(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(d)
    return d


def test_daily_rollup_stream_matches_batch_and_replay_is_noop(spark):
    src, work = _source(spark), tempfile.mkdtemp(prefix="clinops-work-")
    store, ckpt = os.path.join(work, "store"), os.path.join(work, "ckpt")
    inc = jobs.wellness_increments(jobs.read_stream(spark, src, max_files_per_trigger=1))
    q = jobs.start_daily_rollup(inc, store, ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(store).select("patient_no", "summary_date", "step_count", "sleep_hours", "stress_level")
    twin = daily_wellness_view(load_view(spark, SF, "wellness_increment")).select(
        "patient_no", "summary_date", "step_count", "sleep_hours", "stress_level")
    assert got.exceptAll(twin).count() == 0 and twin.exceptAll(got).count() == 0
    # replaying batch 0 (same rows, same id) must not add steps again
    before = spark.read.parquet(store).checkpoint(eager=True)
    first = jobs.wellness_increments(spark.read.parquet(src).where(F.col("event_id") % 3 == 0))
    jobs.apply_rollup_batch(first, 0, store, jobs.stream_identity(spark, ckpt))
    after = spark.read.parquet(store)
    assert before.select("patient_no", "summary_date", "step_count").exceptAll(
        after.select("patient_no", "summary_date", "step_count")).count() == 0


def _hr_twin(vitals):
    """24-hour means straight from the readings, slot by slot."""
    rows = [(r.measured_at, r.heart_rate_bpm) for r in vitals.where("heart_rate_bpm is not null").collect()]
    floor = lambda t: t - dt.timedelta(minutes=t.minute % 5, seconds=t.second, microseconds=t.microsecond)
    out = {}
    for end in {floor(t) + dt.timedelta(minutes=5) for t, _ in rows}:
        inside = [v for t, v in rows if end - dt.timedelta(hours=24) <= t < end]
        out[end] = (len(inside), sum(inside))
    return out


def test_hr_stream_equals_batch_twin_with_late_and_out_of_order_files(spark):
    src = tempfile.mkdtemp(prefix="clinops-src-")
    work = tempfile.mkdtemp(prefix="clinops-work-")
    store, means, ckpt = (os.path.join(work, d) for d in ("slots", "means", "ckpt"))
    ev = raw(spark, SF, "events")
    cut = ev.agg(F.expr("percentile_approx(event_id, array(0.25, 0.5, 0.75))")).first()[0]
    parts = [ev.where(F.col("event_id") > cut[1]), ev.where(F.col("event_id") <= cut[0]),
             ev.where((F.col("event_id") > cut[0]) & (F.col("event_id") <= cut[1]))]  # newest first, oldest late
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        readings = jobs.vital_readings(jobs.read_stream(spark, src, max_files_per_trigger=1))
        jobs.start_hr_slots(readings, store, ckpt, means_path=means).awaitTermination(300)  # a restart each time
    want = _hr_twin(load_view(spark, SF, "user_vital_measurement"))
    got = spark.read.parquet(means).collect()
    assert len(got) == len(want)
    assert {r.window_end: r.n for r in got} == {k: n for k, (n, _) in want.items()}
    assert all(abs(r.avg_hr_24h - want[r.window_end][1] / want[r.window_end][0]) <= 0.0500001 for r in got)


def test_hr_batch_applied_twice_changes_nothing_and_streams_add_up(spark):
    work = tempfile.mkdtemp(prefix="clinops-work-")
    store = os.path.join(work, "slots")
    v = load_view(spark, SF, "user_vital_measurement")
    sums = jobs.hr_slot_sums(v)
    jobs.apply_hr_slots(sums, store, stream="a")
    jobs.apply_hr_slots(sums, store, stream="a")
    once = v.where("heart_rate_bpm is not null").agg(F.sum("heart_rate_bpm"), F.count("*")).first()
    assert tuple(spark.read.parquet(store).agg(F.sum("s"), F.sum("n")).first()) == tuple(once)
    jobs.apply_hr_slots(sums, store, stream="b")
    assert spark.read.parquet(store).agg(F.sum("n")).first()[0] == 2 * once[1]


def test_hr_means_have_no_unpartitioned_window(spark):
    slots = jobs.hr_slot_sums(load_view(spark, SF, "user_vital_measurement"))
    plan = jobs.hr_24h_means(slots)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan and "hashpartitioning(day" in plan


def test_sync_stream_drops_repeated_deliveries_in_its_state(spark, monkeypatch):
    """Repeats within the remembered time end in the state, also across a restart; late rows are copied."""
    src, work = tempfile.mkdtemp(prefix="clinops-src-"), tempfile.mkdtemp(prefix="clinops-work-")
    target, ckpt = os.path.join(work, "target"), os.path.join(work, "ckpt")
    ev = raw(spark, SF, "events")
    newer, older = ev.where("event_id % 2 = 0 or event_id > 300"), ev.where("event_id % 2 = 1 and event_id <= 300")
    seen, apply_batch = [], jobs.apply_sync_batch

    def watched(df, bid, path):
        seen.append(df.count())
        apply_batch(df, bid, path)

    monkeypatch.setattr(jobs, "apply_sync_batch", watched)
    for part in (newer, newer.where("event_id % 4 = 0"), older):  # the second file repeats a part of the first
        part.coalesce(1).write.mode("append").parquet(src)
        readings = jobs.vital_readings(jobs.read_stream(spark, src, max_files_per_trigger=1))
        jobs.start_sync(readings, target, ckpt).awaitTermination(300)
    assert sum(seen) == ev.count() == spark.read.parquet(target).count()


def test_sync_stream_keeps_one_of_two_readings_of_a_time_and_all_without_key(spark):
    src, work = tempfile.mkdtemp(prefix="clinops-src-"), tempfile.mkdtemp(prefix="clinops-work-")
    rows = [(1, 7, dt.datetime(2024, 1, 1), 70), (2, 7, dt.datetime(2024, 1, 1), 80), (3, None, None, 1), (4, None, None, 2)]
    schema = T.StructType([T.StructField("vital_id", T.LongType()), T.StructField("patient_no", T.LongType()),
                           T.StructField("measured_at", T.TimestampNTZType()), T.StructField("heart_rate_bpm", T.LongType())])
    for part in (rows, rows[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_stream(spark, src, schema, max_files_per_trigger=1)
        jobs.start_sync(stream, os.path.join(work, "t"), os.path.join(work, "c")).awaitTermination(300)
    assert sorted(r.vital_id for r in spark.read.parquet(os.path.join(work, "t")).collect()) == [1, 3, 4]


def test_ledger_stream_equals_the_fold_with_transitions_out_of_order(spark):
    src, work = tempfile.mkdtemp(prefix="clinops-src-"), tempfile.mkdtemp(prefix="clinops-work-")
    store, ckpt = os.path.join(work, "ledger"), os.path.join(work, "ckpt")
    moves = ledger.transitions(load_view(spark, SF, "batch_job_log")).checkpoint()
    for seq in (3, 1, 2, 2):  # last ones first, one delivered twice
        moves.where(F.col("seq") == seq).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_stream(spark, src, moves.schema, max_files_per_trigger=1)
        jobs.start_ledger(stream, store, ckpt).awaitTermination(300)
    want = ledger.ledger_state(moves)
    got = spark.read.parquet(store).select(*want.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_sync_stream_exactly_once(spark):
    src, work = _source(spark), tempfile.mkdtemp(prefix="clinops-work-")
    target, ckpt = os.path.join(work, "target"), os.path.join(work, "ckpt")
    readings = jobs.vital_readings(jobs.read_stream(spark, src, max_files_per_trigger=1))
    q = jobs.start_sync(readings, target, ckpt)
    q.awaitTermination(300)
    n = raw(spark, SF, "events").count()
    assert spark.read.parquet(target).count() == n
    jobs.apply_sync_batch(jobs.vital_readings(spark.read.parquet(src)), 99, target)   # replay everything
    assert spark.read.parquet(target).count() == n


def test_trickle_ingest_partitions_by_day_and_is_complete(spark):
    src, work = _source(spark), tempfile.mkdtemp(prefix="clinops-work-")
    out, ckpt = os.path.join(work, "bronze"), os.path.join(work, "ckpt")
    q = jobs.start_ingest(jobs.vital_readings(jobs.read_stream(spark, src, max_files_per_trigger=1)), out, ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == raw(spark, SF, "events").count()
    assert got.where(F.col("day") != F.to_date("measured_at")).count() == 0
    # restarting on the same checkpoint with no new files adds nothing
    q2 = jobs.start_ingest(jobs.vital_readings(jobs.read_stream(spark, src)), out, ckpt)
    q2.awaitTermination(300)
    assert spark.read.parquet(out).count() == got.count()
