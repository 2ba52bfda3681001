"""Writes that must not lose, merge or silently skip rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clinops.functions.common import path_exists
from clinops.functions.display import decimal_display, format_iso_text
from clinops.operators import patient, sync, upsert
from clinops.plans import jobs as batch_jobs
from clinops.streaming import jobs

DAY = dt.date(2024, 1, 1)
AT = dt.datetime(2024, 1, 1, 8)
INC = "patient_no long, summary_date date, measured_at timestamp_ntz, event_id long, step_delta long, " \
      "sleep_hours decimal(4,1), stress_level decimal(7,2)"


def increments(spark, steps, event_id=1):
    return spark.createDataFrame([(1, DAY, AT + dt.timedelta(minutes=event_id), event_id, steps, None, None)], INC)


def steps(spark, store):
    return [r[0] for r in spark.read.parquet(store).select("step_count").collect()]


def test_a_new_checkpoint_still_adds(spark, tmp_path):
    store = str(tmp_path / "s")
    jobs.apply_rollup_batch(increments(spark, 100), 0, store, "a")
    jobs.apply_rollup_batch(increments(spark, 50, 2), 0, store, "b")
    assert steps(spark, store) == [150]
    jobs.apply_rollup_batch(increments(spark, 100), 0, store, "a")  # replays of both
    jobs.apply_rollup_batch(increments(spark, 50, 2), 0, store, "b")
    assert steps(spark, store) == [150]


def test_stream_identity_lives_with_the_checkpoint(spark, tmp_path):
    a = jobs.stream_identity(spark, str(tmp_path / "c1"))
    assert jobs.stream_identity(spark, str(tmp_path / "c1")) == a != jobs.stream_identity(spark, str(tmp_path / "c2"))


def test_a_null_step_keeps_the_total(spark, tmp_path):
    store = str(tmp_path / "s")
    jobs.apply_rollup_batch(increments(spark, 100), 0, store, "a")
    jobs.apply_rollup_batch(increments(spark, None, 2), 1, store, "a")
    assert steps(spark, store) == [100]


def table(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.partitionBy("day").parquet(path)


def test_merge_keeps_target_columns_the_source_lacks(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, [(1, "a", 7, DAY), (2, "b", 8, DAY)], "k long, v string, w int, day date")
    upsert.merge_into_partitions(path, spark.createDataFrame([(1, "new", DAY)], "k long, v string, day date"),
                                 ["k"], ["v"], "day")
    assert sorted((r.k, r.v, r.w) for r in spark.read.parquet(path).collect()) == [(1, "new", 7), (2, "b", 8)]


def test_merge_refuses_columns_the_target_lacks(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, [(1, "a", DAY), (2, "b", DAY)], "k long, v string, day date")
    with pytest.raises(ValueError):
        upsert.merge_into_partitions(path, spark.createDataFrame([(1, "n", 1, DAY)], "k long, v string, w int, day date"),
                                     ["k"], ["v"], "day")
    assert spark.read.parquet(path).count() == 2


def test_an_unreadable_target_fails(spark, tmp_path):
    path = tmp_path / "t"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"not parquet")
    rows = spark.createDataFrame([(1, "a", DAY)], "k long, v string, day date")
    with pytest.raises(Exception):
        upsert.merge_into_partitions(str(path), rows, ["k"], ["v"], "day")
    with pytest.raises(Exception):
        jobs.apply_rollup_batch(increments(spark, 1), 0, str(path), "a")
    assert (path / "part-0.parquet").read_bytes() == b"not parquet"
    assert not path_exists(spark, str(tmp_path / "none")) and upsert.read_snapshot(spark, str(tmp_path / "none")) is None


VITALS = "vital_id long, patient_no long, measured_at timestamp_ntz, heart_rate_bpm int, blood_pressure_systolic int, " \
         "blood_pressure_diastolic int, body_temp_c decimal(4,1), stress_score decimal(7,2), source_channel string, " \
         "created_date timestamp_ntz, intt_cd string, synced_to_mysql_at timestamp_ntz"


def readings(spark):
    row = lambda i, p, at: (i, p, at, 70, 120, 80, None, None, "app", None, None, None)
    return spark.createDataFrame([row(1, 1, AT), row(2, 1, AT), row(3, 1, None), row(4, 1, None), row(5, None, AT)], VITALS)


def test_null_key_readings_are_all_copied_and_marked(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    readings(spark).withColumn("day", F.to_date("measured_at")).write.partitionBy("day").parquet(src)
    first = batch_jobs.run_vitals_sync(spark, src, dst, AT, stop_after_target=True)
    again = batch_jobs.run_vitals_sync(spark, src, dst, AT)  # after a stop between the two writes
    assert (first["inserted"], again["inserted"], again["marked"]) == (4, 0, 5)
    assert sorted(r.vital_id for r in spark.read.parquet(dst).collect()) == [1, 3, 4, 5]
    assert spark.read.parquet(src).where("synced_to_mysql_at is null").count() == 0
    assert batch_jobs.run_vitals_sync(spark, src, dst, AT) == {"examined": 0, "errors": 0, "inserted": 0, "marked": 0}


def test_rejected_readings_stay_pending(spark):
    target = sync.vital_copy_rows(readings(spark).limit(0), AT)
    run = sync.sync_vitals(readings(spark), target, AT, rules=sync.vital_rules())
    assert sorted((r.vital_id, r.reason) for r in run["rejected"].select("vital_id", "reason").collect()) == [
        (3, "missing measured_at"), (4, "missing measured_at"), (5, "missing patient_no")]
    assert sorted(r.vital_id for r in run["marked"].where("synced_to_mysql_at is null").collect()) == [3, 4, 5]


def test_upsert_refuses_missing_update_columns_and_never_fans_out(spark):
    target = spark.createDataFrame([(1, "a", 5)], "k long, v string, w int")
    with pytest.raises(ValueError):
        upsert.upsert(target, spark.createDataFrame([(1, "b")], "k long, v string"), ["k"], ["v", "w"])
    twice = spark.createDataFrame([(1, "b", 1), (1, "c", 0), (None, "x", 9), (None, "x", 9)], "k long, v string, w int")
    out = sorted((r.k or 0, r.v, r.w) for r in upsert.upsert(target, twice, ["k"], ["v", "w"]).collect())
    assert out == [(0, "x", 9), (0, "x", 9), (1, "c", 0)]


def test_upsert_shuffles_each_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").cast("string").alias("v"))
        plan = upsert.upsert(big, big, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 3 and "coalesce(k" not in plan


def test_limit_zero_means_none(spark):
    assert sync.pending(readings(spark), "synced_to_mysql_at", ["vital_id"], 0).count() == 0


def test_marks_by_two_columns_and_touch(spark):
    rows = spark.createDataFrame([(1, DAY, None), (2, DAY, None)], "patient_no long, summary_date date, synced_to_mysql_at timestamp_ntz")
    out = {r.patient_no: r.synced_to_mysql_at for r in sync.mark_daily(rows, AT, limit=1).collect()}
    assert out == {1: AT, 2: None}


def test_odd_display_values(spark):
    texts = ["2024-01-01T10:00:99", "2024-01-01T10:00+99:99", "2024-01-01 10:00|Tab", "T|", "2024-02-30T10:00",
             "2024-01-01T10:00:00Z", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", format_iso_text(F.col("t")).alias("o"))
    got = {r.t: r.o for r in df.collect()}
    assert got.pop("2024-01-01T10:00:00Z") == "2024년 1월 1일 19:00" and all(k == v for k, v in got.items())
    nums = spark.sql("select cast(x as decimal(20,8)) x from values ('12345678.50'), ('0.0001'), ('100'), ('0.00000001') t(x)")
    assert [r[0] for r in nums.select(decimal_display(F.col("x"))).collect()] == ["12345678.5", "0.0001", "100", "0.00000001"]


def test_patient_360_tolerates_a_null_category(spark):
    import __spark_entry__ as E
    from clinops.sources.tables import load_view

    sf = "/root/testdata/sf0.001"
    views = [load_view(spark, sf, n) for n in ("Patient", "user_app_profile", "disability", "patient_clinical_event",
                                               "user_vital_measurement", "user_daily_wellness")]
    views[3] = views[3].withColumn("category", F.when(F.col("clinical_event_id") % 2 == 0, F.col("category")))
    out = patient.patient_360(*views, dt.date(2024, 1, 30)).where("n_events > 1").select("events_by_category").collect()
    assert any("None:" in r[0] for r in out) and E.queries()


def test_trend_filters_reach_the_scans(spark):
    import __spark_entry__ as E

    plan = E.queries()["table_daily_trend"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "GreaterThanOrEqual(l_shipdate" in plan


def test_create_if_absent(spark, tmp_path):
    path, schema = str(tmp_path / "t"), spark.range(0).schema
    assert upsert.create_if_absent(spark, path, schema)
    upsert.append_to(spark.range(3), path)
    assert not upsert.create_if_absent(spark, path, schema) and spark.read.parquet(path).count() == 3
