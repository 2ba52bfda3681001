"""Upsert / insert-ignore / sync semantics and idempotence."""

import datetime as dt

from pyspark.sql import functions as F

from clinops.operators import sync, upsert

NOW = dt.datetime(2024, 1, 30, 12, 0)


def test_upsert_updates_only_listed_columns(spark):
    tgt = spark.createDataFrame([(1, "old", "keep", "x"), (2, "old2", "keep2", "y")], "k long, name string, tel string, src string")
    src = spark.createDataFrame([(2, "new2", "NEW", "z"), (3, "new3", "t3", "w")], "k long, name string, tel string, src string")
    out = {r.k: r for r in upsert.upsert(tgt, src, ["k"], ["name"], with_action=True).collect()}
    assert (out[1].name, out[1].tel, out[1].action) == ("old", "keep", "keep")
    assert (out[2].name, out[2].tel, out[2].action) == ("new2", "keep2", "update")
    assert (out[3].name, out[3].tel, out[3].action) == ("new3", "t3", "insert")


def test_insert_if_absent_keeps_null_keys_apart_and_first_wins(spark):
    tgt = spark.createDataFrame([(1, None, "a")], "k long, c string, v string")
    rows = spark.createDataFrame([(1, None, "dup"), (2, "x", "b"), (2, "x", "c")], "k long, c string, v string")
    out = sorted(tuple(r) for r in upsert.insert_if_absent(tgt, rows, ["k", "c"]).collect())
    # a unique key does not compare NULL parts: such rows are all inserted
    assert out == [(1, None, "a"), (1, None, "dup"), (2, "x", "b")]


def test_delete_where_keeps_null_predicate(spark):
    df = spark.createDataFrame([(1, "X"), (2, None), (3, "Y")], "k long, s string")
    assert sorted(r.k for r in upsert.delete_where(df, F.col("s") == "X").collect()) == [2, 3]


def test_assign_keys_dense_in_order_across_partitions(spark):
    df = spark.range(0, 1000, 1, numPartitions=7).select((F.col("id") * 3 + 1).alias("k")).repartition(5)
    base = spark.createDataFrame([(500,)], "m long")
    out = upsert.assign_keys(df, ["k"], "new_id", existing_max=base).orderBy("k").collect()
    assert [r.new_id for r in out] == list(range(501, 1501))
    out2 = upsert.assign_keys(df.limit(3), ["k"], "new_id").orderBy("k").collect()
    assert [r.new_id for r in out2][0] == 10_000_001


def vitals(spark, rows):
    return spark.createDataFrame(rows, "vital_id long, patient_no long, measured_at timestamp_ntz, heart_rate_bpm int, "
                                       "blood_pressure_systolic int, blood_pressure_diastolic int, "
                                       "body_temp_c decimal(4,1), stress_score decimal(7,2), source_channel string, "
                                       "synced_to_mysql_at timestamp_ntz, created_date timestamp_ntz, intt_cd string")


def test_sync_vitals_duplicates_defaults_and_replay(spark):
    t0 = dt.datetime(2024, 1, 1, 6, 0)
    src = vitals(spark, [
        (1, 10, t0, 70, 120, 80, None, None, "app", None, None, None),
        (2, 10, t0, 71, 120, 80, None, None, "app", None, t0, ""),          # same key as 1 inside the batch
        (3, 11, t0, 72, 120, 80, None, None, "app", None, t0, "APP"),       # already in target
        (4, 12, t0, 73, 120, 80, None, None, "app", t0, t0, "APP"),         # already synced
    ])
    target = sync.vital_copy_rows(src.where("vital_id = 3"), NOW)
    run = sync.sync_vitals(src, target, NOW)
    ins = run["inserted"].collect()
    assert [(r.vital_id, r.intt_cd, r.created_date) for r in ins] == [(1, "ETL_SYNC", NOW)]
    outcomes = dict((r.vital_id, r.outcome) for r in run["outcomes"].collect())
    assert outcomes == {1: "inserted", 2: "duplicate", 3: "duplicate"}
    marked = {r.vital_id: r.synced_to_mysql_at for r in run["marked"].collect()}
    assert marked == {1: NOW, 2: NOW, 3: NOW, 4: t0}
    # replay against the new target with the new markers: nothing left to do
    new_target = target.unionByName(run["inserted"])
    again = sync.sync_vitals(run["marked"], new_target, NOW)
    assert again["inserted"].count() == 0


def test_sync_treatments_categories_titles_and_skip(spark):
    t = spark.createDataFrame([
        (1, 5, "OUTPATIENT", dt.datetime(2024, 1, 2, 9), "c", "내과", "COMPLETED", None),
        (2, 5, "LAB", dt.datetime(2024, 1, 3, 9), "c", None, "COMPLETED", None),
        (3, None, "INPATIENT", dt.datetime(2024, 1, 3, 9), "c", None, "COMPLETED", None),   # no patient
        (4, 6, None, dt.datetime(2024, 1, 3, 9), "c", "", "COMPLETED", None),              # title 'None …'
        (5, 6, "EMERGENCY", dt.datetime(2024, 1, 3, 9), "c", "x" * 300, "COMPLETED", None),
        (6, 6, "EMERGENCY", dt.datetime(2024, 1, 3, 9), "c", "d", "COMPLETED", None),       # exists already
    ], "treatment_id long, patient_no long, treatment_type string, treatment_date timestamp_ntz, "
       "treatment_comment string, treatment_dept string, treatment_status string, synced_to_postgres_at timestamp_ntz")
    ev = spark.createDataFrame([(7, 6)], "clinical_event_id long, source_mysql_treatment_id long")
    run = sync.sync_treatments(t, ev, NOW)
    ins = {r.source_mysql_treatment_id: r for r in run["inserted"].collect()}
    assert set(ins) == {1, 2, 4, 5}
    assert (ins[1].category, ins[1].title, ins[1].occurred_on) == ("OUTPATIENT", "내과 진료 #1", dt.date(2024, 1, 2))
    assert (ins[2].category, ins[2].title) == ("OUTPATIENT", "LAB 진료 #2")
    assert ins[4].title == "None 진료 #4"
    assert len(ins[5].title) == 200
    assert sorted(r.clinical_event_id for r in ins.values()) == [8, 9, 10, 11]
    out = dict((r.treatment_id, r.outcome) for r in run["outcomes"].collect())
    assert out == {1: "inserted", 2: "inserted", 4: "inserted", 5: "inserted", 6: "skipped_existing"}
    marked = {r.treatment_id: r.synced_to_postgres_at for r in run["marked"].collect()}
    assert marked[3] is None and marked[6] == NOW


def test_daily_rollup_adds_steps_and_takes_newest(spark):
    stored = spark.createDataFrame([(1, dt.date(2024, 1, 1), 100, 1000, None, None, NOW, NOW, NOW, "APP")],
                                   "patient_no long, summary_date date, step_count bigint, step_goal int, "
                                   "sleep_hours decimal(4,1), stress_level decimal(7,2), synced_to_mysql_at timestamp_ntz, "
                                   "created_date timestamp_ntz, last_modified_date timestamp_ntz, intt_cd string")
    inc = spark.createDataFrame([
        (1, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 9), 1, 50, "7.0", "20.00"),
        (1, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 8), 2, 30, "6.0", "30.00"),    # late, older reading
        (2, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 7), 3, 10, "5.0", "10.00"),
    ], "patient_no long, summary_date date, measured_at timestamp_ntz, event_id long, step_delta long, s string, t string"
    ).selectExpr("*", "CAST(s AS DECIMAL(4,1)) AS sleep_hours", "CAST(t AS DECIMAL(7,2)) AS stress_level").drop("s", "t")
    out = {r.patient_no: r for r in sync.daily_wellness_rollup(stored, inc, NOW).collect()}
    assert out[1].step_count == 180 and float(out[1].sleep_hours) == 7.0 and out[1].synced_to_mysql_at is None
    assert out[2].step_count == 10


def test_quarantine_reasons(spark):
    df = spark.createDataFrame([(1, None, 70, 36.5, 10.0), (2, 3, 300, 36.5, 10.0), (3, 3, 70, 36.5, 150.0),
                                (4, 3, None, 36.5, 10.0)],
                               "vital_id long, patient_no long, heart_rate_bpm int, body_temp_c double, stress_score double"
                               ).withColumn("measured_at", F.lit(NOW))
    good, bad = sync.quarantine(df)
    assert sorted(r.vital_id for r in good.collect()) == [4]
    assert {r.vital_id: r.reason for r in bad.collect()} == {
        1: "missing patient_no", 2: "heart_rate_bpm out of range", 3: "stress_score out of range"}


def test_encounter_fanout_cascade(spark):
    enc = spark.createDataFrame([(1, "COMPLETED"), (2, "CANCELLED")], "patient_no long, status string")
    out = sync.encounter_fanout(enc, NOW, key_base=spark.createDataFrame([(100,)], "m long")).collect()
    by = {(r.patient_no, r.record_type): r for r in out}
    assert len(out) == 8
    assert by[(1, "prescription")].status == "DISPENSED" and by[(1, "prescription")].comment is None
    assert by[(2, "prescription")].status == "CANCELLED" and by[(2, "out_treatment")].comment.startswith("종료-")
    assert {by[(1, "treatment")].treatment_id, by[(2, "treatment")].treatment_id} == {101, 102}


def test_merge_into_partitions_rewrites_only_touched(spark):
    import os
    import tempfile
    base = tempfile.mkdtemp(prefix="clinops-merge-")
    path = os.path.join(base, "daily")
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    schema = "patient_no long, step_count long, intt_cd string, summary_date date"
    spark.createDataFrame([(1, 10, "A", d1), (2, 20, "A", d1), (1, 30, "A", d2)], schema) \
        .write.partitionBy("summary_date").parquet(path)
    untouched = os.path.join(path, "summary_date=2024-01-01")
    before = sorted(os.listdir(untouched))
    src = spark.createDataFrame([(1, 99, "B", d2), (3, 5, "B", d2)], schema)
    upsert.merge_into_partitions(path, src, ["patient_no", "summary_date"], ["step_count"], "summary_date")
    got = sorted((r.patient_no, str(r.summary_date), r.step_count, r.intt_cd)
                 for r in spark.read.parquet(path).collect())
    assert got == [(1, "2024-01-01", 10, "A"), (1, "2024-01-02", 99, "A"), (2, "2024-01-01", 20, "A"),
                   (3, "2024-01-02", 5, "B")]
    assert sorted(os.listdir(untouched)) == before      # day 1 files never rewritten


def test_upsert_source_order_last_row_wins(spark):
    tgt = spark.createDataFrame([(1, "old")], "k long, v string")
    src = spark.createDataFrame([(1, "a", 1), (1, "c", 3), (1, "b", 2), (2, "x", 1)], "k long, v string, seq int")
    out = {r.k: r.v for r in upsert.upsert(tgt, src, ["k"], ["v"], source_order=["seq"]).collect()}
    assert out == {1: "c", 2: "x"}


def test_key_bucket_merge_touches_only_its_buckets(spark):
    import os
    import tempfile
    base = tempfile.mkdtemp(prefix="clinops-kb-")
    path = os.path.join(base, "patients")
    pts = upsert.with_key_bucket(spark.range(1000).selectExpr("id AS patient_no", "'old' AS name"),
                                 ["patient_no"], 16)
    pts.write.partitionBy("key_bucket").parquet(path)
    stamp = {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("key_bucket=")}
    src = upsert.with_key_bucket(spark.createDataFrame([(3, "new"), (5000, "ins")], "patient_no long, name string"),
                                 ["patient_no"], 16)
    touched = {f"key_bucket={r.key_bucket}" for r in src.collect()}
    upsert.merge_into_partitions(path, src, ["patient_no", "key_bucket"], ["name"], "key_bucket")
    after = {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("key_bucket=")}
    assert all(after[d] == stamp[d] for d in stamp if d not in touched)
    rows = {r.patient_no: r.name for r in spark.read.parquet(path).collect()}
    assert len(rows) == 1001 and rows[3] == "new" and rows[5000] == "ins" and rows[4] == "old"


def test_resolve_ambiguous_email_takes_smallest_patient_q14(spark):
    from clinops.operators import patient as P
    pts = spark.createDataFrame([(7, "a@x", "1"), (3, "a@x", "2"), (9, "b@x", "3")],
                                "patient_no long, patient_email string, patient_tel string")
    prof = spark.createDataFrame([(9, "U9")], "patient_no long, app_user_id string")
    req = spark.createDataFrame([("email", " a@x "), ("app_user_id", "U9"), ("patient_no", "+7"),
                                 ("patient_no", "x7"), ("tel", ""), ("email", None)], "by string, value string")
    got = [(r.by, r.value, r.patient_no) for r in P.resolve_patient(req, pts, prof).collect()]
    assert sorted(got, key=str) == sorted([("email", " a@x ", 3), ("app_user_id", "U9", 9), ("patient_no", "+7", 7),
                                           ("patient_no", "x7", None), ("tel", "", None), ("email", None, None)], key=str)


def test_encounter_fanout_needs_two_encounters(spark):
    import pytest
    one = spark.createDataFrame([(1, "COMPLETED")], "patient_no long, status string")
    with pytest.raises(ValueError):
        sync.encounter_fanout(one, NOW)
