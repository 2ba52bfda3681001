"""Crash-safe sync job: rerun and crash-between-writes leave exact results."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from clinops.operators import sync
from clinops.plans.jobs import run_daily_sync, run_treatments_sync, run_vitals_sync
from clinops.sources.tables import load_view

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 1, 30, 12, 0)


def _source(spark, base):
    path = os.path.join(base, "source")
    load_view(spark, SF, "user_vital_measurement").withColumn("day", F.to_date("measured_at")) \
        .write.partitionBy("day").parquet(path)
    return path


def test_rerun_is_a_noop(spark):
    base = tempfile.mkdtemp(prefix="clinops-job-")
    src, tgt = _source(spark, base), os.path.join(base, "target")
    pending = spark.read.parquet(src).where("synced_to_mysql_at IS NULL").count()
    first = run_vitals_sync(spark, src, tgt, NOW)
    assert first["examined"] == pending and first["inserted"] == pending
    assert spark.read.parquet(src).where("synced_to_mysql_at IS NULL").count() == 0
    second = run_vitals_sync(spark, src, tgt, NOW)
    assert second == {"examined": 0, "errors": 0, "inserted": 0, "marked": 0}
    assert spark.read.parquet(tgt).count() == pending


def test_crash_between_writes_then_rerun(spark):
    base = tempfile.mkdtemp(prefix="clinops-job-")
    src, tgt = _source(spark, base), os.path.join(base, "target")
    total = spark.read.parquet(src).count()
    pending = spark.read.parquet(src).where("synced_to_mysql_at IS NULL").count()
    crashed = run_vitals_sync(spark, src, tgt, NOW, stop_after_target=True)
    assert crashed["inserted"] == pending
    assert spark.read.parquet(src).where("synced_to_mysql_at IS NULL").count() == pending   # markers not written
    again = run_vitals_sync(spark, src, tgt, NOW)
    assert again["examined"] == pending and again["inserted"] == 0          # nothing copied twice
    assert spark.read.parquet(tgt).count() == pending
    assert spark.read.parquet(src).count() == total                         # no source row lost
    assert spark.read.parquet(src).where("synced_to_mysql_at IS NULL").count() == 0


def test_refused_readings_are_counted_stored_once_and_tried_again(spark):
    base = tempfile.mkdtemp(prefix="clinops-job-")
    src, tgt, bad = _source(spark, base), os.path.join(base, "target"), os.path.join(base, "rejects")
    pending = spark.read.parquet(src).where("synced_to_mysql_at IS NULL")
    n, refused = pending.count(), sync.quarantine(pending)[1].count()
    run = run_vitals_sync(spark, src, tgt, NOW, rules=sync.vital_rules(), rejects_path=bad)
    assert 0 < refused < n and run["errors"] == refused and run["examined"] == n
    assert run["marked"] == run["inserted"] == n - refused
    assert spark.read.parquet(bad).count() == refused
    again = run_vitals_sync(spark, src, tgt, NOW, rules=sync.vital_rules(), rejects_path=bad)
    assert again == {"examined": refused, "errors": refused, "inserted": 0, "marked": 0}
    assert spark.read.parquet(bad).count() == refused                       # not stored twice
    run_vitals_sync(spark, src, tgt, NOW)                                   # without rules they are copied
    assert spark.read.parquet(tgt).count() == n


def test_counters_need_no_recount(spark, monkeypatch):
    """Every counter comes from the job that writes: no count() is called."""
    from pyspark.sql import DataFrame

    base = tempfile.mkdtemp(prefix="clinops-job-")
    src = _source(spark, base)

    def no(self):
        raise AssertionError("recount")

    monkeypatch.setattr(type(spark.range(1)), "count", no)
    assert isinstance(spark.range(1), DataFrame)
    assert run_vitals_sync(spark, src, os.path.join(base, "target"), NOW)["inserted"] > 0


def test_daily_sync_reruns_and_recovers(spark):
    base = tempfile.mkdtemp(prefix="clinops-job-")
    src, tgt, bad = (os.path.join(base, d) for d in ("daily", "target", "rejects"))
    d = load_view(spark, SF, "user_daily_wellness")
    odd = d.limit(2).withColumn("patient_no", F.col("patient_no") + 1_000_000).withColumn("synced_to_mysql_at", F.lit(None).cast("timestamp_ntz"))
    odd = odd.withColumn("step_count", F.lit(-1).cast("bigint")).cache()
    d.unionByName(odd).withColumn("day", F.col("summary_date")).write.partitionBy("day").parquet(src)
    pending = spark.read.parquet(src).where("synced_to_mysql_at IS NULL").count()
    options = {"rules": sync.daily_rules(), "rejects_path": bad}
    crashed = run_daily_sync(spark, src, tgt, NOW, stop_after_target=True, **options)
    refused = crashed["errors"]
    assert refused >= 2 and crashed["copied"] == pending - refused and not os.path.exists(bad)
    run = run_daily_sync(spark, src, tgt, NOW, **options)
    assert run == {"examined": pending, "errors": refused, "copied": pending - refused, "marked": pending - refused}
    want = sync.quarantine(sync.daily_copy_rows(spark.read.parquet(src), NOW), sync.daily_rules())[0]
    got = spark.read.parquet(tgt)
    assert got.count() == pending - refused
    assert got.drop("day").exceptAll(want.select(*got.drop("day").columns)).count() == 0
    assert run_daily_sync(spark, src, tgt, NOW, **options)["copied"] == 0
    assert spark.read.parquet(bad).count() == refused


def test_treatments_sync_reruns_and_recovers(spark):
    base = tempfile.mkdtemp(prefix="clinops-job-")
    src, tgt = os.path.join(base, "treatments"), os.path.join(base, "events")
    t = load_view(spark, SF, "treatments")
    t.withColumn("day", F.to_date("treatment_date")).write.partitionBy("day").parquet(src)
    pending = sync.pending_treatments(spark.read.parquet(src)).count()
    crashed = run_treatments_sync(spark, src, tgt, NOW, limit=40, stop_after_target=True)
    assert crashed == {"examined": 40, "errors": 0, "inserted": 40, "skipped_existing": 0, "marked": 0}
    run = run_treatments_sync(spark, src, tgt, NOW)
    assert run == {"examined": pending, "errors": 0, "inserted": pending - 40, "skipped_existing": 40, "marked": pending}
    ids = [r.clinical_event_id for r in spark.read.parquet(tgt).collect()]
    assert sorted(ids) == list(range(1, pending + 1))                       # dense over both runs
    assert spark.read.parquet(tgt).select("source_mysql_treatment_id").distinct().count() == pending
    assert spark.read.parquet(src).count() == t.count()
    assert sync.pending_treatments(spark.read.parquet(src)).count() == 0
