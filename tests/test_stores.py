"""Stored profiles and the identifier index: equal to the full computation, touching only what changed."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from clinops.operators import identifiers, patient, profile
from clinops.plans import profile_store as store
from clinops.sources.tables import load_view

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(1998, 7, 20)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def check(spark, table, kept):
    full = {"t": (spark.read.parquet(table), AS_OF)}
    partial = store.partials(spark, kept)
    same(store.stored_stats(partial, "t", AS_OF), profile.table_stats(full))
    same(store.stored_trend(partial, "t", AS_OF, 400), profile.table_daily_trend(full, 400))


def test_stored_profile_follows_appends_rewrites_and_removed_days(spark):
    base = tempfile.mkdtemp(prefix="clinops-store-")
    table, kept = os.path.join(base, "table"), os.path.join(base, "store")
    t = load_view(spark, SF, "treatments").select("treatment_id", "created_date", F.to_date("treatment_date").alias("day"))
    t = t.where("day >= '1998-06-01'").withColumn("created_date", F.when(F.col("treatment_id") % 7 != 0, F.col("created_date")))
    days = [r.day for r in t.select("day").distinct().orderBy("day").collect()]
    write = lambda df, mode: df.write.mode(mode).partitionBy("day").parquet(table)
    write(t.where(F.col("day") < days[-2]), "append")
    assert len(store.update_profile(spark, table, kept)) == len(days) - 2
    check(spark, table, kept)
    assert store.update_profile(spark, table, kept) == []                         # nothing changed, nothing read
    write(t.where(F.col("day") >= days[-3]), "append")                            # two new days, one appended to
    assert store.update_profile(spark, table, kept) == [str(d) for d in days[-3:]]
    check(spark, table, kept)
    day = t.where(F.col("day") == days[0]).limit(1)
    day.checkpoint().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)
    assert store.update_profile(spark, table, kept) == [str(days[0])]             # a rewritten day
    check(spark, table, kept)
    fs = spark._jvm.org.apache.hadoop.fs.Path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/day={days[1]}"), True)
    assert store.update_profile(spark, table, kept) == []                         # a removed day drops out
    check(spark, table, kept)


def test_stored_profile_before_the_first_run(spark):
    empty = store.partials(spark, tempfile.mkdtemp(prefix="clinops-store-"))
    assert [r.total_count for r in store.stored_stats(empty, "t", AS_OF).collect()] == [0]
    assert store.stored_trend(empty, "t", AS_OF).collect() == []


def test_interrupted_update_is_repeated(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="clinops-store-")
    table, kept = os.path.join(base, "table"), os.path.join(base, "store")
    t = load_view(spark, SF, "treatments").select("treatment_id", "created_date", F.lit("a").alias("day"))
    t.write.partitionBy("day").parquet(table)
    write = store.write_snapshot
    monkeypatch.setattr(store, "write_snapshot", lambda *a, **k: None)            # stops before the commit
    store.update_profile(spark, table, kept)
    assert store.partials(spark, kept).collect() == []
    monkeypatch.setattr(store, "write_snapshot", write)
    assert store.update_profile(spark, table, kept) == ["a"]
    check(spark, table, kept)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "by string, value string")


def test_index_answers_like_the_scan_and_reads_few_buckets(spark):
    p, pr = load_view(spark, SF, "Patient"), load_view(spark, SF, "user_app_profile")
    path = os.path.join(tempfile.mkdtemp(prefix="clinops-idx-"), "index")
    identifiers.build_index(p, pr, path)
    req = requests(spark, ("patient_no", " 7 "), ("patient_no", "x"), ("app_user_id", "U11"), ("email", ""), ("email", None),
                   ("tel", "no such"), ("other", "7"), ("patient_no", "007"))
    out = identifiers.resolve_indexed(req, path)
    same(out, patient.resolve_patient(req, p, pr))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    three = identifiers._some_buckets(spark, path, req.select(F.lit(3).alias("bucket")))
    files = [r[0] for r in three.select(F.input_file_name()).distinct().collect()]
    assert files and all("bucket=3/" in f for f in files)


def test_index_follows_changed_patients(spark):
    cols = "patient_no long, patient_email string, patient_tel string"
    old = spark.createDataFrame([(1, "a@x", "010"), (2, "a@x", "011"), (3, "c@x", None)], cols)
    new = spark.createDataFrame([(1, "z@x", "010"), (3, None, None)], cols)
    prof = spark.createDataFrame([(2, "U2")], "patient_no long, app_user_id string")
    none = prof.limit(0)
    path = os.path.join(tempfile.mkdtemp(prefix="clinops-idx-"), "index")
    identifiers.build_index(old, prof, path, 4)
    ask = requests(spark, ("email", "a@x"), ("email", "z@x"), ("email", "c@x"), ("tel", "010"), ("patient_no", "3"))
    answers = lambda: {(r.by, r.value): r.patient_no for r in identifiers.resolve_indexed(ask, path, 4).collect()}
    assert answers() == {("email", "a@x"): 1, ("email", "z@x"): None, ("email", "c@x"): 3, ("tel", "010"): 1, ("patient_no", "3"): 3}
    before, after = identifiers.identifiers(old.where("patient_no <> 2"), none), identifiers.identifiers(new, none)
    for _ in range(2):                                                            # a replay changes nothing
        identifiers.refresh_index(path, before, after, 4)
        assert answers() == {("email", "a@x"): 2, ("email", "z@x"): 1, ("email", "c@x"): None, ("tel", "010"): 1,
                             ("patient_no", "3"): 3}
    assert spark.read.parquet(path).where("key is null").count() == 4
