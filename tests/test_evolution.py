"""Stored tables that gain and widen columns, and grouping and joining under a collation."""

import datetime as dt
import decimal
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from clinops.operators import metrics
from clinops.sources import evolution


def files(path):
    return {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in os.listdir(path) if f.endswith(".parquet")}


def test_columns_are_added_and_widened_without_rewriting_files(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="clinops-evo-"), "t")
    old = spark.createDataFrame([(1, 1.5, dt.date(2024, 1, 2), decimal.Decimal("1.25"), 7)],
                                "id int, x float, d date, m decimal(5,2), k int")
    old.coalesce(1).write.parquet(path)
    before = files(path)
    evolution.evolve_table(spark, path, {"note": "string"}, {"id": "bigint", "x": "double", "d": "timestamp_ntz",
                                                             "m": "decimal(20,4)", "k": "double"})
    assert files(path) == before
    new = spark.createDataFrame([(2**40, 0.1, "n", 3)], "id bigint, x double, note string, k int")
    evolution.append_table(new, path)
    rows = {r.id: r for r in evolution.read_table(spark, path).collect()}
    assert set(rows) == {1, 2**40} and all(files(path)[f] == t for f, t in before.items())
    assert tuple(rows[1]) == (1, 1.5, dt.datetime(2024, 1, 2), decimal.Decimal("1.2500"), 7.0, None)
    assert tuple(rows[2**40]) == (2**40, 0.1, None, None, 3.0, "n")
    assert evolution.evolve_table(spark, path, {"note": "string"}) == evolution.declared_schema(spark, path)  # again: nothing
    assert evolution.read_table(spark, path).where("id > 5").count() == 1


def test_changes_that_need_a_rewrite_are_refused(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="clinops-evo-"), "t")
    spark.createDataFrame([(1, "a")], "id bigint, s string").write.parquet(path)
    for add, widen in (({}, {"id": "int"}), ({}, {"s": "bigint"}), ({}, {"no": "bigint"}), ({"id": "string"}, {})):
        with pytest.raises(ValueError):
            evolution.evolve_table(spark, path, add, widen)
    assert evolution.declared_schema(spark, path) is None
    evolution.evolve_table(spark, path, {"z": "int"})
    for bad in (spark.createDataFrame([(1,)], "other int"), spark.createDataFrame([(2**40,)], "z bigint")):
        with pytest.raises(ValueError):
            evolution.append_table(bad, path)
    assert [tuple(r) for r in evolution.read_table(spark, path).collect()] == [(1, "a", None)]


def test_folded_mix_and_join(spark):
    t = spark.createDataFrame([("Émergency",), ("EMERGENCY",), ("emergency",), ("Outpatient",), (None,), ("",)], "treatment_type string")
    got = [(r.name, r.spellings, r.value) for r in metrics.treatment_mix_folded(t).collect()]
    assert ("EMERGENCY", 3, 3) in got and ("Outpatient", 1, 1) in got and len(got) == 3
    dep = spark.createDataFrame([(1, "Cardiología"), (2, "Surgery")], "id long, department_name string")
    ask = spark.createDataFrame([("CARDIOLOGIA",), ("surgery",), ("x",)], "name string")
    out = {(r.name, r.department_id) for r in metrics.departments_named(ask, dep).collect()}
    assert out == {("CARDIOLOGIA", 1), ("surgery", 2)}
    plan = metrics.treatment_mix_folded(t.withColumn("k", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
