"""Table profile helpers, KPI cards and small display helpers."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from clinops.functions import display
from clinops.operators import profile, upsert
from clinops.sources.tables import OPS_TABLES, UnboundTable, load_view

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2001, 8, 1)


def test_table_detail_allow_list_and_parts(spark):
    tables = {"treatments": (load_view(spark, SF, "treatments"), AS_OF)}
    d = profile.table_detail(tables, "treatments", key="treatment_id", captions=dict(OPS_TABLES))
    assert d["stats"].collect()[0].table_name_kr == "진료"
    assert d["rows"].count() == 20
    assert [r.column_name for r in d["columns"].collect()][:2] == ["treatment_id", "checkIn_id"]
    with pytest.raises(ValueError):
        profile.table_detail(tables, "users; drop", key="id")


def test_table_counts_unbound_is_minus_one(spark):
    def loader(name):
        return load_view(spark, SF, name)
    with pytest.raises(UnboundTable):
        loader("no_such_table")
    out = {r.table_key: (r.total_count, r.chart_count) for r in profile.table_counts(
        spark, [("Patient", "p"), ("no_such_table", "i")], loader).collect()}
    assert out["no_such_table"] == (-1, 0) and out["Patient"][0] > 0


def test_table_search_paging_clamp(spark):
    stats = spark.createDataFrame([(i, f"t{i}", f"표{i}", 1, 0, None) for i in range(1, 13)],
                                  "ordinal int, table_name string, table_name_kr string, total_count long, "
                                  "today_count long, last_created_at string")
    p3 = profile.table_search(stats, "", page=9).collect()          # clamped to the last page
    assert [r.ordinal for r in p3] == [11, 12] and p3[0].total_pages == 3
    assert [r.ordinal for r in profile.table_search(stats, " T1 ", page=0).collect()] == [1, 10, 11, 12]
    none = profile.table_search(stats, "zzz", page=1).collect()
    assert none == []


def test_kpi_cards_placeholder(spark):
    counts = spark.createDataFrame([("Patient", 5)], "table_key string, total_count long")
    agg = spark.createDataFrame([(10, 2, 3, None, 4)], "total_vitals long, today_vitals long, "
                                "pending_mysql_sync long, avg_heart_rate_24h double, pending_daily_mysql_sync long")
    cards = {r.ordinal: (r.label, r.value) for r in profile.kpi_cards(counts, agg).collect()}
    assert cards[1] == ("환자 마스터", "5") and cards[2][1] == "—" and cards[8][1] == "—" and cards[3][1] == "10"


def test_small_display_helpers(spark):
    df = spark.createDataFrame([(120, None, 1234567.4), (None, 80, 0.0)], "s int, d int, m double")
    out = df.select(display.blood_pressure_text(F.col("s"), F.col("d")).alias("bp"),
                    display.krw(F.col("m")).alias("krw")).collect()
    assert [(r.bp, r.krw) for r in out] == [("120/", "₩1,234,567"), ("/80", "₩0")]
    arr = spark.range(1).select(display.chart_order(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("a")).collect()
    assert arr[0].a == [3, 2, 1]


def test_append_to_and_snapshot_versions(spark):
    base = tempfile.mkdtemp(prefix="clinops-app-")
    p = os.path.join(base, "t")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    upsert.append_to(df, p)
    upsert.append_to(df.withColumn("k", F.lit(2).cast("long")), p)
    assert sorted(r.k for r in spark.read.parquet(p).collect()) == [1, 2]
    snap = os.path.join(base, "s")
    assert upsert.read_snapshot(spark, snap) is None
    upsert.write_snapshot(df, snap, 1)
    upsert.write_snapshot(df.union(df), snap, 2)
    assert upsert.latest_version(spark, snap) == "2" and upsert.read_snapshot(spark, snap).count() == 2


def test_one_scan_profiles_equal_per_view_profiles(spark):
    from clinops.plans import profiles as PP
    from clinops.sources.tables import OPS_TABLES, VIEWS, view_as_of
    names = [n for n, _ in OPS_TABLES if n in VIEWS]
    caps, order = dict(OPS_TABLES), [n for n, _ in OPS_TABLES]
    per_view = {n: (load_view(spark, SF, n), view_as_of(n)) for n in names}
    a = profile.table_stats(per_view, caps, order)
    b = PP.bound_table_stats(spark, SF, names, caps, order)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    ta, tb = profile.table_daily_trend(per_view), PP.bound_daily_trend(spark, SF, names)
    assert ta.exceptAll(tb).count() == 0 and tb.exceptAll(ta).count() == 0
    scans = PP.bound_table_stats(spark, SF, names, caps, order)._jdf.queryExecution().executedPlan().toString()
    assert scans.count("orders.parquet") == 1          # nine views of orders, one scan


def test_one_scan_counts_equal_loader_counts(spark):
    from clinops.plans import profiles as PP
    from clinops.sources.tables import PG_TABLES
    a = profile.table_counts(spark, list(PG_TABLES), lambda n: load_view(spark, SF, n))
    b = PP.bound_table_counts(spark, SF, list(PG_TABLES))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
