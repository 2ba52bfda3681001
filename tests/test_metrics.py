"""Dashboard metrics on hand-made treatments frames with hand-computed answers."""

import datetime as dt

from clinops.operators import metrics

TSCHEMA = "treatment_id long, department_id long, treatment_type string, treatment_date timestamp_ntz"
DSCHEMA = "id long, department_name string"


def tr(spark, rows):
    return spark.createDataFrame(rows, TSCHEMA)


def test_timeline_gap_fill_labels_and_future_rows(spark):
    t = tr(spark, [(1, 1, "OUTPATIENT", dt.datetime(2023, 12, 5)),
                   (2, 1, "OUTPATIENT", dt.datetime(2024, 1, 9)),
                   (3, 1, "OUTPATIENT", dt.datetime(2024, 1, 20)),
                   (4, 1, "OUTPATIENT", dt.datetime(2024, 3, 1)),     # after as_of: own month, dropped
                   (5, 1, "OUTPATIENT", dt.datetime(2023, 10, 31))])  # before the window
    out = metrics.timeline(t, dt.date(2024, 2, 10), months=3).orderBy("month_idx").collect()
    assert [(r.month, r.label, r.value) for r in out] == [
        ("2023-12", "23년 12월", 1.0), ("2024-01", "24년 1월", 2.0), ("2024-02", "24년 2월", 0.0)]


def test_gauge_year_range_and_capacity(spark):
    rows = [(i, 1, "X", dt.datetime(2024, 1 + i % 12, 1)) for i in range(30)] + [(99, 1, "X", dt.datetime(2023, 12, 31, 23))]
    g = metrics.gauge(tr(spark, rows), dt.date(2024, 6, 1)).collect()[0]
    assert (g.current, g.max_value) == (30, 30000)
    assert metrics.gauge(tr(spark, rows), dt.date(2023, 6, 1)).collect()[0].current == 1


def test_mix_buckets_blank_and_labels(spark):
    t = tr(spark, [(1, 1, "OUTPATIENT", None), (2, 1, " ", None), (3, 1, None, None), (4, 1, "LAB", None)])
    got = sorted((r.name, r.value) for r in metrics.treatment_mix(t).collect())
    assert got == [("LAB", 1.0), ("미분류", 2.0), ("외래", 1.0)]
    share = {r.name: r.pct for r in metrics.treatment_mix_share(t).collect()}
    assert share["미분류"] == 50.0


def test_production_top_ties_and_sentinel(spark):
    d = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], DSCHEMA)
    t = tr(spark, [(1, 2, "X", None), (2, 1, "X", None), (3, 3, "X", None), (4, 3, "X", None)])
    out = metrics.production_top(d, t, n=2).orderBy("rank").collect()
    assert [(r.rank, r.category, r.value) for r in out] == [(1, "C", 2.0), (2, "A", 1.0)]  # tie → smaller id
    empty = metrics.production_top(d, tr(spark, []), n=2).collect()
    assert [(r.category, r.value) for r in empty] == [("데이터 없음", 0.0)]


def test_league_fallback_series_and_target(spark):
    d = spark.createDataFrame([(1, "A"), (2, "B")], DSCHEMA)
    rows = [(i, 1, "X", dt.datetime(2020, 1, 1)) for i in range(12)]          # old rows only → fallback
    rows += [(100, 2, "X", dt.datetime(2024, 5, 3)), (101, 2, "X", dt.datetime(2024, 6, 3))]
    lg = {r.department_id: r for r in metrics.league_table(d, tr(spark, rows), dt.date(2024, 6, 15), n=5).collect()}
    assert lg[1].spark == [2.0] * 6                      # max(1, 12/6)
    assert lg[1].actual == 12 * 150000.0 and lg[1].target == 12 * 150000.0 * 1.08
    assert lg[2].spark == [0.0, 0.0, 0.0, 0.0, 1.0, 1.0]
    ranked = {r.department_id: r.target_line for r in metrics.league_ranked(
        metrics.league_table(d, tr(spark, rows), dt.date(2024, 6, 15))).collect()}
    assert ranked[2] == 0.9


def test_kpi_growth_edges(spark):
    def g(rows):
        return metrics.kpi_growth(tr(spark, rows), dt.date(2024, 3, 1)).collect()[0]
    cur, prev = dt.datetime(2024, 2, 20), dt.datetime(2024, 1, 15)
    r = g([])
    assert (r.r30, r.p30, r.growth_pct, r.direction) == (0, 0, 0.0, "up")
    assert g([(1, 1, "X", cur)]).growth_pct == 4.0
    assert g([(1, 1, "X", cur), (2, 1, "X", prev)]).growth_pct == 0.0
    r = g([(1, 1, "X", prev), (2, 1, "X", prev)])
    assert (r.growth_pct, r.direction, r.magnitude) == (-100.0, "down", 100.0)
    r = g([(i, 1, "X", cur) for i in range(9)] + [(100 + i, 1, "X", prev) for i in range(8)])
    assert r.growth_pct == 12.5
    # 1/8 = 12.5% → 112.5 → half-even at one decimal stays 112.5; 1/16 = 6.25 → 6.2
    r = g([(i, 1, "X", cur) for i in range(17)] + [(100 + i, 1, "X", prev) for i in range(16)])
    assert r.growth_pct == 6.2


def test_kpi_revenue_exact_decimal(spark):
    sched = spark.createDataFrame([(1,), (1,), (2,), (3,)], "examination_id long")
    exam = spark.createDataFrame([(1, "10.10"), (2, "0.05")], "examination_id long, p string").selectExpr(
        "examination_id", "CAST(p AS DECIMAL(18,2)) AS examination_price")
    r = metrics.kpi_revenue(sched, exam).collect()[0]
    assert r.actual == 20.25 and r.target == 20.76          # 20.25 * 1.025 = 20.75625 → 20.76
    empty = metrics.kpi_revenue(spark.createDataFrame([], "examination_id long"), exam).collect()[0]
    assert (empty.actual, empty.target) == (0.0, 0.0)


def test_snapshot_blocks_equal_single_metrics(spark):
    """The one-pass summary path gives the same blocks as the single metrics."""
    import json
    from clinops.plans import snapshot
    from clinops.sources.tables import OPS_AS_OF, load_view
    sf = "/root/testdata/sf0.001"
    dept, t, sched, exam = (load_view(spark, sf, n) for n in
                            ("department", "treatments", "examination_schedule", "examination"))
    snap = json.loads(snapshot.to_json_row(snapshot.operations_snapshot(dept, t, sched, exam, OPS_AS_OF))
                      .collect()[0][0])
    g = metrics.gauge(t, OPS_AS_OF).collect()[0]
    assert snap["gauge"]["current"] == g.current and snap["gauge"]["max_value"] == g.max_value
    tl = metrics.timeline(t, OPS_AS_OF).orderBy("month_idx").collect()
    assert snap["timeline"]["values"] == [r.value for r in tl]
    assert snap["timeline"]["labels"] == [r.label for r in tl]
    assert sorted((p["name"], p["value"]) for p in snap["pie_sales"]) == sorted(
        (r.name, r.value) for r in metrics.treatment_mix(t).collect())
    lg = metrics.league_table(dept, t, OPS_AS_OF).orderBy("rank").collect()
    assert [(x["name"], x["spark"]) for x in snap["league_table"]] == [(r.name, r.spark) for r in lg]
    kg = metrics.kpi_growth(t, OPS_AS_OF).collect()[0]
    assert snap["kpi"]["growth_pct"] == kg.growth_pct
    pt = metrics.production_top(dept, t).orderBy("rank").collect()
    assert snap["production"]["values"] == [r.value for r in pt]


def test_kpi_growth_counts_future_rows_quirk_q2(spark):
    rows = [(1, 1, "X", dt.datetime(2024, 2, 20)), (2, 1, "X", dt.datetime(2024, 5, 1))]   # second is after as_of
    r = metrics.kpi_growth(tr(spark, rows), dt.date(2024, 3, 1)).collect()[0]
    assert r.r30 == 2      # lower bound only, as the reference's window
