"""Operations dashboard metrics (gauge, timeline, mix, league, KPI).

Every metric aggregates first (partial + final hash aggregation, so a hot
department or type is combined map-side) and only then touches a dimension
or a calendar spine, which are tiny by then.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinops.functions.common import (
    as_date, bounded_broadcast, date_lit, month_key, ts_lit, when_empty,
)
from clinops.functions.labels import treatment_type_bucket, treatment_type_label

# Fixed values of the reference's dashboard arithmetic.
GAUGE_FLOOR = 30000
GAUGE_GROWTH = 1.15
GAUGE_HEADROOM = 5000
GAUGE_TITLE = "금년 진료 헤더 건수"
REVENUE_PER_TREATMENT = 150_000
LEAGUE_TARGET_FACTOR = 1.08
LEAGUE_TARGET_DEFAULT = 250_000.0
KPI_TARGET_FACTOR = "1.025"
KPI_LABEL = "검사 일정과 검사 단가로 잡은 추정 매출"
NO_DATA = "데이터 없음"


def _month_start(as_of: _dt.date, back: int) -> _dt.date:
    y, m = as_of.year, as_of.month - back
    while m <= 0:
        m += 12
        y -= 1
    return _dt.date(y, m, 1)


def month_spine(spark, as_of, months: int) -> DataFrame:
    """``months`` calendar months ending with as_of's month:
    (month_idx, month 'yyyy-MM', label 'YY년 M월')."""
    as_of = as_date(as_of)
    start = _month_start(as_of, months - 1)
    m = F.add_months(date_lit(start), F.col("id").cast("int"))
    return spark.range(months).select(
        F.col("id").cast("int").alias("month_idx"),
        month_key(m).alias("month"),
        F.concat((F.year(m) % 100).cast("string"), F.lit("년 "),
                 F.month(m).cast("string"), F.lit("월")).alias("label"),
    )


def gauge(treatments: DataFrame, as_of) -> DataFrame:
    """Treatments in as_of's calendar year and the gauge capacity.

    ``YEAR(d) = YEAR(now)`` is written as a half-open range so it reaches the
    parquet scan as pushed filters.
    """
    as_of = as_date(as_of)
    lo, hi = _dt.date(as_of.year, 1, 1), _dt.date(as_of.year + 1, 1, 1)
    d = F.col("treatment_date")
    return gauge_from(treatments.where((d >= ts_lit(lo)) & (d < ts_lit(hi))).agg(F.count(F.lit(1)).alias("current")))


def gauge_from(current: DataFrame) -> DataFrame:
    """Capacity for a one-row ``current`` count."""
    n = current
    return n.select(
        "current",
        F.greatest(F.lit(GAUGE_FLOOR).cast("bigint"),
                   F.floor(F.col("current").cast("double") * F.lit(GAUGE_GROWTH)) + GAUGE_HEADROOM)
        .cast("bigint").alias("max_value"),
        F.lit(GAUGE_TITLE).alias("title"),
    )


def timeline(treatments: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Monthly treatment counts for the last ``months`` months, zero-filled.

    Lower bound only (quirk Q2): rows after as_of are counted into their own
    month and then dropped by the spine.
    """
    as_of = as_date(as_of)
    d = F.col("treatment_date")
    counts = (treatments.where(d >= ts_lit(_month_start(as_of, months - 1)))
              .groupBy(month_key(d).alias("month"))
              .agg(F.count(F.lit(1)).alias("c")))
    return timeline_from(counts, as_of, months)


def timeline_from(counts: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Zero-filled timeline from (month 'yyyy-MM', c) counts."""
    as_of = as_date(as_of)
    spine = month_spine(counts.sparkSession, as_of, months)
    # Both sides are bounded by the number of months after aggregation.
    return (spine.join(bounded_broadcast(counts), "month", "left")
            .select("month_idx", "month", "label",
                    F.coalesce(F.col("c"), F.lit(0)).cast("double").alias("value")))


def treatment_mix(treatments: DataFrame) -> DataFrame:
    """Count per treatment type (blank → 미분류), labelled, largest first."""
    agg = (treatments.groupBy(treatment_type_bucket(F.col("treatment_type")).alias("bucket"))
           .agg(F.count(F.lit(1)).alias("c")))
    return mix_from(agg)


FOLDED = "UNICODE_CI_AI"  # letters equal whatever their case and accents


def treatment_mix_folded(treatments: DataFrame, collation: str = FOLDED) -> DataFrame:
    """Count per treatment type under a string collation, as a server whose columns carry one groups them (quirk
    Q3): spellings that differ in case or accents are one type.  ``name`` is the smallest spelling in byte order,
    ``spellings`` their number; order is by the collation."""
    bucket = treatment_type_bucket(F.col("treatment_type"))
    per = treatments.groupBy(bucket.alias("spelling")).agg(F.count(F.lit(1)).alias("n"))  # few rows reach the collation
    return per.groupBy(F.collate("spelling", collation).alias("folded")).agg(
        F.min("spelling").alias("name"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("value")).orderBy(
        "folded").select("name", "spellings", "value")


def departments_named(names: DataFrame, department: DataFrame, collation: str = FOLDED) -> DataFrame:
    """(name, department_id) of asked names (column ``name``), joined under a collation."""
    asked = names.select("name", F.collate("name", collation).alias("__n"))
    known = department.select(F.col("id").alias("department_id"), F.collate("department_name", collation).alias("__n"))
    return asked.join(known, "__n").select("name", "department_id")


def mix_from(agg: DataFrame) -> DataFrame:
    """Labelled slices from (bucket, c)."""
    return agg.select(treatment_type_label(F.col("bucket")).alias("name"),
                      F.col("c").cast("double").alias("value"))


def treatment_mix_share(treatments: DataFrame) -> DataFrame:
    """Mix with total and percent share (post-aggregate frame: a handful of
    rows, so the global window is a single tiny partition)."""
    mix = treatment_mix(treatments)
    total = F.sum("value").over(Window.partitionBy())
    return mix.select("name", "value", total.alias("total"),
                      F.bround(F.col("value") * 100.0 / total, 2).alias("pct"))


def department_counts(department: DataFrame, treatments: DataFrame) -> DataFrame:
    """(department_id, department_name, c) — aggregate the fact first, then an
    inner join to the department dimension, which Spark broadcasts when its
    size in bytes allows."""
    per = (treatments.where(F.col("department_id").isNotNull())
           .groupBy("department_id").agg(F.count("treatment_id").alias("c")))
    return department_counts_from(department, per)


def department_counts_from(department: DataFrame, per: DataFrame) -> DataFrame:
    """Attach names to (department_id, c) with an inner join on the dimension."""
    dim = department.select(F.col("id").alias("department_id"), "department_name")
    return per.join(dim, "department_id")


def top_departments(counts: DataFrame, n: int) -> DataFrame:
    return _top(counts, n)


def _top(counts: DataFrame, n: int) -> DataFrame:
    w = Window.orderBy(F.desc("c"), F.asc("department_id"))
    # TakeOrderedAndProject keeps n rows per task; the window then runs on n rows.
    top = counts.orderBy(F.desc("c"), F.asc("department_id")).limit(n)
    return top.withColumn("rank", F.row_number().over(w))


def production_top(department: DataFrame, treatments: DataFrame, n: int = 3,
                   counts: DataFrame | None = None) -> DataFrame:
    """Top-n departments by treatment count; one sentinel row when empty."""
    counts = counts if counts is not None else department_counts(department, treatments)
    top = _top(counts, n).select(
        "rank", "department_id",
        F.substring("department_name", 1, 24).alias("category"),
        F.col("c").cast("double").alias("value"))
    sentinel = counts.sparkSession.range(1).select(
        F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("department_id"),
        F.lit(NO_DATA).alias("category"), F.lit(0.0).alias("value"))
    return when_empty(top, sentinel)


def league_table(department: DataFrame, treatments: DataFrame, as_of, n: int = 5,
                 months: int = 6, counts: DataFrame | None = None) -> DataFrame:
    """Top-n departments with estimated revenue, target and a monthly sparkline.

    Two stages: the top-n ids (bounded by n) are broadcast into a left-semi
    join that prunes the month counts before their shuffle.
    """
    as_of = as_date(as_of)
    counts = counts if counts is not None else department_counts(department, treatments)
    top = _top(counts, n)
    d = F.col("treatment_date")
    recent = (treatments.where(d >= ts_lit(_month_start(as_of, months - 1)))
              .join(bounded_broadcast(top.select("department_id")), "department_id", "left_semi")
              .groupBy("department_id", month_key(d).alias("month"))
              .agg(F.count(F.lit(1)).alias("mc")))
    return league_from(top, recent, as_of, months)


def league_from(top: DataFrame, recent: DataFrame, as_of, months: int = 6) -> DataFrame:
    """League rows from the ranked top-n (rank, department_id,
    department_name, c) and (department_id, month, mc) counts."""
    as_of = as_date(as_of)
    month_keys = [_month_start(as_of, months - 1 - i).strftime("%Y-%m") for i in range(months)]
    spine = top.select("rank", "department_id", "department_name", "c",
                       F.posexplode(F.array(*[F.lit(k) for k in month_keys])).alias("month_idx", "month"))
    series = (spine.join(recent, ["department_id", "month"], "left")
              .withColumn("mc", F.coalesce(F.col("mc"), F.lit(0)).cast("double")))
    grouped = (series.groupBy("rank", "department_id", "department_name", "c")
               .agg(F.sort_array(F.collect_list(F.struct("month_idx", "mc"))).alias("pts")))
    actual = F.col("c").cast("double") * F.lit(float(REVENUE_PER_TREATMENT))
    raw_spark = F.transform("pts", lambda p: p["mc"])
    total = F.aggregate(raw_spark, F.lit(0.0), lambda acc, x: acc + x)
    fallback = F.array_repeat(F.greatest(F.lit(1.0), F.col("c").cast("double") / 6.0), months)
    return grouped.select(
        "rank", "department_id",
        F.substring("department_name", 1, 32).alias("name"),
        actual.alias("actual"),
        F.when(actual > 0, actual * F.lit(LEAGUE_TARGET_FACTOR))
         .otherwise(F.lit(LEAGUE_TARGET_DEFAULT)).alias("target"),
        F.when(total == 0, fallback).otherwise(raw_spark).alias("spark"),
    )


def league_rows(league: DataFrame) -> DataFrame:
    """Sparkline exploded to one row per month (flat form for comparison)."""
    return league.select("rank", "department_id", "name", "actual", "target",
                         F.posexplode("spark").alias("month_idx", "spark_value"))


def league_ranked(league: DataFrame) -> DataFrame:
    """Rank number and the sparkline target line ``max(spark ∪ {1}) * 0.9``."""
    return league.select("rank", "department_id", "name", "actual", "target",
                         (F.greatest(F.array_max("spark"), F.lit(1.0)) * 0.9).alias("target_line"))


def kpi_revenue(schedule: DataFrame, examination: DataFrame) -> DataFrame:
    """Estimated revenue = Σ price over scheduled examinations; target ×1.025.

    Counts schedules per examination first (map-side combine, so a hot
    examination never crosses the network as raw rows), then joins prices and
    sums exact decimals.
    """
    per_exam = schedule.groupBy("examination_id").agg(F.count(F.lit(1)).alias("n"))
    priced = per_exam.join(examination.select("examination_id", "examination_price"), "examination_id")
    rev = priced.agg(F.sum(F.col("examination_price") * F.col("n")).alias("rev"))
    r = F.greatest(F.coalesce(F.col("rev"), F.lit(0).cast("decimal(38,2)")), F.lit(0).cast("decimal(38,2)"))
    return rev.select(
        r.cast("double").alias("actual"),
        F.bround(r * F.lit(KPI_TARGET_FACTOR).cast("decimal(4,3)"), 2).cast("double").alias("target"),
        F.lit(KPI_LABEL).alias("label"),
    )


def kpi_growth(treatments: DataFrame, as_of) -> DataFrame:
    """Last 30 days vs the 30 before, in one scan with two conditional counts."""
    as_of = as_date(as_of)
    d30, d60 = as_of - _dt.timedelta(days=30), as_of - _dt.timedelta(days=60)
    d = F.col("treatment_date")
    cnt = (treatments.where(d >= ts_lit(d60))
           .agg(F.count_if(d >= ts_lit(d30)).alias("r30"),
                F.count_if(d < ts_lit(d30)).alias("p30")))
    return kpi_growth_from(cnt)


def kpi_growth_from(cnt: DataFrame) -> DataFrame:
    """Growth block from one row of (r30, p30)."""
    r30, p30 = F.col("r30"), F.col("p30")
    growth = (F.when(p30 <= 0, F.when(r30 > 0, F.lit(4.0)).otherwise(F.lit(0.0)))
              .otherwise(F.bround((r30 - p30).cast("double") / p30.cast("double") * 100.0, 1)))
    return cnt.select(
        "r30", "p30", growth.alias("growth_pct"),
        F.when(growth >= 0, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
        F.abs(growth).alias("magnitude"),
    )
