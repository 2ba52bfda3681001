"""Table profiles: counts, today's rows, newest row time, daily trend,
column catalog, newest rows (masked and formatted), search with paging.

The reference loops one SQL statement per table; here every table becomes
one aggregate branch of a single ``unionByName`` plan, so the scans run as
concurrent stages of one job.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinops.functions.common import as_date, day_key, union_all
from clinops.functions.display import format_cells, format_timestamp_ntz
from clinops.operators.mask import sanitize

PAGE_SIZE = 5
TREND_DAYS = 14


def table_stats(tables: Mapping[str, tuple[DataFrame, object]],
                captions: Mapping[str, str] | None = None,
                order: list[str] | None = None) -> DataFrame:
    """Per table: total rows, rows created on/after as_of's day, newest
    ``created_date`` (captioned).  ``tables``: name → (frame, as_of)."""
    captions = captions or {}
    order = order or list(tables)
    parts = []
    for name, (df, as_of) in tables.items():
        day = _dt.datetime.combine(as_date(as_of), _dt.time())
        c = F.col("created_date")
        parts.append(df.agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count_if(c >= F.lit(day.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")).alias("today_count"),
            F.max(c).alias("last_created"),
        ).select(
            F.lit(order.index(name) + 1 if name in order else 0).alias("ordinal"),
            F.lit(name).alias("table_name"),
            F.lit(captions.get(name, name)).alias("table_name_kr"),
            "total_count", "today_count",
            format_timestamp_ntz(F.col("last_created")).alias("last_created_at"),
        ))
    return union_all(parts)


def table_daily_trend(tables: Mapping[str, tuple[DataFrame, object]],
                      days: int = TREND_DAYS) -> DataFrame:
    """Rows per created day over the last ``days`` days (lower bound only,
    not gap-filled, as the reference)."""
    parts = []
    for name, (df, as_of) in tables.items():
        lo = as_date(as_of) - _dt.timedelta(days=days - 1)
        c = F.col("created_date")
        parts.append(
            df.where(c >= F.lit(f"{lo} 00:00:00").cast("timestamp_ntz"))
            .groupBy(day_key(c).alias("day"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit(name).alias("table_name"), "day", "count"))
    return union_all(parts)


def table_counts(spark: SparkSession, tables: list[tuple[str, str]],
                 loader: Callable[[str], DataFrame]) -> DataFrame:
    """Row count per table; a table that cannot be loaded reports -1.

    The load is attempted on the driver (plan only, no data); the counts are
    one union plan.  ``chart_count`` clamps at 0 for the bar chart.
    """
    parts = []
    for i, (name, caption) in enumerate(tables):
        try:
            df = loader(name)
            cnt = df.agg(F.count(F.lit(1)).alias("total_count"))
        except LookupError:
            cnt = spark.range(1).select(F.lit(-1).cast("bigint").alias("total_count"))
        parts.append(cnt.select(
            F.lit(i + 1).alias("ordinal"), F.lit(name).alias("table_key"),
            F.lit(caption).alias("label_kr"), F.lit(name).alias("sql_name"),
            "total_count", F.greatest(F.lit(0).cast("bigint"), F.col("total_count")).alias("chart_count")))
    return union_all(parts)


def table_search(stats: DataFrame, query: str, page: int = 1,
                 page_size: int = PAGE_SIZE) -> DataFrame:
    """Case-insensitive search over name and caption, then one page.

    Page number is clamped into [1, pages]; pages = max(1, ceil(n / size)).
    ``stats`` is one row per table (tens of rows), so the global windows
    below run on a tiny frame.
    """
    q = (query or "").strip().lower()
    hits = stats
    if q:
        hits = stats.where(F.lower(F.col("table_name")).contains(q)
                           | F.lower(F.col("table_name_kr")).contains(q))
    w = Window.orderBy("ordinal")
    all_rows = Window.partitionBy()
    numbered = hits.select("*", F.row_number().over(w).alias("pos"),
                           F.count(F.lit(1)).over(all_rows).alias("n"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(page_size))).cast("int")
    cur = F.least(F.greatest(F.lit(int(page)), F.lit(1)), pages)
    return (numbered.select("*", pages.alias("total_pages"), cur.alias("page"))
            .where((F.col("pos") > (F.col("page") - 1) * page_size)
                   & (F.col("pos") <= F.col("page") * page_size))
            .drop("n"))


def table_columns(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Column catalog in ordinal order (schema-level, driver-side metadata)."""
    rows = [(name, i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    schema = T.StructType([
        T.StructField("table_name", T.StringType()), T.StructField("ordinal", T.IntegerType()),
        T.StructField("column_name", T.StringType()), T.StructField("data_type", T.StringType())])
    return spark.createDataFrame(rows, schema)


def table_recent_rows(df: DataFrame, key: str, n: int = 20, order_col: str = "created_date",
                      profile: str = "ops") -> DataFrame:
    """Newest ``n`` rows (unique tie-break on ``key``), masked, then every
    cell except the hash side-cars formatted for display.  The top-n runs as
    TakeOrderedAndProject: n rows per task, never a full sort."""
    top = df.orderBy(F.col(order_col).desc_nulls_last(), F.col(key).desc()).limit(n)
    return format_cells(sanitize(top, profile=profile))


def table_detail(tables: Mapping[str, tuple[DataFrame, object]], name: str, key: str,
                 captions: Mapping[str, str] | None = None, n: int = 20) -> dict[str, DataFrame]:
    """Table detail view: profile row, 14-day trend, column catalog and the
    newest ``n`` masked rows.  Only allow-listed (bound) names are accepted."""
    if name not in tables:
        raise ValueError(f"unknown table: {name}")
    df, as_of = tables[name]
    one = {name: (df, as_of)}
    return {
        "stats": table_stats(one, captions or {}, [name]),
        "trend": table_daily_trend(one),
        "columns": table_columns(df.sparkSession, name, df),
        "rows": table_recent_rows(df, key=key, n=n),
    }


# The wearable KPI strip — caption and source of each card,
# and the placeholder shown when a value is missing.
KPI_PLACEHOLDER = "—"
KPI_CARDS = (
    ("환자 마스터", "count", "Patient"),
    ("앱 프로필", "count", "user_app_profile"),
    ("생체 측정 행", "agg", "total_vitals"),
    ("금일 생체 측정", "agg", "today_vitals"),
    ("진료 이벤트", "count", "patient_clinical_event"),
    ("MySQL 미동기화(생체)", "agg", "pending_mysql_sync"),
    ("MySQL 미동기화(일별)", "agg", "pending_daily_mysql_sync"),
    ("24h 평균 심박", "agg", "avg_heart_rate_24h"),
)


def kpi_cards(counts: DataFrame, vitals_agg: DataFrame) -> DataFrame:
    """KPI strip: each card's value looked up by table key (first match) in
    the counts or taken from the vitals aggregate; missing → placeholder.
    Both inputs are one-row-per-table / one-row frames."""
    wanted = [src for _, kind, src in KPI_CARDS if kind == "count"]
    pivot = counts.agg(*[F.max(F.when(F.col("table_key") == k, F.col("total_count"))).alias(f"c_{k}")
                         for k in wanted]).withColumn("__k", F.lit(1))
    row = pivot.join(vitals_agg.withColumn("__k", F.lit(1)), "__k")
    cards = F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(label).alias("label"),
                 F.coalesce(F.col(f"c_{src}" if kind == "count" else src).cast("string"),
                            F.lit(KPI_PLACEHOLDER)).alias("value"))
        for i, (label, kind, src) in enumerate(KPI_CARDS)])
    return row.select(F.explode(cards).alias("c")).select("c.*")
