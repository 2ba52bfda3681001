"""Composite dashboard snapshots as one-row DataFrames (JSON at the sink).

Every block is already reduced to a handful of rows (months, types, top-n
departments, newest-n rows), so gathering a block into an array is bounded
by the block's own limit, never by the data size.  Blocks are combined with
one-row ⋈ one-row joins on a constant key.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StructType

from clinops.functions.common import as_date, as_datetime, bounded_broadcast, month_key, ts_lit
from clinops.functions.display import format_timestamp_ntz
from clinops.functions.labels import treatment_type_bucket
from clinops.operators import metrics, profile, vitals
from clinops.session import ensure_checkpoint_dir


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """Side-by-side join of one-row frames on a constant key (AQE turns
    each into a broadcast once the one-row stage has run)."""
    keyed = [f.withColumn("__k", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(b, "__k"), keyed).drop("__k")


def _ordered_array(df: DataFrame, order_col: str, fields: list[str], name: str, desc: bool = False) -> DataFrame:
    arr = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("__o"), *fields)), asc=not desc)
    return df.agg(F.transform(arr, lambda x: x.dropFields("__o")).alias(name))


def _listed(df: DataFrame, name: str) -> DataFrame:
    """A newest-n list as one array in its own order."""
    return _ordered_array(df, "ordinal", [c for c in df.columns if c != "ordinal"], name)


def treatment_summary(treatments: DataFrame, as_of, kpi_days: tuple[int, int] = (30, 60)) -> DataFrame:
    """ONE pass over the treatments fact: counts per (month, type bucket,
    department, KPI window).  Its size is months × types × departments × 3,
    independent of the number of treatments, and every dashboard block is
    derived from it — the fact table is scanned and shuffled once."""
    as_of = as_date(as_of)
    d = F.col("treatment_date")
    d30, d60 = (as_of - _dt.timedelta(days=kpi_days[0]), as_of - _dt.timedelta(days=kpi_days[1]))
    kpi = F.when(d >= ts_lit(d30), F.lit("r30")).when(d >= ts_lit(d60), F.lit("p30"))
    return treatments.groupBy(
        month_key(d).alias("month"),
        treatment_type_bucket(F.col("treatment_type")).alias("bucket"),
        "department_id", kpi.alias("kpi"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count("treatment_id").alias("n_ids"))


def operations_snapshot(department: DataFrame, treatments: DataFrame, schedule: DataFrame,
                        examination: DataFrame, as_of) -> DataFrame:
    """Gauge, 12-month timeline, type mix, top-5 league, top-3 production and
    KPI in one row, all derived from one treatments summary."""
    as_of = as_date(as_of)
    # Materialised once (reliable checkpoint, bounded size) so the blocks below
    # do not each push their filters into a fresh scan of the fact table.
    ensure_checkpoint_dir(treatments.sparkSession)
    summ = treatment_summary(treatments, as_of).checkpoint(eager=True)
    year_lo, year_hi = f"{as_of.year:04d}-01", f"{as_of.year:04d}-12"
    month = F.col("month")
    current = summ.where((month >= year_lo) & (month <= year_hi)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("current"))
    gauge = metrics.gauge_from(current).select(F.struct("current", "max_value", "title").alias("gauge"))
    start12 = metrics._month_start(as_of, 11).strftime("%Y-%m")
    tl = metrics.timeline_from(summ.where(month >= start12).groupBy("month").agg(F.sum("n").alias("c")), as_of, 12)
    timeline = tl.agg(F.sort_array(F.collect_list(F.struct("month_idx", "label", "value"))).alias("t")).select(
        F.struct(F.transform("t", lambda x: x["label"]).alias("labels"),
                 F.transform("t", lambda x: x["value"]).alias("values")).alias("timeline"))
    mix = metrics.mix_from(summ.groupBy("bucket").agg(F.sum("n").alias("c")))
    pie = _ordered_array(mix, "value", ["name", "value"], "pie_sales", desc=True)
    per_dept = (summ.where(F.col("department_id").isNotNull())
                .groupBy("department_id").agg(F.sum("n_ids").alias("c")))
    counts = metrics.department_counts_from(department, per_dept)
    top5 = metrics.top_departments(counts, 5)
    start6 = metrics._month_start(as_of, 5).strftime("%Y-%m")
    recent = (summ.where(month >= start6).join(bounded_broadcast(top5.select("department_id")),
                                               "department_id", "left_semi")
              .groupBy("department_id", "month").agg(F.sum("n").alias("mc")))
    lg = metrics.league_from(top5, recent, as_of, 6).withColumn("neg", -F.col("rank"))
    league = _ordered_array(lg, "neg", ["name", "actual", "target", "spark"], "league_table", desc=True)
    prod = metrics.production_top(department, None, 3, counts=counts)
    production = prod.agg(F.sort_array(F.collect_list(F.struct("rank", "category", "value"))).alias("p")).select(
        F.struct(F.transform("p", lambda x: x["category"]).alias("categories"),
                 F.transform("p", lambda x: x["value"]).alias("values")).alias("production"))
    rev = metrics.kpi_revenue(schedule, examination)
    growth = metrics.kpi_growth_from(summ.agg(
        F.coalesce(F.sum(F.when(F.col("kpi") == "r30", F.col("n"))), F.lit(0)).cast("bigint").alias("r30"),
        F.coalesce(F.sum(F.when(F.col("kpi") == "p30", F.col("n"))), F.lit(0)).cast("bigint").alias("p30")))
    kpi = _one_row([rev, growth]).select(F.struct("actual", "target", "growth_pct", "label").alias("kpi"))
    return _one_row([gauge, timeline, pie, league, production, kpi])


def wearable_snapshot(spark, loader, as_of_ts, table_counts: DataFrame | None = None) -> DataFrame:
    """Wearable-side snapshot: table counts, ETL cursor, category counts,
    vitals aggregate and the three newest-row lists.  ``table_counts`` may be
    given precomputed (e.g. one scan per base table)."""
    from clinops.sources.tables import PG_TABLES

    v = loader("user_vital_measurement")
    d = loader("user_daily_wellness")
    e = loader("patient_clinical_event")
    st = loader("etl_runtime_state")
    tc = table_counts if table_counts is not None else profile.table_counts(spark, list(PG_TABLES), loader)
    counts = _ordered_array(tc, "ordinal",
                            ["table_key", "label_kr", "sql_name", "total_count"], "table_counts")
    etl = (vitals.etl_state(st).where(F.col("job_code") == "wearable_round_robin")
           .select(F.struct(F.col("cursor_value").alias("wearable_round_robin_cursor"),
                            F.col("updated_at").alias("wearable_updated_at")).alias("s")))
    etl = etl.agg(F.first("s", ignorenulls=True).alias("etl"))
    cats = _ordered_array(vitals.clinical_by_category(e), "count", ["category", "label_kr", "count"],
                          "clinical_by_category", desc=True)
    agg = vitals.vitals_aggregate(v, d, as_of_ts)
    agg = agg.select(F.struct(*agg.columns).alias("vitals_aggregate"))
    rv = _listed(vitals.recent_vitals(v, 12, with_order=True), "recent_vitals")
    re_ = vitals.recent_events(e, 15, with_order=True).drop("include_mysql_treatment_id_column")
    # the flag is read off the listed rows (a masked id is NULL exactly when the raw one is)
    re_ = _listed(re_, "recent_clinical_events").select(
        "recent_clinical_events",
        F.exists("recent_clinical_events", lambda x: x["source_mysql_treatment_id"].isNotNull())
        .alias("include_mysql_treatment_id_column"))
    rw = _listed(vitals.recent_wellness(d, 10, with_order=True), "daily_wellness_sample_rows")
    gen = spark.range(1).select(F.lit(True).alias("connected"),
                                format_timestamp_ntz(ts_lit(as_datetime(as_of_ts))).alias("generated_at"))
    return _one_row([gen, counts, etl, cats, agg, rv, re_, rw])


def _cells(block: str, position, field: str, value, kind: DataType):
    """Cells of one field: one, or one per item of a list."""
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x, i: _cell(block, position, field, i, x, kind.elementType))
    return F.array(_cell(block, position, field, F.lit(0), value, kind))


def _cell(block: str, position, field: str, item, value, kind: DataType):
    number = isinstance(kind, NumericType)
    return F.struct(F.lit(block).alias("block"), position.cast("int").alias("position"), F.lit(field).alias("field"),
                    item.cast("int").alias("item"),
                    (F.lit(None) if number else value).cast("string").alias("text"),
                    (value if number else F.lit(None)).cast("double").alias("number"))


def _row_cells(block: str, rows, kind: StructType):
    """Cells of a list of rows."""
    return F.flatten(F.transform(rows, lambda x, i: F.concat(
        *(_cells(block, i, g.name, x[g.name], g.dataType) for g in kind.fields))))


def snapshot_cells(df: DataFrame) -> DataFrame:
    """A one-row snapshot as a table: block, position in a list block, field, item of a list field, text or number.

    The relational sink beside ``to_json_row``: snapshots of many days can be appended to one table and compared
    by value.  Missing values give a cell without text and number; an empty list gives no cells."""
    parts = []
    for f in df.schema.fields:
        col, kind = F.col(f.name), f.dataType
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            parts.append(_row_cells(f.name, col, kind.elementType))
        elif isinstance(kind, StructType):
            parts += [_cells(f.name, F.lit(0), g.name, col[g.name], g.dataType) for g in kind.fields]
        else:
            parts.append(_cells(f.name, F.lit(0), f.name, col, kind))
    cells = F.concat(*(F.coalesce(p, F.array()) for p in parts))
    return df.select(F.explode(cells).alias("c")).select("c.*")


def to_json_row(df: DataFrame, name: str = "snapshot") -> DataFrame:
    """The whole one-row snapshot as JSON text (the API sink); missing values
    are written as null, so every row of a list has the same keys."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))
