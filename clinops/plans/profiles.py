"""Table profiles over the bound views, one scan per base table.

Several logical tables are projections of the same parquet table (nine of
the operations tables come from orders).  Profiling each view separately
would read the base table once per view; here every view of a base table is
profiled in a single pass:

* stats — one aggregate with per-view conditional counts and maxima, then
  exploded into one row per view (the aggregate runs once);
* daily trend — each row is expanded into (view, created day) pairs for the
  views it belongs to, partially aggregated, and shuffled once.

Results equal ``operators.profile.table_stats`` / ``table_daily_trend`` on
the individual views.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinops.functions.common import as_date, day_key, union_all
from clinops.functions.display import format_timestamp_ntz
from clinops.sources.tables import VIEWS, _pick, raw, view_as_of


def _by_base(names: list[str]) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = defaultdict(list)
    for n in names:
        groups[VIEWS[n].base].append(n)
    return groups


def _created(name: str) -> F.Column:
    expr = dict(VIEWS[name].columns)["created_date"]
    return F.expr(_pick(expr, "spark"))


def _created_since(name: str, day: _dt.date) -> F.Column:
    """created_date on or after ``day``, stated on the base column where the
    binding only shifts one, so that the filter reaches the scan."""
    low = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    moved = re.fullmatch(r"(\w+) ([-+]) (INTERVAL \d+ \w+)", _pick(dict(VIEWS[name].columns)["created_date"], "spark"))
    if not moved:
        return _created(name) >= low
    column, sign, step = moved.groups()
    return F.col(column) >= (low + F.expr(step) if sign == "-" else low - F.expr(step))


def _member(name: str) -> F.Column:
    w = VIEWS[name].where
    return F.coalesce(F.expr(w), F.lit(False)) if w else F.lit(True)


def bound_table_stats(spark: SparkSession, sf_dir: str, names: list[str],
                      captions: dict[str, str], order: list[str]) -> DataFrame:
    parts = []
    for base, views in _by_base(names).items():
        aggs, rows = [], []
        for i, n in enumerate(views):
            day = _dt.datetime.combine(as_date(view_as_of(n)), _dt.time())
            c, m = _created(n), _member(n)
            aggs += [F.count_if(m).alias(f"t{i}"),
                     F.count_if(m & (c >= F.lit(day.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")))
                     .alias(f"d{i}"),
                     F.max(F.when(m, c)).alias(f"m{i}")]
            rows.append(F.struct(F.lit(order.index(n) + 1).alias("ordinal"), F.lit(n).alias("table_name"),
                                 F.lit(captions.get(n, n)).alias("table_name_kr"),
                                 F.col(f"t{i}").alias("total_count"), F.col(f"d{i}").alias("today_count"),
                                 format_timestamp_ntz(F.col(f"m{i}")).alias("last_created_at")))
        one = raw(spark, sf_dir, base).agg(*aggs)          # one scan of the base table
        parts.append(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return union_all(parts)


def bound_daily_trend(spark: SparkSession, sf_dir: str, names: list[str], days: int = 14) -> DataFrame:
    parts = []
    for base, views in _by_base(names).items():
        pairs, recent = [], []
        for n in views:
            lo = as_date(view_as_of(n)) - _dt.timedelta(days=days - 1)
            c = _created(n)
            late = _created_since(n, lo)
            keep = _member(n) & late
            recent.append(late)
            pairs.append(F.when(keep, F.struct(F.lit(n).alias("table_name"), day_key(c).alias("day"))))
        exploded = (raw(spark, sf_dir, base).where(reduce(lambda a, b: a | b, recent))  # reaches the scan
                    .select(F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("p"))
                    .select("p.table_name", "p.day"))
        parts.append(exploded.groupBy("table_name", "day").agg(F.count(F.lit(1)).alias("count")))
    return union_all(parts)


def bound_table_counts(spark: SparkSession, sf_dir: str, tables: list[tuple[str, str]]) -> DataFrame:
    """Row counts for (name, caption) pairs: views of one base table are
    counted in one scan; the daily rollup is counted from its aggregate;
    unbound names report -1."""
    from clinops.sources.tables import load_view

    ordinal = {n: i + 1 for i, (n, _) in enumerate(tables)}
    caption = dict(tables)
    bound = [n for n, _ in tables if n in VIEWS]
    parts = []
    for base, views in _by_base(bound).items():
        one = raw(spark, sf_dir, base).agg(*[F.count_if(_member(n)).alias(f"c{i}") for i, n in enumerate(views)])
        parts.append(one.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("total_count")) for i, n in enumerate(views)
        ])).alias("r")).select("r.*"))
    for n, _ in tables:
        if n == "user_daily_wellness":
            parts.append(load_view(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("total_count"))
                         .select(F.lit(n).alias("name"), "total_count"))
        elif n not in VIEWS:
            parts.append(spark.range(1).select(F.lit(n).alias("name"),
                                               F.lit(-1).cast("bigint").alias("total_count")))
    allc = union_all(parts)
    cap = F.create_map(*[F.lit(x) for n in caption for x in (n, caption[n])])
    ordm = F.create_map(*[F.lit(x) for n in ordinal for x in (n, ordinal[n])])
    return allc.select(ordm[F.col("name")].alias("ordinal"), F.col("name").alias("table_key"),
                       cap[F.col("name")].alias("label_kr"), F.col("name").alias("sql_name"), "total_count",
                       F.greatest(F.lit(0).cast("bigint"), F.col("total_count")).alias("chart_count"))
