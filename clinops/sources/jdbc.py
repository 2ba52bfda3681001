"""Relational sources read in parallel over JDBC.

The operations and wearable databases are read with ``spark.read.jdbc``
split on a numeric key: ``num_partitions`` range predicates on
``partition_column`` between ``lower`` and ``upper`` (rows outside the range
still land in the first/last partition — Spark's bounds only decide the
stride).  Reading is lazy apart from the schema lookup, and Catalyst pushes
column pruning and simple filters into the generated SQL.

Credentials are passed in by the caller (from the platform's secret store);
nothing is read from the environment here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str, *, user: str | None = None, password: str | None = None,
                 partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                 num_partitions: int | None = None, fetch_size: int = 10_000,
                 driver: str | None = None) -> dict[str, str]:
    """Reader options for one table; partitioned when a column and bounds are given."""
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver:
        opts["driver"] = driver
    if partition_column:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("partitioned reads need lower, upper and num_partitions")
        if upper < lower:
            raise ValueError("upper bound below lower bound")
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower),
                     "upperBound": str(upper), "numPartitions": str(num_partitions)})
    return opts


def read_jdbc(spark: SparkSession, url: str, table: str, **kw) -> DataFrame:
    """``spark.read.format("jdbc")`` with :func:`jdbc_options`."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kw)).load()


def read_catalog(spark: SparkSession, name: str) -> DataFrame:
    """A table registered in the session catalog (e.g. a bucketed copy)."""
    return spark.table(name)
