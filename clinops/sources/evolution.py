"""Stored tables whose columns are added or widened without rewriting a file.

The table's declared schema is kept in its ``_schema`` folder (readers skip names that begin with an underscore), one
version per change, the pointer written last.  Every file keeps the schema it was written with; reading states the
declared one, so Parquet gives NULL for columns a file lacks and promotes narrower numbers as it decodes them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinops.operators.upsert import latest_version, read_snapshot, write_snapshot

#: Type changes that the Parquet reader makes while it decodes (decimals apart).
WIDER = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType, T.DoubleType),
    T.ShortType: (T.IntegerType, T.LongType, T.DoubleType),
    T.IntegerType: (T.LongType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
    T.DateType: (T.TimestampNTZType,),
}


def can_widen(old: T.DataType, new: T.DataType) -> bool:
    """Can every value of ``old`` be read as ``new`` without loss?"""
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return old == new or isinstance(new, WIDER.get(type(old), ()))


def declared_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The table's declared schema (None: nothing was declared)."""
    kept = read_snapshot(spark, f"{path.rstrip('/')}/_schema")
    return None if kept is None else T.StructType.fromJson(json.loads(kept.first()["schema"]))


def declare_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Commit ``schema`` as the table's next version.  All columns are nullable: a file may lack them."""
    open_ = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    base = f"{path.rstrip('/')}/_schema"
    version = latest_version(spark, base)
    row = spark.createDataFrame([(open_.json(),)], "schema string").coalesce(1)
    write_snapshot(row, base, 0 if version is None else int(version) + 1)


def evolve_table(spark: SparkSession, path: str, add: dict[str, str] | None = None,
                 widen: dict[str, str] | None = None) -> T.StructType:
    """``ADD COLUMN IF NOT EXISTS`` and widening type changes; only the declared schema is written.

    Adding a column that is there with the same type does nothing; with another type, narrowing a column or
    naming one that is not there is an error, and the table stays as it is."""
    schema = declared_schema(spark, path) or spark.read.parquet(path).schema
    fields = {f.name: f.dataType for f in schema.fields}
    parse = lambda t: spark.range(0).select(F.lit(None).cast(t).alias("c")).schema["c"].dataType
    for name, text in (widen or {}).items():
        new = parse(text)
        if name not in fields:
            raise ValueError(f"no column {name}")
        if not can_widen(fields[name], new):
            raise ValueError(f"{name}: {fields[name].simpleString()} cannot become {new.simpleString()} without rewriting files")
        fields[name] = new
    for name, text in (add or {}).items():
        if fields.setdefault(name, parse(text)) != parse(text):
            raise ValueError(f"{name} is there as {fields[name].simpleString()}")
    new = T.StructType([T.StructField(n, t, True) for n, t in fields.items()])
    declare_schema(spark, path, new)
    return new


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All files of the table as the declared schema has them."""
    schema = declared_schema(spark, path)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def append_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows as the declared schema has them: missing columns are NULL, narrower ones are cast up, an unknown
    column or a type that does not fit is an error."""
    schema = declared_schema(rows.sparkSession, path) or rows.schema
    extra = [c for c in rows.columns if c not in schema.names]
    if extra:
        raise ValueError(f"the table at {path} has no columns {extra}")
    bad = [f.name for f in schema.fields if f.name in rows.columns and not can_widen(rows.schema[f.name].dataType, f.dataType)]
    if bad:
        raise ValueError(f"columns {bad} do not fit the table at {path}")
    out = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in schema.fields])
    w = out.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
