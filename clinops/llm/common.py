"""Shared plumbing of the corpus operators: reading, row keys, reliable checkpoints, components."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORDS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make checkpoints possible and let Python tasks import this package.

    The checkpoint folder is the session's ``spark.checkpoint.dir``; one is chosen here only when the
    session names none and runs in local mode (tests).  A cluster without it is refused.
    """
    sc = spark.sparkContext
    path = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in path and os.path.isdir(ROOT):
        sc.environment["PYTHONPATH"] = os.pathsep.join([*path, ROOT])
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="clinops-ckpt-")
        sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for tables a job writes and reads back."""
    import uuid

    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one); its files go when the result is no longer used."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a new folder of the shared checkpoint folder, read back.

    For large intermediate results: smaller than a checkpoint and just as safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def packed(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """``keep`` and the text as a compressed binary ``z``, for joins that must move whole texts."""
    from clinops.llm import textops as T

    rows = docs.select(*keep, F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), T.pack_texts(batch.column("text"))],
                                             [*keep, "z"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", z binary")


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether the id is an integer, unique and never null (one job over the id column)."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        return False
    n, ids, distinct = df.agg(F.count("*"), F.count(id_col), F.count_distinct(id_col)).first()
    return n == ids == distinct


def keyed(df: DataFrame, id_col: str, key: str = "__row") -> DataFrame:
    """``df`` with a unique, non-null long ``key`` per row (names that begin with two underscores are ours).

    The id itself serves when it is an integer, unique and never null (one job over the id column).  Otherwise
    rows are numbered once and the numbered table is checkpointed, so that retried tasks see the same numbers.
    """
    if key in df.columns:
        return df
    if unique_ids(df, id_col):
        return df.withColumn(key, F.col(id_col).cast("long"))
    return checkpoint(df.withColumn(key, F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable from each node of the undirected ``edges`` (a, b).

    Alternating large-star and small-star rounds; every round is two keyed joins on pre-aggregated
    minima and is checkpointed reliably; they end when a round changes nothing.  Nothing is collected but
    two numbers a round.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = checkpoint(pairs)
    size = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = size(pairs)
    while was[0]:
        # large star: each edge's upper end moves to the smallest neighbour of its lower end.  The minima are
        # a table of their own, so that a hub's edges meet them in a plain join, which can be split
        low = checkpoint(pairs.groupBy("u").agg(F.min("v").alias("m")))
        large = pairs.join(low.select(F.col("u").alias("v"), "m"), "v", "left")
        large = checkpoint(large.select("u", F.coalesce("m", "v").alias("v")))
        # small star: all lower neighbours of a node, and itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        pairs = checkpoint(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
        now = size(pairs)
        if now == was:
            break
        was = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))



def word_count(text: str = "text"):
    """Words of a text column (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def shuffle_key(id_col: str, salt: str, *more: str):
    """Uniform 60-bit number from an id, and from more columns if the id does not tell rows apart: the same order in
    every run and in any SQL engine with md5."""
    name = [F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))]
    for c in more:
        name += [F.lit(":"), F.coalesce(F.md5(F.col(c)), F.lit("-"))]
    return sixty_bits(F.concat(*name))


def sixty_bits(name):
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def shuffled(docs: DataFrame, id_col: str, salt: str, telling: list[str], columns: list, measure=lambda rows: rows):
    """Checkpointed rows (__row, id, columns, h): ``h`` puts them in a fixed shuffled order in even bins.

    Where the ids are integers, unique and never null, ``h`` is the shuffle key of the id.  Otherwise it is that of the id
    with the ``telling`` columns, and rows equal in all of them are numbered 0, 1, ... by partition, so that neither
    null ids nor one repeated row holding a third of the table fill a bin.  ``measure`` may replace columns before the
    rows are stored.  A ``__row`` of ``docs`` is kept."""
    single = unique_ids(docs, id_col)
    row = (F.col("__row") if "__row" in docs.columns
           else F.col(id_col).cast("long") if single else F.monotonically_increasing_id())
    h = shuffle_key(id_col, salt) if single else shuffle_key(id_col, salt, *telling)
    rows = checkpoint(measure(docs.select(row.alias("__row"), F.col(id_col).alias("id"), *columns, h.alias("h"))))
    if single:
        return rows
    parts = rows.withColumn("part", F.spark_partition_id())
    ahead = W.partitionBy("h").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    before = parts.groupBy("h", "part").count().select("h", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("n"))
    place = F.row_number().over(W.partitionBy("h", "part").orderBy("__row")) - 1
    parts = parts.withColumn("copy", place).join(before, ["h", "part"]).withColumn("copy", F.col("copy") + F.col("n"))
    h = sixty_bits(F.concat(F.lit(salt), F.col("h").cast("string"), F.lit(":"), F.col("copy").cast("string")))
    return checkpoint(parts.withColumn("h", F.when(F.col("copy") > 0, h).otherwise(F.col("h"))).select(*rows.columns))


def even_bin(h, bins):
    """Bin 0..bins-1 of a 60-bit shuffle key, ascending with the key."""
    return F.floor(h.cast("double") / F.lit(float(1 << 60)) * bins).cast("long")
