"""Audit of how filters interact: relations of failing ids, joined once for all prefixes of all filter orders.

1. One scan of the texts gives the facts of every row; one id table per filter is stored: the rows that fail it.
2. What a step of an order does depends only on the *set* of filters before it.  The sets are a key column
   (``gone``, a bit mask), so every prefix of every order is served by three joins on (row, gone):
   - survivors: the rows of every set, left anti joined with the ids that fail a filter of the set,
   - removed:   the ids failing a filter outside the set, left semi joined with the set's survivors,
   - redundant: the same ids, left anti joined with them.
   Rows that fail nothing survive every set and stay out of the joins; they are counted once per part.
3. Counts per (part, set, filter) are a small table, spread to all orders and steps.

The join key is (row, set), unique on the survivors' side: no part, however large, is a join key.  Equal texts
meet by SHA-256 of the whole text, reduced per (digest, salt) first, so a text that a third of all rows share is
spread over ``SALTS`` keys.  The shuffled rows are ids, not texts: 32 short rows per document that fails something.

Defined cases: a null text is empty; a null part is the empty string; null ids come after all others, and rows with
equal ids are not smaller than each other; a document without a label counts as unlabelled, several labels of one
id as their maximum; repeated rows are rows of their own; an empty table gives no rows; further columns of the
documents are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinops.llm.common import WORDS, checkpoint, keyed, prepare, shared_folder, written

FILTERS = "ABCDE"
SALTS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions that need one text only."""
    words = F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": n < 200, "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
            "C": 100 * upper.cast("long") > 2 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def later_copies(rows: DataFrame) -> DataFrame:
    """(__row) of every row whose text a row with a smaller id also has.  ``rows``: __row, id, sha."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)))
    part = checkpoint(rows.groupBy("sha", "salt").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    whole = part.groupBy("sha").agg(F.min("least").alias("least"), F.sum("n").alias("n")).where("n > 1").drop("n")
    lead = part.select("sha", "salt").join(whole, "sha")
    later = F.coalesce(F.col("id") > F.col("least"), F.col("id").isNull() & F.col("least").isNotNull())
    return rows.join(lead, ["sha", "salt"]).where(later).select("__row")


def id_tables(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              part_col: str = "source", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, fails): all rows (__row, part, good, toxic), and those rows once per filter they fail, stored as
    one table (folder) per filter."""
    spark = docs.sparkSession
    prepare(spark)
    base = keyed(docs.select(*(["__row"] if "__row" in docs.columns else []), F.col(id_col).alias("id"),
                             F.col(text_col).alias("text"), F.col(part_col).alias("part")), "id")
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = base.select("__row", "id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
                        F.sha2(text.cast("binary"), 256).alias("sha"),
                        *[rule.alias(name) for name, rule in text_rules(text).items()])
    facts = written(facts, "audit-facts")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = written(facts.drop("sha").join(marks, "id", "left").select(
        "__row", "part", no("good"), no("toxic"), *"ABCD"), "audit-rows")
    path = path or shared_folder(spark, "audit-fails")
    cols = ["__row", "part", "good", "toxic"]
    for name in "ABCD":
        rows.where(name).select(*cols).write.parquet(f"{path}/filter={name}")
    copies = later_copies(facts.select("__row", "id", "sha"))
    rows.join(copies, "__row", "left_semi").select(*cols).write.parquet(f"{path}/filter=E")
    kind = "__row long, part string, good boolean, toxic boolean, filter string"
    return rows.select(*cols), spark.read.schema(kind).parquet(path)


def bit() -> Column:
    """The bit of column ``filter`` in a set."""
    return F.expr(f"shiftleft(1, instr('{FILTERS}', filter) - 1)")


def prefixes(rows: DataFrame, fails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, steps): survivors per (part, gone), and per (part, gone, filter) the counts removed, good_lost,
    toxic_lost and redundant of the filter coming after the set ``gone``."""
    sets = range(1 << len(FILTERS))
    some = fails.select("__row").hint("merge")
    clean = rows.join(some, "__row", "left_anti").groupBy("part").agg(F.count("*").alias("clean"))
    marked = rows.join(some, "__row", "left_semi").select(
        "__row", "part", F.explode(F.array(*[F.lit(s) for s in sets])).alias("gone"))
    own = F.col("gone").bitwiseAND(bit()) != 0
    each = fails.withColumn("gone", F.explode(F.array(*[F.lit(s) for s in sets])))
    # both sides of these joins grow with the documents: always dealt out by key, never broadcast
    survivors = marked.join(each.where(own).select("__row", "gone").hint("merge"), ["__row", "gone"], "left_anti")
    after = each.where(~own)
    alive = survivors.select("__row", "gone").hint("merge")
    removed = after.join(alive, ["__row", "gone"], "left_semi").groupBy("part", "gone", "filter").agg(
        F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
    redundant = after.join(alive, ["__row", "gone"], "left_anti").groupBy("part", "gone", "filter").agg(
        F.count("*").alias("redundant"))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    kept = survivors.groupBy("part", "gone").agg(F.count("*").alias("alive"))
    every = parts.withColumn("gone", F.explode(F.array(*[F.lit(s) for s in sets])))
    kept = every.join(kept, ["part", "gone"], "left").join(clean, "part", "left").select(
        "part", "gone", (F.coalesce("alive", F.lit(0)) + F.coalesce("clean", F.lit(0))).alias("kept"))
    names = F.explode(F.array(*[F.lit(f) for f in FILTERS])).alias("filter")
    steps = every.select("part", "gone", names).where(~own)
    for found in (removed, redundant):
        steps = steps.join(found, ["part", "gone", "filter"], "left")
    return kept, steps.na.fill(0)


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Per part, filter order and step: filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley."""
    rows, fails = id_tables(docs, labels, **columns)
    kept, steps = prefixes(rows, fails)
    kept, steps = checkpoint(kept), checkpoint(steps)  # at most 32 and 80 rows a part
    everything = F.lit((1 << len(FILTERS)) - 1)
    size = F.bit_count("gone").cast("int")
    turns = F.factorial(size) * F.factorial(F.lit(len(FILTERS) - 1) - size)  # orders that begin with the set, then the filter
    shares = steps.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * turns).alias("shapley"),
        F.sum(F.when(F.col("gone").bitwiseXOR(bit()) == everything, F.col("removed"))).alias("unique_fails"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    plan = rows.select("part").distinct().withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    plan = plan.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    before = sum((F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)),
                 F.lit(0))
    plan = plan.withColumn("gone", before).withColumn("after", F.col("gone").bitwiseOR(bit()))
    out = plan.join(steps, ["part", "gone", "filter"]).join(shares, ["part", "filter"])
    out = out.join(kept.withColumnRenamed("gone", "after"), ["part", "after"])
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), "filter", "kept", "removed",
                      "redundant", "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley"))
