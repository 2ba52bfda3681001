"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in a fixed shuffled order, served up to ``epochs`` times over.
A document's virtual finish time is the running token count of its queue divided by the queue's target,
so all queues reach time 1 together when each has delivered its target.  Documents of all queues are then
put in one global order by finish time and the order is cut at the total budget.

Nothing is ordered inside one task by source or globally: running counts are taken inside even bins of the
shuffle key (about ``rows_per_bin`` rows) plus the sums of the bins before, and the global order is cut the
same way, by bins of the finish time and one exact pass over the bin that the budget falls into.  A source
that holds a third of all rows is thus spread over many bins.

Defined cases: a null or word-less text has size 0 and is never taken; a null source is one source, last
in order; rows whose id is null or repeated are queued by id, source and text, equal rows as separate rows, none
beside the other; ids of any type will do; an empty table gives an empty result; other columns are not read by
``fair_mix`` and pass through ``mixed_rows`` (names that begin with two underscores are ours).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clinops.llm.common import checkpoint, even_bin, keyed, shuffled, word_count

WEIGHTS = (5, 2, 1)
SALT = "mix:"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Per source: rank, rows, source_size, target.

    Targets share ``share`` of all sizes by weight; a target stops at ``epochs`` times its source's size
    and the excess is shared again by weight.  The fixed point of that is a common level: with sources in
    order of cap per weight, a source is capped as long as its cap is below what the level gives it.
    One row per source, so its windows are small whatever the corpus.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rank", rank - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    everything = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = everything.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    per = per.withColumn("open_level", F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level")))
    level = F.first("open_level", ignorenulls=True).over(
        everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return per.withColumn("target", target).select("source", "rank", "n_rows", "source_size", "target")


def fair_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, share: float = 1.5, epochs: int = 2, rows_per_bin: int = 4096) -> DataFrame:
    """Per row of ``docs``: __row, id, source, size, source_size, target, copies (0..epochs) and taken."""
    rows = shuffled(docs, id_col, SALT, [source_col, text_col],
                    [F.col(source_col).alias("source"), word_count(text_col).alias("size")])
    per = checkpoint(targets(rows, weights, share, epochs))
    rows = rows.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    per = per.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    rows = rows.join(per, ["source", "no_source"])
    rows = rows.withColumn("bin", even_bin(F.col("h"), F.ceil(F.col("n_rows") / rows_per_bin)))

    bins = rows.groupBy("rank", "bin").agg(F.sum("size").alias("bin_size"))
    ahead = W.partitionBy("rank").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select("rank", "bin", F.coalesce(F.sum("bin_size").over(ahead), F.lit(0)).alias("ahead"))
    queue = W.partitionBy("rank", "bin").orderBy("h", "id", "size", "__row").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(queue)).join(bins, ["rank", "bin"])
    rows = checkpoint(rows.withColumn("run", F.col("ahead") + F.col("inside")))

    total = per.agg(F.sum("source_size"), F.sum("target"), F.sum("n_rows")).first()
    budget, n_bins = round(float(total[1] or 0), 6), max(1, int((total[2] or 0) // rows_per_bin))
    order = ["finish", "rank", "epoch", "h", "id", "size", "__row"]
    goal = F.nullif(F.col("target"), F.lit(0.0))  # a source without words has target 0; no guard keeps a quotient from being hoisted
    turns = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    served = rows.where("size > 0").withColumn("epoch", turns).withColumn(
        "finish", (F.col("source_size") * F.col("epoch") + F.col("run")) / goal)
    served = served.withColumn("slot", F.floor(F.col("finish") / (F.col("finish") + 1) * n_bins))
    slots = served.groupBy("slot").agg(F.sum("size").alias("s"))
    upto = W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    cut = slots.withColumn("upto", F.sum("s").over(upto)).where(F.col("upto") > budget).orderBy("slot").first()
    if cut is None:  # the budget holds everything
        copies = F.when(F.col("size") > 0, F.lit(epochs)).otherwise(0)
    else:
        inside = W.partitionBy("slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        last = (served.where(F.col("slot") == cut["slot"])
                .withColumn("upto", F.sum("size").over(inside) + (cut["upto"] - cut["s"]))
                .where(F.col("upto") <= budget).agg(F.max(F.struct(*order)).alias("last")).first()["last"])
        finish = lambda e: (F.col("source_size") * e + F.col("run")) / goal
        slot = lambda e: F.floor(finish(e) / (finish(e) + 1) * n_bins)
        copies = F.lit(0)
        for e in range(epochs):
            taken = slot(e) < cut["slot"]
            if last is not None:
                mine = F.struct(finish(e).alias("finish"), F.col("rank"), F.lit(e).alias("epoch"), "h", "id", "size",
                                "__row")
                limit = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in zip(
                    order, ("double", "int", "int", "long", dict(rows.dtypes)["id"], "long", "long"))])
                taken = taken | ((slot(e) == cut["slot"]) & (mine <= limit))
            copies = copies + F.when((F.col("size") > 0) & taken, 1).otherwise(0)
    rows = rows.withColumn("copies", copies)
    return rows.select("__row", "id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size",
                       "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, with its own columns only."""
    rows = keyed(docs, id_col)
    won = fair_mix(rows, id_col, **kw).where("copies > 0").select("__row", F.col("copies").alias("__copies"))
    out = rows.join(won, "__row").withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.drop("__row", "__copies", "__turn")
