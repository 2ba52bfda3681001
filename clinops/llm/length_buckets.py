"""Packing by optimal length buckets.

The global histogram of document lengths (one pre-aggregated count per distinct length) is the input of a
dynamic programme that chooses at most ``n_buckets`` upper bounds with the least total padding.  Documents
of a bucket are then dealt, in a shuffled order, into batches of as many rows as fit the token budget at the
bucket's length.  Lengths are ids of a tokenizer file, end id included, or words if no file is named.

The histogram is the only thing that reaches the driver.  Its size is the number of distinct lengths L, and
since these lengths add up to at least L**2 / 2 tokens, L is at most sqrt(2 * corpus tokens): 6 million for a
corpus of 2 * 10**13 tokens.  It comes as Arrow columns and the programme keeps flat arrays, about 4 * n_buckets + 80
bytes a length (under 1 GB there); it needs O(n_buckets * L) steps (convex hull trick).

Row numbers inside a bucket come from even bins of the shuffle key (about ``rows_per_bin`` rows each) and
the sums of the bins before, so a bucket with a third of all rows is spread over many tasks, and so are
rows with a null or one repeated id (``common.shuffled``).

Defined cases: a null or word-less text has no tokens, takes no room and belongs to no batch (bucket, batch
and slot are null); a document longer than the budget is a batch of its own, uncut; repeated rows are packed
as separate rows; ids may be null and of any type; an empty table gives an empty result; other columns, whatever
their names, are not read (but for ``__row``, a key of the caller's).
"""

from __future__ import annotations

from array import array
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clinops.llm import token_orc
from clinops.llm.common import even_bin, shuffled, word_count

SALT = "pack:"


def best_bounds(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper bounds (ascending, the last is the longest length) with the least total padding.

    ``lengths`` ascend.  cost(i, j) of putting lengths i..j-1 into one bucket is
    ``lengths[j-1] * rows - words``; the part that depends on both ends is ``-lengths[j-1] * rows_before[i]``,
    a line in the bucket length with ever smaller slopes, so the best start is read off a convex hull.
    """
    n = len(lengths)
    if not n:
        return []
    rows, words = array("q", [0]), array("q", [0])
    for length, count in zip(lengths, counts):
        rows.append(rows[-1] + count)
        words.append(words[-1] + length * count)
    best = array("q", [0] + [-1]) + array("q", [-1]) * (n - 1)  # padding of the first j lengths so far; -1: none yet
    starts: list[array] = []
    for _ in range(min(n_buckets, n)):
        hull: deque[tuple[int, int, int]] = deque()  # (slope, intercept, start)
        nxt = array("q", [-1]) * (n + 1)
        start = array("i", [0]) * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            if best[i] >= 0:
                m, c = -rows[i], best[i] + words[i]
                while len(hull) > 1:
                    (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                    if (c - c1) * (m1 - m2) <= (c2 - c1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append((m, c, i))
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            if hull:
                m, c, start[j] = hull[0]
                nxt[j] = m * x + c + x * rows[j] - words[j]
        starts.append(start)
        best = nxt
        if best[n] == 0:
            break
    bounds, j = [], n
    for start in reversed(starts):
        bounds.append(lengths[j - 1])
        j = start[j]
        if j == 0:
            break
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = 16,
         token_budget: int = 65536, rows_per_bin: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """Per row: __row, id, n_tokens, bucket, bucket_len, batch_id, slot, padding."""
    if tokenizer is None:
        rows = shuffled(docs, id_col, SALT, [text_col], [word_count(text_col).alias("n_tokens")])
    else:
        rows = shuffled(docs, id_col, SALT, [text_col], [F.col(text_col).alias("text")],
                        lambda rows: token_orc.counted(rows, tokenizer))
    hist = rows.where("n_tokens > 0").groupBy("n_tokens").count().toArrow()
    lengths, counts = (hist.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "count"))
    order = np.argsort(lengths)
    lengths, counts = array("q", lengths[order].tobytes()), array("q", counts[order].tobytes())
    bounds = best_bounds(lengths, counts, n_buckets)
    if not bounds:
        return rows.select("__row", "id", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("bucket", "int"), ("bucket_len", "long"), ("batch_id", "long"), ("slot", "long"), ("padding", "long"))])
    upto = np.concatenate(([0], np.cumsum(np.frombuffer(counts, np.int64))))
    cuts = np.searchsorted(np.frombuffer(lengths, np.int64), bounds, "right")
    sizes = np.diff(upto[cuts], prepend=0).tolist()
    per_batch = [max(1, token_budget // b) for b in bounds]
    first_batch = [0]
    for size, per in zip(sizes, per_batch):
        first_batch.append(first_batch[-1] + -(-size // per))
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    full = rows.where("n_tokens > 0").withColumn("bucket", bucket).withColumn(
        "bin", even_bin(F.col("h"), pick([-(-s // rows_per_bin) for s in sizes])))
    bins = full.groupBy("bucket", "bin").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("bucket").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select("bucket", "bin", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    place = F.row_number().over(W.partitionBy("bucket", "bin").orderBy("h", "id", "n_tokens", "__row")) - 1
    full = full.withColumn("inside", place).join(bins, ["bucket", "bin"])
    full = full.withColumn("at", F.col("ahead") + F.col("inside")).withColumn("per", pick(per_batch))
    full = full.select(
        "__row", "id", "n_tokens", "bucket", pick(bounds).alias("bucket_len"),
        (pick(first_batch[:-1]) + F.floor(F.col("at") / F.col("per"))).alias("batch_id"),
        (F.col("at") % F.col("per")).alias("slot"), (pick(bounds) - F.col("n_tokens")).alias("padding"))
    empty = rows.where("n_tokens = 0").select("__row", "id", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("bucket", "int"), ("bucket_len", "long"), ("batch_id", "long"), ("slot", "long"), ("padding", "long"))])
    return full.unionByName(empty)
