"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of ``n``-word shingles; two documents are linked when their Jaccard similarity is at
least ``threshold``.  Exact copies are one node with a weight, so they never meet each other.

1. Signature: ``BANDS * ROWS`` MinHash values per document.  A band is ``ROWS`` of them; documents that share
   a band are candidates.  A pair at 0.8 shares no band with probability (1 - 0.8**5)**30 = 7e-6.  Lower
   thresholds cut the same values into shorter bands, so that a pair at the threshold is missed with probability
   ``MOST_MISSED`` at most; a threshold too low for that with bands of one value is refused.
2. Pruning inside band buckets: MinHash values are compared ``STEP`` at a time, and a pair is dropped as soon
   as the posterior probability of reaching the threshold (uniform prior, binomial matches) is below
   ``tolerance``.  Buckets are cut into blocks of ``BLOCK`` members and block pairs are spread over tasks;
   only links of a spanning forest leave a task, so rows stay linear in the members.
3. Surviving links are closed to candidate groups; inside a group all pairs of blocks are verified exactly
   (shingle sets, integer arithmetic).  A task gives per member the number of links and, again, a spanning
   forest only.  A chain of surviving candidates can join several classes in one group, so verification
   tests more pairs than survived, never fewer.
4. The verified links are closed to classes.

Defined cases: null or word-less texts link with nothing; a text shorter than ``n`` words is one shingle of
all its words; repeated rows are copies; rows with a null id are grouped like others, but the class id is the
smallest non-null id where there is one.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinops.llm import textops as T
from clinops.llm.common import checkpoint, components, keyed, prepare

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
MOST_MISSED = 1e-5
STEP = 30
TOLERANCE = 1e-6
BLOCK = 512
VERIFY_BLOCK = 256
SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of every shingle; a shorter text is one shingle of all its words."""
    starts, ends, first = T.word_bounds(buf, offs)
    prefix = T.prefix_hash(T.word_hashes(buf, starts, ends))
    at, row = T.window_rows(first, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    h = np.concatenate((T.span_hash(prefix, at, at + n), T.span_hash(prefix, first[short], first[short + 1])))
    row = np.concatenate((row, short))
    if len(short):
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def minhash(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their signatures).  Multiply-add on 64 bits, upper 32 bits compared."""
    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, dtype=np.int64)
    have = row[begin] if len(row) else np.zeros(0, dtype=np.int64)
    out = np.empty((len(begin), SEEDS.shape[1]), dtype=np.uint32)
    if len(begin):
        work = np.empty(len(h), dtype=np.uint64)
        for k in range(SEEDS.shape[1]):
            np.multiply(h, SEEDS[0, k], out=work)
            work += SEEDS[1, k]
            out[:, k] = np.minimum.reduceat(work, begin) >> np.uint64(32)
    return have, out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values: the fewest matches whose posterior still reaches ``tolerance``.

    With a uniform prior the posterior of the similarity after m matches in n is Beta(m + 1, n - m + 1), whose
    upper tail at t is the probability of at most m successes in n + 1 trials of probability t."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def rows_per_band(threshold: float) -> int:
    """Values of a band (ROWS at most) that keep the chance of missing a pair at ``threshold`` within MOST_MISSED."""
    for rows in range(ROWS, 0, -1):
        if (1 - threshold**rows) ** (BANDS * ROWS // rows) <= MOST_MISSED:
            return rows
    raise ValueError(f"threshold {threshold} is too low for {BANDS * ROWS} values")


def signatures(docs: DataFrame, n: int, per_band: int = ROWS) -> DataFrame:
    """(__row, copy, sig, bands) of every text with a word; ``copy`` tells texts apart."""
    n_bands = BANDS * ROWS // per_band

    def run(batches):
        for batch in batches:
            held = [batch.column(c) for c in ("__row", "id", "copy")]
            for a, b, buf, offs in T.text_chunks(batch.column("text")):
                have, sig = minhash(*shingles(buf, offs, n), b - a)
                bands = np.zeros((len(have), n_bands), dtype=np.uint64)
                for r in range(per_band):
                    part = sig[:, r : n_bands * per_band : per_band].astype(np.uint64)
                    bands = T.mix(bands * np.uint64(31) + part + np.uint64(1))
                bands = T.mix(bands + np.arange(n_bands, dtype=np.uint64))
                at = pa.array(a + have)
                lists = pa.ListArray.from_arrays(np.arange(len(have) + 1, dtype=np.int32) * n_bands,
                                                 pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in held), T.binary_column(sig.astype(np.uint16)), lists],
                    ["__row", "id", "copy", "sig", "bands"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"__row long, id {kind}, copy string, sig binary, bands array<long>")


def in_blocks(members: DataFrame, group: list[str], size: str, block: int) -> DataFrame:
    """Members of a group in pairs of blocks (lo, hi): each row goes to every block pair its block is part of."""
    n = F.ceil(F.col(size) / block).cast("int")
    mine = members.withColumn("own", F.pmod(F.xxhash64("node"), n).cast("int"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return mine.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).drop("other", size)


def surviving_links(members: DataFrame, tolerance: float, threshold: float) -> DataFrame:
    """Spanning forest (a, b) of the pairs that survive pruning, from (bucket, lo, hi, node, sig) rows."""
    need = least_matches(threshold, tolerance)

    def run(batches):
        for table, cuts in T.whole_groups(batches, ["bucket", "lo", "hi"]):
            names, node = np.unique(table.column("node").to_numpy(), return_inverse=True)
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(len(node), -1)
            own = table.column("own").to_numpy()
            apart = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            end = np.repeat(cuts[1:], np.diff(cuts))
            label = np.arange(len(names))
            from_, to = [], []
            act, d = np.arange(len(node)), 0
            while True:
                d += 1
                act = act[act + d < end[act]]
                if not len(act):
                    break
                i, j = act, act + d
                ok = (label[node[i]] != label[node[j]]) & ~(apart[i] & (own[i] == own[j]))
                i, j = i[ok], j[ok]
                matches = np.zeros(len(i), dtype=np.int64)
                for n, least in need.items():
                    matches += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(axis=1)
                    ok = matches >= least
                    i, j, matches = i[ok], j[ok], matches[ok]
                if len(i):
                    from_.append(node[i])
                    to.append(node[j])
                    joined = T.local_components(len(names), label[node[i]], label[node[j]])
                    label = joined[label]
            if from_:
                root = T.local_components(len(names), np.concatenate(from_), np.concatenate(to))
                far = np.flatnonzero(root != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], ["a", "b"])

    members = members.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return members.select("bucket", "lo", "hi", "own", "node", "sig").mapInArrow(run, "a long, b long")


def shared_counts(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles per row, shingles in common per pair of rows) by products of 0/1 matrices, in slices."""
    order = np.lexsort((row, h))
    row, h = row[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[keep], h[keep]
    size = np.bincount(row, minlength=n_rows)
    column = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64)))) if len(h) else np.zeros(0, dtype=np.int64)
    both = np.zeros((n_rows, n_rows), dtype=np.float64)
    held = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, dtype=bool)  # alone: in common with none
    row, column = row[held], column[held]
    width = max(256, (1 << 22) // max(1, n_rows))
    a = 0
    while a < len(row):
        b = int(np.searchsorted(column, column[a] + width))
        m = np.zeros((n_rows, column[b - 1] - column[a] + 1), dtype=np.float32)
        m[row[a:b], column[a:b] - column[a]] = 1
        both += m @ m.T
        a = b
    return size, np.rint(both).astype(np.int64)


def verified_links(members: DataFrame, threshold: float, n: int) -> DataFrame:
    """(node, links, root) per member and block pair: exact number of linked documents in the other block
    (copies counted) and its tree of the spanning forest, from (group, lo, hi, own, node, copies, text)."""
    per_mille = round(threshold * 1000)

    def run(batches):
        for table, cuts in T.whole_groups(batches, ["group", "lo", "hi"]):
            own_all, node_all = table.column("own").to_numpy(), table.column("node").to_numpy()
            copies_all = table.column("copies").to_numpy()
            apart = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows, hashes = [], []
                for x, _, buf, offs in T.text_chunks(table.column("text").slice(a, b - a)):
                    row, h = shingles(buf, offs, n)
                    rows.append(row + x)
                    hashes.append(h)
                size, both = shared_counts(np.concatenate(rows), np.concatenate(hashes), b - a)
                link = 1000 * both >= per_mille * (size[:, None] + size[None, :] - both)
                link &= (size[:, None] > 0) & (size[None, :] > 0)
                np.fill_diagonal(link, False)
                if apart[a]:  # two blocks: only pairs across
                    link &= own_all[a:b, None] != own_all[None, a:b]
                i, j = np.nonzero(link)
                root = T.local_components(b - a, i, j)
                out.append((node_all[a:b], link @ copies_all[a:b], node_all[a:b][root]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(3)],
                                             ["node", "links", "root"])

    members = members.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")
    return members.select("group", "lo", "hi", "own", "node", "copies", "text").mapInArrow(
        run, "node long, links long, root long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = N,
         tolerance: float = TOLERANCE) -> DataFrame:
    """Per row: __row, id, n_links (other rows linked directly, copies included), class_id (smallest id of the
    class), is_first (one row per class; always for rows that link with nothing)."""
    prepare(docs.sparkSession)
    base = docs.select(*(["__row"] if "__row" in docs.columns else []), id_col, text_col)
    base = keyed(base, id_col).select("__row", F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                      F.md5(F.col(text_col)).alias("copy"))
    sigs = signatures(base, n, rows_per_band(threshold))
    nodes = checkpoint(sigs.groupBy("copy").agg(
        F.min("__row").alias("node"), F.count("*").alias("copies"), F.min("id").alias("least_id"),
        F.min_by(F.struct("sig", "bands"), "__row").alias("s")).select("node", "copy", "copies", "least_id", "s.*"))

    bands = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = bands.join(shared, "bucket").join(nodes.select("node", "sig"), "node")
    links = checkpoint(surviving_links(in_blocks(members, ["bucket"], "m", BLOCK), tolerance, threshold).distinct())

    groups = components(links)  # node -> root for all but the roots
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = groups.groupBy("root").agg(F.count("*").alias("m"))
    members = checkpoint(in_blocks(groups.join(sizes, "root").withColumnRenamed("root", "group"), ["group"], "m",
                                   VERIFY_BLOCK).join(nodes.select("node", "copies"), "node"))
    members = members.join(base.select(F.col("__row").alias("node"), "text"), "node")
    checked = checkpoint(verified_links(members, threshold, n))
    classes = components(checked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))

    found = (nodes.select("node", "copy", "copies", "least_id").join(links, "node", "left").join(classes, "node", "left")
             .select("copy", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("root", "node").alias("class")))
    named = found.groupBy("class").agg(F.min("least_id").alias("class_id"))
    found = found.join(named, "class").drop("least_id")
    rows = base.select("__row", "id", "copy").join(found, "copy", "left")
    return rows.select("__row", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                       F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                       (F.coalesce("class", "__row") == F.col("__row")).alias("is_first"))
