"""Suffix-array dedup: remove every byte covered by a ``width``-byte string that also starts elsewhere.

Sorting all suffixes of a corpus at once needs memory for all of them.  Here the suffixes are sorted one
bucket at a time, and only those that can have a partner:

1. Buckets.  All strings (``width``-byte windows) with the same smallest ``GRAM``-byte gram hash belong to one
   bucket; equal strings agree on it.  Consecutive strings of a text that share the place of that gram form
   one *run*, so a text becomes few rows: bucket, 64-bit hash of the run's bytes, text key, start, number of strings.
   A bucket with one run holds no repeat and is dropped (partial aggregates by bucket; a passage that a
   third of all texts hold is combined before the shuffle).
2. Runs whose bucket holds equal runs only are repeats as a whole and need no sorting.
3. In the other buckets the bytes of one run per distinct content are fetched, cut a second time by a longer
   gram, and the suffixes of these buckets are sorted blockwise with a difference cover (``sort_bucket``):
   each suffix is compared by its first ``PERIOD`` bytes, longer ties by the precomputed rank of the cover
   sample that lies at the same small distance from both suffixes, and the last ``PERIOD`` bytes directly.
   A comparison is O(1) however long the tie, and memory is that of one block: the block's bytes, its
   sample ranks and its sorted positions.  Buckets of one run, or of equal runs only, are told apart by counts
   and never sorted.  A bucket over ``BLOCK_BYTES`` (a passage that many texts hold between different
   neighbours) is not brought together: one run of each content is cut a third time by a gram of 192 bytes, and
   its smaller buckets are sorted in the same way.  What is still over ``BLOCK_BYTES`` has 192 bytes in common and
   runs of 9 strings at most; the bytes of these strings are grouped by Spark, spread over many tasks.
4. Equal neighbours in suffix order are repeats; their strings become byte spans of their texts.

Lossless: the buckets are a function of the string alone, so two equal strings always meet.  Bytes are
compared as bytes inside buckets, large ones included; whole runs (steps 2 and 3) by 62-bit hashes inside their
bucket.

Defined cases: null and short texts (under ``width`` bytes) lose nothing; repeated rows are repeats of each
other; a string that overlaps its own copy counts; one text must fit in a task's memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinops.llm import textops as T
from clinops.llm.common import keyed, packed, prepare, written

WIDTH = 200
GRAM = 32  # shorter grams give longer runs, so fewer rows
FINE_GRAMS = (160, 192)  # second cut: only strings with 160 bytes in common share a bucket; third cut of large buckets
PERIOD = 32
COVER = (0, 1, 2, 3, 4, 8, 12, 16, 20, 24, 28)  # all differences modulo 32: see cover_shift()
BLOCK_BYTES = 4 << 20  # bytes sorted at once


def cover_shift() -> np.ndarray:
    """shift[i, j]: the smallest d with both i + d and j + d in the cover (modulo PERIOD)."""
    inside = np.zeros(PERIOD, dtype=bool)
    inside[list(COVER)] = True
    shift = np.full((PERIOD, PERIOD), -1, dtype=np.int64)
    for d in range(PERIOD - 1, -1, -1):
        ok = inside[(np.arange(PERIOD) + d) % PERIOD]
        shift[np.ix_(ok, ok)] = d
    if (shift < 0).any():
        raise ValueError("not a difference cover")
    return shift


def runs(buf: np.ndarray, offs: np.ndarray, width: int, gram: int, salt: int = 0):
    """Runs of strings by smallest gram: (bucket, hash of the run's bytes, row, start in the row, strings)."""
    prefix = T.prefix_hash(buf)
    at, row = T.window_rows(offs, width)  # offsets of bytes play the part of first words
    if not len(at):
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), z, z, z
    grams = T.mix(T.rolling_hash(prefix, gram) ^ np.uint64(salt))
    low = T.sliding_min(grams, width - gram + 1)
    bucket = low[at]
    new = np.ones(len(at), dtype=bool)
    # a run ends where the smallest gram changes or its leftmost place drops out (periodic text)
    new[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1]) | (grams[at[:-1]] == bucket[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate((begin, [len(at)])))
    first = at[begin]
    return bucket[begin], T.span_hash(prefix, first, first + size + width - 1), row[begin], first - offs[row[begin]], size


def text_runs(texts: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys = batch.column("__row").to_numpy()
            for a, _, buf, offs in T.text_chunks(batch.column("text")):
                bucket, content, row, start, n = runs(buf, offs, width, min(GRAM, width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(content.view(np.int64)), pa.array(keys[a + row]),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["bucket", "content", "__row", "start", "n"])

    return texts.select("__row", "text").mapInArrow(run, "bucket long, content long, __row long, start int, n int")


# --- blockwise suffix sorting --------------------------------------------------------------------

def load64(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one big-endian number, so that numbers order as bytes."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | buf[at + k]
    return out


def dense_rank(*keys: np.ndarray) -> np.ndarray:
    """Rank of each row by its keys, first key most significant; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(buf: np.ndarray, width: int) -> np.ndarray:
    """For every cover sample (position in the cover modulo PERIOD): its rank by its first
    ``width - PERIOD`` bytes.  Ranks of PERIOD bytes are doubled until that length is reached; positions
    PERIOD apart are both samples, so only samples are ever ranked.  ``buf`` must be padded by 2 * width."""
    depth = width - PERIOD
    inside = np.zeros(PERIOD, dtype=bool)
    inside[list(COVER)] = True
    pos = np.flatnonzero(inside[np.arange(len(buf) - 2 * width) % PERIOD])
    at = np.full(len(buf) + 2 * width, -1, dtype=np.int64)
    at[pos] = np.arange(len(pos))

    def ahead(rank, by):  # rank of the sample `by` bytes on; past the end all rank alike
        j = at[pos + by]
        return np.where(j >= 0, rank[j], -1)

    single = dense_rank(*[load64(buf, pos + 8 * k) for k in range(PERIOD // 8)])
    rank, have = single, PERIOD
    while have * 2 <= depth:
        rank = dense_rank(rank, ahead(rank, have))
        have *= 2
    while have + PERIOD <= depth:
        rank = dense_rank(rank, ahead(single, have))
        have += PERIOD
    while have < depth:  # fewer than PERIOD bytes are left
        step = min(8, depth - have)
        rank = dense_rank(rank, load64(buf, pos + have) >> np.uint64(64 - 8 * step))
        have += step
    out = np.full(len(buf), -1, dtype=np.int64)
    out[pos] = rank
    return out


def sort_bucket(buf: np.ndarray, suffixes: np.ndarray, width: int) -> np.ndarray:
    """Class of each suffix position by its first ``width`` bytes, numbered in suffix order.

    ``buf`` ends with 2 * width spare bytes.  Suffixes are sorted by PERIOD bytes; ties go through rounds of
    three-way partition around one suffix of the tie, each comparison using the cover ranks.
    """
    if width < 3 * PERIOD:
        return dense_rank(*[buf[suffixes + k] for k in range(width)])
    rank, shift = cover_ranks(buf, width), cover_shift()
    group = dense_rank(*[load64(buf, suffixes + 8 * k) for k in range(PERIOD // 8)])
    order = np.argsort(group, kind="stable")
    done = np.zeros(len(suffixes), dtype=np.int64)  # first place of the class
    place = np.arange(len(order))
    g = group[order]
    head = np.searchsorted(g, g)  # place of the tie's first member
    last = [load64(buf, suffixes + width - PERIOD + 8 * k) for k in range(PERIOD // 8)]
    active = np.ones(len(order), dtype=bool)
    while True:
        idx = place[active]
        if not len(idx):
            break
        me, pivot = order[idx], order[head[idx]]
        a, b = suffixes[me], suffixes[pivot]
        d = shift[a % PERIOD, b % PERIOD]
        cmp = np.sign(rank[a + d] - rank[b + d])
        for v in last:
            cmp = np.where(cmp == 0, (v[me] > v[pivot]).astype(np.int64) - (v[me] < v[pivot]), cmp)
        # stable three-way partition inside every tie: less, equal (settled), greater
        step = np.lexsort((cmp, head[idx]))
        order[idx] = me[step]
        cmp, start = cmp[step], head[idx]
        new = np.ones(len(idx), dtype=bool)
        new[1:] = (cmp[1:] != cmp[:-1]) | (start[1:] != start[:-1])
        head[idx] = idx[np.flatnonzero(new)[np.cumsum(new) - 1]]
        settled = cmp == 0
        done[order[idx[settled]]] = head[idx[settled]]
        active[idx[settled]] = False
    return done


def repeated_strings(buf: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """For strings ``first[r] .. first[r] + count[r] - 1`` of every run r: is there an equal string?"""
    at = T.ranges(first, count)
    kind = sort_bucket(np.concatenate((buf, np.zeros(2 * width, dtype=np.uint8))), at, width)
    return np.bincount(kind, minlength=len(at))[kind] > 1


RUNS = "key long, content long, __row long, start int, n int, body binary"


def cut_again(pieces: pa.Array, keys: np.ndarray, owner: np.ndarray, begins: np.ndarray, width: int, gram: int):
    """Batches of RUNS: byte pieces (of bucket ``keys``, text ``owner``, from byte ``begins``) cut by a longer gram, with
    the hash of each run's bytes and the bytes."""
    for a, _, buf, offs in T.text_chunks(pieces):
        low, content, row, begin, n = runs(buf, offs, width, min(gram, width), salt=0x5851F42D4C957F2D)
        size = n + width - 1
        body = pa.Array.from_buffers(
            pa.binary(), len(row), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)),
                                    pa.py_buffer(np.ascontiguousarray(buf[T.ranges(offs[row] + begin, size)]))])
        key = T.mix(low + keys[a + row].view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(owner[a + row]),
             pa.array((begins[a + row] + begin).astype(np.int32)), pa.array(n.astype(np.int32)), body],
            ["key", "content", "__row", "start", "n", "body"])


def fine_runs(fetched: DataFrame, width: int) -> DataFrame:
    """From (__row, z, need): the needed runs of each text, cut again by a longer gram."""
    def run(batches):
        for batch in batches:
            pieces, asked = T.needed_pieces(batch.column("z"), batch.column("need"), "start", "n", width - 1)
            owner = np.repeat(batch.column("__row").to_numpy(), pc.list_value_length(batch.column("need")).to_numpy())
            yield from cut_again(pieces, asked.field("bucket").to_numpy(), owner, asked.field("start").to_numpy(), width,
                                 FINE_GRAMS[0])

    return fetched.mapInArrow(run, RUNS)


def finer_runs(fine: DataFrame, width: int, gram: int) -> DataFrame:
    """RUNS of large buckets, cut again by a still longer gram."""
    def run(batches):
        for batch in batches:
            key, owner, start = (batch.column(c).to_numpy() for c in ("key", "__row", "start"))
            yield from cut_again(batch.column("body"), key, owner, start, width, gram)

    return fine.mapInArrow(run, RUNS)


def sorted_spans(fine: DataFrame, width: int) -> DataFrame:
    """Byte spans of repeated strings of the fetched runs; one bucket after the other in every task.

    No bucket may be over BLOCK_BYTES: it is sorted in one piece."""
    fine = fine.repartition("key").sortWithinPartitions("key")

    def shared_keys(table, cuts):
        """Only buckets of several runs: a run holds no string twice."""
        size = np.diff(cuts)
        rows = np.repeat(size > 1, size)
        return table.filter(pa.array(rows)), np.concatenate(([0], np.cumsum(size[size > 1])))

    def blocks(table, cuts):
        """Whole buckets, about BLOCK_BYTES at once."""
        sizes = np.diff(np.concatenate(([0], np.cumsum(table.column("n").to_numpy() + width)))[cuts])
        a = 0
        while a < len(sizes):
            total = np.cumsum(sizes[a:])
            b = a + max(1, int(np.searchsorted(total, BLOCK_BYTES, side="right")))
            yield table.slice(int(cuts[a]), int(cuts[b] - cuts[a]))
            a = b

    def run(batches):
        for table, cuts in T.whole_groups(batches, ["key"]):
            table, cuts = shared_keys(table, cuts)
            for block in blocks(table, cuts):
                body = block.column("body").combine_chunks()
                offs = np.frombuffer(body.buffers()[1], dtype=np.int32)[body.offset : body.offset + len(body) + 1]
                offs = offs.astype(np.int64)
                buf = np.frombuffer(body.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
                offs = offs - offs[0]
                n = block.column("n").to_numpy().astype(np.int64)
                again = repeated_strings(buf, offs[:-1], n, width)
                row = np.repeat(np.arange(len(n)), n)
                place = T.ranges(np.zeros(len(n), dtype=np.int64), n)
                edge = np.ones(len(again), dtype=bool)
                edge[1:] = (again[1:] != again[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(edge)
                end = np.concatenate((begin[1:], [len(again)])) - 1
                hit = again[begin]
                begin, end = begin[hit], end[hit]
                start = block.column("start").to_numpy().astype(np.int64)[row[begin]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.column("__row").to_numpy()[row[begin]]),
                     pa.array((start + place[begin]).astype(np.int32)),
                     pa.array((start + place[end] + width).astype(np.int32))], ["__row", "start", "end"])

    return fine.mapInArrow(run, "__row long, start int, end int")


def strings(fine: DataFrame, width: int) -> DataFrame:
    """(string, __row, start): the bytes of every string of the runs."""
    def run(batches):
        for batch in batches:
            owner, begins = batch.column("__row").to_numpy(), batch.column("start").to_numpy()
            for a, _, buf, offs in T.text_chunks(batch.column("body")):
                at, row = T.window_rows(offs, width)
                step = max(T.CHUNK // width, 1)
                for i in range(0, len(at), step):
                    here, of = at[i : i + step], row[i : i + step]
                    yield pa.RecordBatch.from_arrays(
                        [T.binary_column(buf[here[:, None] + np.arange(width)]), pa.array(owner[a + of]),
                         pa.array((begins[a + of] + here - offs[of]).astype(np.int32))], ["string", "__row", "start"])

    return fine.select("__row", "start", "body").mapInArrow(run, "string binary, __row long, start int")


def equal_strings(fine: DataFrame, width: int) -> DataFrame:
    """Byte spans of repeated strings, whose bytes are grouped by Spark: partial counts, spilling sorts, no bucket whole."""
    rows = written(strings(fine, width), "suffix-strings")
    again = rows.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select("string")
    # as above: a string that many texts hold meets its count in a join that can be split
    found = rows.join(written(again, "suffix-repeated"), "string")
    return found.select("__row", "start", (F.col("start") + F.lit(width)).alias("end"))


def fine_spans(fine: DataFrame, width: int, longer: tuple[int, ...] = FINE_GRAMS[1:]) -> DataFrame:
    """Byte spans of repeated strings of RUNS; buckets over BLOCK_BYTES are cut again by each gram of ``longer``."""
    fine = written(fine, "suffix-fine")
    end = (F.col("start") + F.col("n") + F.lit(width - 1)).alias("end")
    per = fine.groupBy("key").agg(
        F.count("*").alias("c"), F.min("content").alias("c0"), F.max("content").alias("c1"),
        F.sum(F.col("n").cast("long") + F.lit(width)).alias("size")).where("c > 1")
    per = written(per.select("key", (F.col("c0") == F.col("c1")).alias("one"),
                             (F.col("size") > F.lit(BLOCK_BYTES)).alias("large")), "suffix-keys")
    same = fine.select("key", "__row", "start", "n").join(per.where("one").select("key"), "key")
    found = same.select("__row", "start", end).unionByName(
        sorted_spans(fine.join(per.where("not one and not large").select("key"), "key"), width))
    large = per.where("not one and large").select("key")
    if large.isEmpty():
        return found

    # what many texts hold alike is one representative and repeated as a whole; only different contents are cut again
    rows = written(fine.join(large, "key"), "suffix-large")
    kinds = rows.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct("__row", "start")).alias("r"))
    kinds = written(kinds.select("key", "content", "copies", "r.*"), "suffix-large-kinds")
    copied = rows.select("key", "content", "__row", "start", "n").join(
        kinds.where("copies > 1").select("key", "content"), ["key", "content"])
    found = found.unionByName(copied.select("__row", "start", end))
    rest = rows.join(kinds.drop("copies"), ["key", "content", "__row", "start"])
    if not longer:
        return found.unionByName(equal_strings(rest, width))
    return found.unionByName(fine_spans(finer_runs(rest, width, longer[0]), width, longer[1:]))


def repeated_spans(texts: DataFrame, width: int) -> DataFrame:
    """(row, start byte, end byte) of repeated strings; spans may overlap."""
    found = text_runs(texts, width)
    per = found.groupBy("bucket").agg(F.count("*").alias("c"), F.min("content").alias("c0"),
                                      F.max("content").alias("c1")).where("c > 1")
    # a table of its own: a bucket of many runs then meets it in a plain join, whose partitions can be split
    per = written(per.select("bucket", (F.col("c0") == F.col("c1")).alias("one")), "suffix-buckets")
    live = written(found.join(per, "bucket"), "suffix-runs")
    end = (F.col("start") + F.col("n") + F.lit(width - 1)).alias("end")
    same = live.where("one").select("__row", "start", end)

    mixed = live.where("not one").drop("one")
    kinds = mixed.groupBy("bucket", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("__row", "start", "n")).alias("r"))
    kinds = written(kinds.select("bucket", "content", "copies", "r.*"), "suffix-kinds")
    copied = mixed.join(kinds.where("copies > 1").select("bucket", "content"), ["bucket", "content"])
    copied = copied.select("__row", "start", end)

    # a run with copies is a repeat already (`copied`); it takes part as a partner of the others
    need = kinds.groupBy("__row").agg(F.collect_list(F.struct("bucket", "start", "n")).alias("need"))  # of one text
    fetched = packed(texts, "__row").join(need, "__row")
    return same.unionByName(copied).unionByName(fine_spans(fine_runs(fetched, width), width))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 as_text: bool = False) -> DataFrame:
    """Per row: __row, id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256.

    With ``as_text``, kept is a string (null for a null text); characters that lost some of their bytes go."""
    prepare(docs.sparkSession)
    texts = docs.select(*(["__row"] if "__row" in docs.columns else []), id_col, text_col)
    texts = keyed(texts, id_col).select("__row", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = repeated_spans(texts.select("__row", "text"), width)
    spans = found.groupBy("__row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = packed(texts, "__row", "id").join(spans, "__row", "left")

    def run(batches):
        for batch in batches:
            size, gone, count, kept = [], [], [], []
            texts = T.unpack_texts(batch.column("z"))
            for raw, held in zip(texts, batch.column("spans")):
                raw = raw or b""
                size.append(len(raw))
                pieces, at, lost, n = [], 0, 0, 0
                if held.is_valid:
                    a, b = T.merge_spans(held.values.field("start").to_numpy(), held.values.field("end").to_numpy())
                    n = len(a)
                    for lo, hi in zip(a.tolist(), b.tolist()):
                        pieces.append(raw[at:lo])
                        lost += hi - lo
                        at = hi
                pieces.append(raw[at:])
                gone.append(lost)
                count.append(n)
                kept.append(b"".join(pieces))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            if as_text:
                kept = [x.decode("utf-8", "ignore") if t is not None else None for x, t in zip(kept, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), batch.column("id"), *(pa.array(x, pa.int64()) for x in (size, gone, count)),
                 pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(sha, pa.string())],
                ["__row", "id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = dict(texts.dtypes)["id"]
    return joined.mapInArrow(run, f"__row long, id {kind}, n_bytes long, n_removed long, n_spans long, "
                                  f"kept {'string' if as_text else 'binary'}, kept_sha256 string")
