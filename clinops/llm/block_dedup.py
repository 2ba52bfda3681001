"""Substring dedup by fixed-block anchors.

A repeat is a run of ``width`` words that an earlier document (smaller id) also contains.  Every document
is cut into non-overlapping reference blocks of ``width // 2`` words; any run of ``width`` words holds at
least one whole block of the document it comes from.  So it is enough to

1. index the blocks (a bitmap of ``2**bitmap_bits`` bits; such bitmaps are the only things broadcast: their size
   is fixed by the parameter; a fuller bitmap lets more probes through and loses none),
2. probe with every rolling block-long window of every document; blocks and hits are *occurrences* of a
   block text, keyed by its hash, each with its context: the words up to ``width - block`` on both sides,
3. group occurrences by block (counts, smallest ids: partial aggregates, so a passage that a third of all
   documents hold is combined before the shuffle), drop those that stand alone (by a second bitmap, then a join),
4. extend: where all occurrences of a block have one context, all its windows repeat; where contexts differ,
   one occurrence per distinct context is fetched, the hits are extended word by word to every window of
   ``width`` words around the block, and equal windows meet by their hash with the smallest id of each,
5. join the result back to the occurrences and remove the words of windows that an earlier document holds.

Texts are shuffled twice whatever the number of repeats; pairs of documents are never formed.  Word runs
are compared by 64-bit hashes of the whole run.

Defined cases: null or word-less texts have no words and nothing to remove; documents shorter than ``width``
are kept whole; rows with the same id do not count as earlier than each other; rows with a null id come
after all others.
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

LAST = (1 << 63) - 1


def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a block hash in a bitmap."""
    return h >> np.uint64(64 - bits), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(h), dtype=bool)
    for slot in slots(h, bits):
        ok &= (bitmap[slot >> np.uint64(6)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return ok


def bitmap_rows(h: np.ndarray, bits: int) -> pa.RecordBatch:
    at = np.concatenate(slots(h, bits))
    bit = np.uint64(1) << (at & np.uint64(63))
    return pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))],
                                      ["word", "bit"])


def collected(rows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap from its (word, bit) rows; 2**bits / 8 bytes come to the driver at most."""
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("b")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("b").to_numpy()
    return bitmap


def block_bitmap(texts: DataFrame, width: int, bits: int) -> np.ndarray:
    """Bitmap of the hashes of all reference blocks."""
    block = width // 2

    def run(batches):
        for batch in batches:
            for _, _, buf, offs in T.text_chunks(batch.column("text")):
                starts, ends, first = T.word_bounds(buf, offs)
                at, row = T.window_rows(first, block)
                keep = ((at - first[row]) % block == 0) & (np.diff(first)[row] >= width)
                yield bitmap_rows(T.window_hashes(T.word_hashes(buf, starts, ends), block)[at[keep]], bits)

    return collected(texts.select("text").mapInArrow(run, "word long, bit long"), bits)


def key_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the block hashes in column ``block``."""
    def run(batches):
        for batch in batches:
            yield bitmap_rows(batch.column("block").to_numpy().view(np.uint64), bits)

    return collected(keys.select("block").mapInArrow(run, "word long, bit long"), bits)


def occurrences(texts: DataFrame, width: int, bits: int, shared) -> DataFrame:
    """(block, context, row, doc, at, left, span): rolling windows of every text that the bitmap holds.  ``left``
    is the words of the context before the block, ``span`` all its words."""
    block = width // 2
    side = width - block

    def run(batches):
        bitmap = shared.value
        for batch in batches:
            rows, docs = (batch.column(c).to_numpy() for c in ("__row", "doc"))
            for a, _, buf, offs in T.text_chunks(batch.column("text")):
                starts, ends, first = T.word_bounds(buf, offs)
                n_words = np.diff(first)
                prefix = T.prefix_hash(T.word_hashes(buf, starts, ends))
                h = T.rolling_hash(prefix, block)
                at, row = T.window_rows(first, block)
                long = n_words[row] >= width
                at, row = at[long], row[long]
                hit = in_bitmap(bitmap, h[at], bits)
                at, row = at[hit], row[hit]
                lo = np.maximum(at - side, first[row])
                hi = np.minimum(at + block + side, first[row + 1])
                context = T.mix(T.span_hash(prefix, lo, hi) + (at - lo).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[at].view(np.int64)), pa.array(context.view(np.int64)), pa.array(rows[a + row]),
                    pa.array(docs[a + row]), pa.array((at - first[row]).astype(np.int32)),
                    pa.array((at - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                    ["block", "context", "__row", "doc", "at", "left", "span"])

    return texts.mapInArrow(run, "block long, context long, __row long, doc long, at int, left int, span int")


def context_windows(fetched: DataFrame, width: int) -> DataFrame:
    """From (__row, doc, z, need): (window, doc, d1, __row, start) for every ``width``-word window of the needed
    contexts, once per text; ``d1`` is the largest document that holds one of the contexts around it."""
    def run(batches):
        for batch in batches:
            need = batch.column("need")
            asked, per = need.flatten(), pc.list_value_length(need).to_numpy()
            row = np.repeat(np.arange(len(need)), per)
            at, left, span, d1 = (asked.field(c).to_numpy() for c in ("at", "left", "span", "d1"))
            keys, docs = batch.column("__row").to_numpy(), batch.column("doc").to_numpy()
            for a, b, buf, offs in T.text_chunks(pa.array(T.unpack_texts(batch.column("z")), pa.binary())):
                starts, ends, first = T.word_bounds(buf, offs)
                h = T.window_hashes(T.word_hashes(buf, starts, ends), width)
                mine = slice(*np.searchsorted(row, (a, b)))
                n = span[mine] - width + 1
                place = T.ranges(first[row[mine] - a] + at[mine] - left[mine], n)
                last = np.full(len(starts) + 1, -1, dtype=np.int64)
                np.maximum.at(last, place, np.repeat(d1[mine], n))
                place = np.flatnonzero(last >= 0)
                owner = np.searchsorted(first, place, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[place].view(np.int64)), pa.array(docs[a + owner]), pa.array(last[place]),
                     pa.array(keys[a + owner]), pa.array((place - first[owner]).astype(np.int32))],
                    ["window", "doc", "d1", "__row", "start"])

    return fetched.select("__row", "doc", "z", "need").mapInArrow(
        run, "window long, doc long, d1 long, __row long, start int")


def context_runs(answered: DataFrame, width: int) -> DataFrame:
    """From (need, found): (block, context, lo, hi, d0) for runs of windows of a context that first occur in
    document ``d0``; lo and hi are the starts of the first and last window, counted from the block."""
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for need, found in zip(batch.column("need"), batch.column("found")):
                start, d0 = found.values.field("start").to_numpy(), found.values.field("d0").to_numpy()
                order = np.argsort(start)
                start, d0 = start[order], d0[order]
                cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(d0) != 0)) + 1  # runs in the whole text
                first, last = start[np.concatenate(([0], cut))], start[np.concatenate((cut - 1, [len(start) - 1]))]
                d0 = d0[np.concatenate(([0], cut))]
                asked = need.values
                at, left, span = (asked.field(c).to_numpy() for c in ("at", "left", "span"))
                begin, end = at - left, at - left + span - width
                a, b = np.searchsorted(last, begin), np.searchsorted(first, end, side="right")
                n = np.maximum(b - a, 0)
                which, k = np.repeat(np.arange(len(at)), n), T.ranges(a, n)
                out[0].append(asked.field("block").to_numpy()[which])
                out[1].append(asked.field("context").to_numpy()[which])
                out[2].append(np.maximum(first[k], begin[which]) - at[which])
                out[3].append(np.minimum(last[k], end[which]) - at[which])
                out[4].append(d0[k])
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(t)) for x, t in zip(out, ("i8", "i8", "i4", "i4", "i8"))],
                    ["block", "context", "lo", "hi", "d0"])

    return answered.select("need", "found").mapInArrow(run, "block long, context long, lo int, hi int, d0 long")


def repeated_runs(texts: DataFrame, width: int, bits: int) -> DataFrame:
    """(row, start word, end word): runs that an earlier document also holds (they may overlap)."""
    share = texts.sparkSession.sparkContext.broadcast
    per = occurrences(texts, width, bits, share(block_bitmap(texts, width, bits))).groupBy("block").agg(
        F.count("*").alias("n"), F.min("doc").alias("d0"), F.max("doc").alias("d1"),
        F.min("context").alias("c0"), F.max("context").alias("c1"))
    per = per.where("n > 1 and d0 < d1").select("block", "d0", (F.col("c0") == F.col("c1")).alias("one"))
    # a table of its own: a block of many hits then meets it in a plain join, whose partitions can be split
    per = written(per, "block-counts")
    live = occurrences(texts, width, bits, share(key_bitmap(per, bits))).where(F.col("span") >= width)
    live = written(live.join(per, "block"), "block-hits")

    # one context: every window of the occurrence is in the smallest document that holds the block
    lo = F.col("at") - F.col("left")
    full = live.where("one and doc > d0").select("__row", lo.alias("start"), (lo + F.col("span")).alias("end"))

    # several contexts: extend one occurrence of each
    mixed = live.where("not one").drop("one", "d0")
    kinds = mixed.groupBy("block", "context").agg(
        F.min(F.struct("doc", "__row", "at", "left", "span")).alias("r"), F.max("doc").alias("d1"))
    kinds = kinds.select("block", "context", "d1", "r.*")
    need = written(kinds.groupBy("__row").agg(F.collect_list(  # of one text
        F.struct("block", "context", "d1", "at", "left", "span")).alias("need")), "block-contexts")
    wins = written(context_windows(packed(texts, "__row", "doc").join(need, "__row"), width), "block-windows")
    least = wins.groupBy("window").agg(F.min("doc").alias("d0"), F.max("d1").alias("d1")).where("d0 < d1")
    found = wins.select("window", "__row", "start").join(written(least.select("window", "d0"), "block-firsts"), "window")
    found = found.groupBy("__row").agg(F.collect_list(F.struct("start", "d0")).alias("found"))  # of one text
    extended = context_runs(need.join(found, "__row"), width)
    part = mixed.join(extended, ["block", "context"]).where("d0 < doc")
    part = part.select("__row", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + width).alias("end"))
    return full.unionByName(part)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50,
                 bitmap_bits: int = 28) -> DataFrame:
    """Per row: __row, id, n_words, n_removed, kept (the remaining words joined by one space) and kept_sha256."""
    prepare(docs.sparkSession)
    texts = keyed(docs.select("__row", id_col, text_col) if "__row" in docs.columns else docs.select(id_col, text_col),
                  id_col)
    texts = texts.select("__row", F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias(
        "doc"), F.col(text_col).alias("text"))
    runs = repeated_runs(texts.select("__row", "doc", "text"), width, bitmap_bits)
    spans = runs.groupBy("__row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = packed(texts, "__row", "id").join(spans, "__row", "left")

    def run(batches):
        for batch in batches:
            n_words, n_gone, kept = [], [], []
            spans = batch.column("spans")
            for text, held in zip(T.unpack_texts(batch.column("z")), spans):
                words = (text or b"").split()
                n_words.append(len(words))
                gone = 0
                if held.is_valid:
                    v = held.values
                    a, b = T.merge_spans(v.field("start").to_numpy(), v.field("end").to_numpy())
                    for lo, hi in zip(a[::-1].tolist(), b[::-1].tolist()):
                        gone += hi - lo
                        del words[lo:hi]
                n_gone.append(gone)
                kept.append(b" ".join(words))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
                ["__row", "id", "n_words", "n_removed", "kept", "kept_sha256"])

    kind = dict(texts.dtypes)["id"]
    return joined.mapInArrow(run, f"__row long, id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
