"""Phrase collocations counted on a prefix-free parse of the corpus.

1. Parse.  Every text is cut into chunks at trigger words (the word's hash is divisible by ``MEAN``), so equal
   passages are cut alike wherever they stand.  A chunk owns the words up to the next trigger (at most ``MOST``) and
   overlaps the next one by ``LONGEST - 1`` words; it keeps piece borders as line feeds.  The distinct chunks with
   their parse frequencies are the dictionary: a passage that a million documents share is one entry.
2. Count.  An n-gram belongs to the chunk that owns its first word, so overlaps are counted once; its weight is the
   chunk's frequency.  Counting goes up by length: an n-gram can occur ``LEAST`` times only if its first and last
   n-1 words do, so others are left out before the shuffle.  The frequent (n-1)-grams are a bitmap of fixed size
   (``BITS``) that is broadcast; where they are too many for one bitmap, their hashes are dealt to as many rounds as
   are needed, each with a bitmap of its own, and every n-gram is counted in the round of its first n-1 words.
   A bitmap lets too much through and loses nothing; the counts are of the phrases themselves.
3. Score, drop and rank with joins on phrases (all parts of a frequent phrase are frequent).  The best rows of a
   language are found by a rank limit that is applied in every task before the shuffle.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count again; ids are not
used; ties in score and count go by phrase (byte order); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clinops.llm import textops as T
from clinops.llm.block_dedup import bitmap_rows, collected, in_bitmap
from clinops.llm.common import checkpoint, prepare, written

MEAN = 32  # words between triggers
MOST = 128  # words a chunk may own
LONGEST = 4  # words of a phrase
LEAST = 30
TOP = 2000
BITS = 26  # of a bitmap of frequent phrases; a quarter of an entry per 16 bits
PARTIAL_ROWS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)  # ends a piece
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()  # between words
_GAP[[9, 32]] = True
_LINE = np.zeros(256, dtype=bool)  # the same in chunks
_LINE[10] = True
_CHUNK_GAP = _LINE.copy()
_CHUNK_GAP[32] = True


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The (overlapping) slices of a byte buffer as strings."""
    size = end - start
    offs = np.concatenate(([0], np.cumsum(size)))
    data = buf[T.ranges(start, size)]
    if offs[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(data))


def pieces_before(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Whether a piece border lies between a word and the one before it."""
    seen = np.concatenate(([0], np.cumsum(breaks[buf])))
    out = np.zeros(len(starts), dtype=bool)
    out[1:] = seen[starts[1:]] != seen[ends[:-1]]
    return out


def chunks_of(buf: np.ndarray, offs: np.ndarray, mean: int = MEAN, most: int = MOST):
    """(row, chunk strings, owned words) of the texts in a byte buffer."""
    buf = _LOWER[buf]
    starts, ends, first = T.word_bounds(buf, offs, _GAP)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int32)
    cut = T.word_hashes(buf, starts, ends) % np.uint64(mean) == 0
    cut[first[:-1][first[:-1] < first[1:]]] = True
    at = np.arange(n)
    cut |= (at - np.maximum.accumulate(np.where(cut, at, 0))) % most == 0
    begin = np.flatnonzero(cut)
    owned_end = np.append(begin[1:], n)
    row = np.searchsorted(first, begin, side="right") - 1
    end = np.minimum(owned_end + LONGEST - 1, first[row + 1])
    line = pieces_before(buf, starts, ends, _BREAK)
    size = ends - starts + 1  # every word and one byte after it
    flat = np.append(buf, np.uint8(32))[T.ranges(starts, size)]
    place = np.concatenate(([0], np.cumsum(size)))
    flat[place[1:] - 1] = np.where(np.append(line[1:], False), 10, 32)
    return row, strings(flat, place[begin], place[end] - 1), (owned_end - begin).astype(np.int32)


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, own, freq): the distinct chunks of all texts."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            lang = batch.column("lang")
            for a, _, buf, offs in T.text_chunks(batch.column("text")):
                row, chunk, own = chunks_of(buf, offs)
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(a + row)), chunk.cast(pa.string()), pa.array(own)],
                                                 ["lang", "chunk", "own"])

    found = rows.mapInArrow(run, "lang string, chunk string, own int")
    return written(found.groupBy("lang", "chunk", "own").agg(F.count("*").alias("freq")), "chunks")


def lang_hashes(column: pa.Array) -> np.ndarray:
    """A hash per row of the language column."""
    out = np.zeros(len(column), dtype=np.uint64)
    for a, b, buf, offs in T.text_chunks(column):
        out[a:b] = T.span_hash(T.prefix_hash(buf), offs[:-1], offs[1:])
    return out


def phrase_bitmap(phrases: DataFrame, n: int, bits: int, rounds: int, turn: int) -> np.ndarray:
    """Bitmap of the frequent n-word phrases whose hash belongs to this round."""
    def run(batches):
        for batch in batches:
            langs = lang_hashes(batch.column("lang"))
            for a, b, buf, offs in T.text_chunks(batch.column("phrase")):
                starts, ends, first = T.word_bounds(buf, offs, _CHUNK_GAP)
                h = T.mix(T.window_hashes(T.word_hashes(buf, starts, ends), n)[first[:-1]] ^ langs[a:b])
                yield bitmap_rows(h[h % np.uint64(rounds) == turn], bits)

    return collected(phrases.select("lang", "phrase").mapInArrow(run, "word long, bit long"), bits)


def counted(chunks: DataFrame, n: int, shared=None, bits: int = BITS, rounds: int = 1, turn: int = 0) -> DataFrame:
    """(lang, phrase, f): occurrences of the n-grams of this round that the bitmap does not rule out."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            langs = lang_hashes(batch.column("lang")) if n > 1 else None
            own_all, freq_all = batch.column("own").to_numpy(), batch.column("freq").to_numpy()
            for a, b, buf, offs in T.text_chunks(batch.column("chunk")):
                starts, ends, first = T.word_bounds(buf, offs, _CHUNK_GAP)
                count = np.minimum(own_all[a:b], np.diff(first) - n + 1)
                count = np.maximum(count, 0)
                row = np.repeat(np.arange(b - a), count)
                at = T.ranges(first[:-1], count)
                if n > 1:
                    line = np.cumsum(pieces_before(buf, starts, ends, _LINE))
                    whole = line[at] == line[at + n - 1]
                    at, row = at[whole], row[whole]
                    h = T.window_hashes(T.word_hashes(buf, starts, ends), n - 1)
                    lead, rest = (T.mix(h[at + k] ^ langs[a:b][row]) for k in (0, 1))
                    ok = lead % np.uint64(rounds) == turn
                    ok &= in_bitmap(shared.value, lead, bits)
                    ok &= (rest % np.uint64(rounds) != turn) | in_bitmap(shared.value, rest, bits)
                    at, row = at[ok], row[ok]
                held.append(pa.table({"lang": batch.column("lang").take(pa.array(a + row)),
                                      "phrase": strings(buf, starts[at], ends[at + n - 1]).cast(pa.string()),
                                      "f": pa.array(freq_all[a + row])}))
                size += len(at)
                if size >= PARTIAL_ROWS:
                    yield from summed(held)
                    held, size = [], 0
        if held:
            yield from summed(held)

    return chunks.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def summed(tables: list[pa.Table]) -> list[pa.RecordBatch]:
    """Counts of equal phrases added up before they leave the task."""
    table = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
    return table.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"]).combine_chunks().to_batches()


def frequent_phrases(chunks: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to LONGEST words that occur at least ``least`` times."""
    spark = chunks.sparkSession
    levels = [written(counted(chunks, 1).where(F.col("f") >= least), "words")]
    for n in range(2, LONGEST + 1):
        rounds = max(1, -(-levels[-1].count() * 16 // (1 << bits)))
        out = None
        for turn in range(rounds):
            shared = spark.sparkContext.broadcast(phrase_bitmap(levels[-1], n - 1, bits, rounds, turn))  # 2**bits / 8 bytes
            found = written(counted(chunks, n, shared, bits, rounds, turn).where(F.col("f") >= least), "phrases")
            shared.unpersist()
            out = found if out is None else out.unionByName(found)
        levels.append(out)
    every = None
    for n, level in enumerate(levels, 1):
        level = level.withColumn("words", F.lit(n))
        every = level if every is None else every.unionByName(level)
    return every


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all candidates: the cut with the lowest score."""
    parts = phrases.select("lang", "phrase", "f")
    cuts = phrases.where("words > 1").withColumnRenamed("f", "a").withColumn(
        "k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("lead", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(parts.toDF("lang", "lead", "l"), ["lang", "lead"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    exact = "(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    cuts = cuts.withColumn("score", F.expr(exact))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def held_by_longer(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the count of the most frequent longer candidate around a phrase."""
    inner = ("flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m), "
             "i -> array_join(slice(w, i + 1, m), ' '))))")
    longer = candidates.where("words > 2").withColumn("w", F.split("phrase", " "))
    return longer.select("lang", F.explode(F.expr(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
                 bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    chunks = dictionary(docs, text_col, lang_col)
    sizes = checkpoint(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n")))
    candidates = checkpoint(scored(frequent_phrases(chunks, least, bits)))
    left = candidates.join(held_by_longer(candidates), ["lang", "phrase"], "left")
    left = left.where(F.coalesce(100 * F.col("longer").cast("decimal(20,0)") < 80 * F.col("a").cast("decimal(20,0)"),
                                 F.lit(True)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                           F.col("score").cast("long").alias("score"))
