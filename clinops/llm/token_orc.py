"""Token ids of whole texts in ORC files.

Texts are encoded with a public tokenizer file and end with one end id.  Documents are range-partitioned and
sorted by id, so the files hold ascending ids, file after file.  ORC keeps the ids in stripes with integer
run-length encoding, row indexes every ``INDEX_ROWS`` rows and Bloom filters on the document id: readers take
stripes in parallel, and a lookup by id skips files, stripes and row groups by their metadata.

Reading back, the start of each document is its running token count: sums per range of ids first (one row a
range), then running counts inside each range, never one global window over documents.

Encoding splits a text at ASCII white space, which this kind of vocabulary drops and never merges across, and
keeps the ids of recent words in a bounded table, looked up by 64-bit word hashes for whole pieces at once.  A
tokenizer file that normalises or splits in another way encodes whole texts by the library instead.

``lookup`` reads documents by id: the ids are pushed to the ORC reader, which skips files, stripes and row groups by
their ranges and Bloom filters.

Defined cases: null and empty texts hold the end id only; repeated rows are all written; rows with a null id
come first; an empty table gives an empty result (ORC files without rows); other columns, whatever their names, are not
read; a lookup of ids that are null or not stored finds no row for them.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clinops.llm import textops as T
from clinops.llm.common import checkpoint, prepare, shared_folder

END_ID = 1
SLOT_BITS = 21
MOST_IDS = 8_000_000
MOST_PIECES = 400_000
INDEX_ROWS = 10_000
STRIPE_BYTES = 32 << 20

SIGNS = ".,;:!?%*$&#|"
#: Letters that lower-casing and normalisation treat one by one; other words go through the whole tokenizer.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The normaliser and split that the short way holds for (fixed values of that kind of vocabulary).
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

_LOADED: dict[tuple[str, int], WordIds] = {}


class WordIds:
    """Ids of white-space separated words, looked up for whole pieces of text at once.

    A direct-mapped table of ``2**SLOT_BITS`` recent words by their 64-bit hash points into a store of ids; a
    word it does not hold is encoded and takes the place of the one before.  The store starts anew when full."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.end_id = end_id
        made = json.loads(self.tokenizer.to_str())
        self.by_words = (made["normalizer"], made["pre_tokenizer"], made["post_processor"], made["truncation"],
                         made["model"]["type"]) == (NORMALIZER, SPLIT, None, None, "BPE") and not any(
            t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in made["added_tokens"])
        self.empty()

    def empty(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, dtype=np.uint64)
        self.at = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.count = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.store = np.zeros(1 << 16, dtype=np.uint32)
        self.store[0], self.used = self.end_id, 1
        self.pieces: dict[str, bytes] = {}

    def word(self, text: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers."""
        stem = text.rstrip(SIGNS)
        if not PLAIN.fullmatch(stem):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        # the vocabulary's own split: a run of letters, then a run of other signs
        return self.piece(stem.lower()) + (self.piece(text[len(stem):]) if len(stem) < len(text) else b"")

    def piece(self, text: str) -> bytes:
        out = self.pieces.get(text)
        if out is None:
            if len(self.pieces) >= MOST_PIECES:
                self.pieces.clear()
            ids = [t.id for t in self.tokenizer.model.tokenize(text if text.isascii() else self.spell(text)[0][0])]
            out = self.pieces[text] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of each row in them), with the end id after each row."""
        if not self.by_words:
            return self.encode_whole(buf, offs)
        if self.used > MOST_IDS:
            self.empty()
        starts, ends, first = T.word_bounds(buf, offs)
        h = T.word_hashes(buf, starts, ends)
        slot = h >> np.uint64(64 - SLOT_BITS)
        at, count = self.at[slot], self.count[slot]
        miss = np.flatnonzero((self.keys[slot] != h) | (h == 0))
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            raw = buf.tobytes()
            found = [self.word(raw[a:b].decode("utf-8", "replace"))
                     for a, b in zip(starts[miss[where]].tolist(), ends[miss[where]].tolist())]
            n = np.array([len(x) for x in found], dtype=np.int64) // 4
            begin = self.used + np.concatenate(([0], np.cumsum(n)[:-1]))
            total = self.used + int(n.sum())
            if total > len(self.store):
                self.store = np.concatenate((self.store, np.zeros(max(len(self.store), total), dtype=np.uint32)))
            self.store[self.used : total] = np.frombuffer(b"".join(found), dtype="<u4")
            self.used = total
            at[miss], count[miss] = begin[back], n[back]
            place = new >> np.uint64(64 - SLOT_BITS)
            last = np.unique(place[::-1], return_index=True)[1]  # one winner where new words share a slot
            keep = len(place) - 1 - last
            self.keys[place[keep]], self.at[place[keep]], self.count[place[keep]] = new[keep], begin[keep], n[keep]
        at, count = np.insert(at, first[1:], 0), np.insert(count, first[1:], 1)
        cut = first + np.arange(len(first))
        return self.store[T.ranges(at, count)], np.concatenate(([0], np.cumsum(count)))[cut]


    def encode_whole(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, cut = buf.tobytes(), offs.tolist()
        found = [np.array([*self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids,
                           self.end_id], dtype=np.uint32) for a, b in zip(cut[:-1], cut[1:])]
        return (np.concatenate(found) if found else np.zeros(0, np.uint32),
                np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64))))


def encoder(path: str, end_id: int) -> WordIds:
    """One per Python worker, tokenizer file and end id."""
    if (path, end_id) not in _LOADED:
        _LOADED[path, end_id] = WordIds(path, end_id)
    return _LOADED[path, end_id]


def encode(rows: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of every (doc_id, text) row, in the same order."""
    def run(batches):
        words = encoder(tokenizer, end_id)
        for batch in batches:
            for a, b, buf, offs in T.text_chunks(batch.column("text")):
                ids, cut = words.encode(buf, offs)
                lists = pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def counted(rows: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``rows`` with ``n_tokens`` long (with the end id; 0 for a text without any token) in place of ``text``."""
    prepare(rows.sparkSession)
    kinds = {c: ("long" if c == "text" else t) for c, t in rows.dtypes}
    names = ["n_tokens" if c == "text" else c for c in kinds]

    def run(batches):
        words = encoder(tokenizer, end_id)
        for batch in batches:
            for a, b, buf, offs in T.text_chunks(batch.column("text")):
                n = np.diff(words.encode(buf, offs)[1])
                n = pa.array(np.where(n > 1, n, 0).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [n if c == "text" else batch.column(c).slice(a, b - a) for c in kinds], names)

    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds.values())))


def write(docs: DataFrame, path: str, tokenizer: str, files: int | None = None, id_col: str = "doc_id",
          text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the ORC files in ascending doc_id order."""
    prepare(docs.sparkSession)
    # texts are dealt out before they are encoded: they are smaller than their ids, and finding the range
    # bounds reads the rows once more
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")
    ids = encode(rows.sortWithinPartitions("doc_id"), tokenizer, end_id=end_id)
    (ids.write.option("orc.bloom.filter.columns", "doc_id")
     .option("orc.row.index.stride", INDEX_ROWS).option("orc.stripe.size", STRIPE_BYTES)
     .option("compression", "zstd").orc(path))


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """(doc_id, ids) of the documents with the given ids (a request's list, not a table's)."""
    found = spark.read.orc(path).select("doc_id", "ids")
    return found.where(F.col("doc_id").isin([i for i in ids if i is not None]))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files, whole stripes in parallel."""
    stored = spark.read.orc(path).select("doc_id", "ids")

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            offs = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1]
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4"))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs).astype(np.int64)),
                                              pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])

    kind = dict(stored.dtypes)["doc_id"]
    rows = checkpoint(stored.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long"))
    return with_starts(rows)


def with_starts(rows: DataFrame) -> DataFrame:
    """Running token counts in doc_id order: sums per id range, then inside each range."""
    ranged = checkpoint(rows.repartitionByRange("doc_id").withColumn("bin", F.spark_partition_id()))
    bins = ranged.groupBy("bin").agg(F.sum("n_tokens").alias("s"))
    ahead = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("bin").orderBy("doc_id", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    ranged = ranged.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(bins, "bin")
    return ranged.select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def digests(docs: DataFrame, tokenizer: str, path: str | None = None, **columns) -> DataFrame:
    """Write the files (to a new shared folder unless ``path`` names one) and read them back."""
    path = path or shared_folder(docs.sparkSession, "tokens") + ".orc"
    write(docs, path, tokenizer, **columns)
    return read_digests(docs.sparkSession, path)
