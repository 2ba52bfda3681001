"""WARC archives of web captures, and their index by external merge.

1. Payloads are grouped by SHA-256; the capture with the smallest id of a group is its ``response``, the others
   are ``revisit`` records that refer to it.  Groups are reduced per (digest, salt) before they meet, so a page
   that a third of all captures share is spread over ``SALTS`` keys.
2. Every task writes one archive file: a ``warcinfo`` record, then its captures.  The files are plain WARC/1.1;
   the text sink writes a record and, as its line end, the two empty lines that end a record.
3. Reading splits the files at the record border.  The border holds the archive's own id (a fresh UUID in the
   ``WARC-Warcinfo-ID`` field that follows the version line), so no payload can contain it and a large file is
   read by many tasks.  Block length and payload digest of every record are checked; a damaged record raises.
4. Every reading task leaves one capture run, sorted by URL key, timestamp and id.  The runs are merged by key
   ranges: a task receives the slices of all runs that lie in its range and merges them with a loser tree.
   Range ``i`` is wholly before range ``i + 1``, so the files of the index hold the capture histories in one
   global order.  Ranges are cut on the full key, so one URL with a third of all captures spans several of them.

Memory: one record at a time in writing and reading, about ``MERGE_ROWS`` index rows in a merge task.

Defined cases: a null payload is empty; a null URL has no target field and the empty key; control characters and
blanks of a URL are percent-encoded; null ids come after all others, equal ids are ordered by row number;
``date_col`` may be absent or null (then ``captured_at`` is the date); payloads under ``least`` bytes are all
responses; repeated rows are captures of their own; an empty table gives an index without rows; further columns
of the captures are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote_to_bytes, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinops.llm.common import checkpoint, keyed, packed, prepare, shared_folder, written

SALTS = 64
MERGE_ROWS = 1 << 19
CAPTURED_AT = "2024-01-01T00:00:00Z"
ENDS = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ORDER = ["url_key", "date", "no_id", "__row"]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels from the top domain down, then path and query, without scheme, ``www.``,
    default port, user and fragment; a string that is no URL is its own lower-case key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    at = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}"
    return ",".join(reversed(labels)) + at + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


# ---------------------------------------------------------------- responses and revisits


def first_of_each_payload(rows: DataFrame, least: int = 0) -> DataFrame:
    """(__row, first_row, first_id) of every row whose payload an earlier row also has.

    ``rows``: __row, id, n_bytes, sha.  Earlier is by id (nulls last), then by row number."""
    rows = rows.where(F.col("n_bytes") >= least).withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("__row").alias("row"))
    part = rows.groupBy("sha", "n_bytes", "salt").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    part = checkpoint(part)
    whole = part.groupBy("sha", "n_bytes").agg(F.min("first").alias("lead"), F.sum("n").alias("n")).where("n > 1")
    lead = part.drop("first", "n").join(whole.drop("n"), ["sha", "n_bytes"])
    return rows.join(lead, ["sha", "n_bytes", "salt"]).where(F.col("__row") != F.col("lead.row")).select(
        "__row", F.col("lead.row").alias("first_row"), F.col("lead.id").alias("first_id"))


# ---------------------------------------------------------------- records


def lead_lines(archive: str) -> str:
    """The two lines that begin every record of an archive."""
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"


def field(name: str, value) -> bytes:
    return f"{name}: {value}\r\n".encode()


def record_id(archive: str, row: int) -> str:
    return f"<urn:warc:{archive}:{row}>"


def named(value) -> str:
    """An id as a header value (percent-encoded)."""
    return quote(str(value), safe="")


def record(archive: str, offset: int, row: int, id_text: str | None, url: str | None, date: str, payload: bytes,
           first_row: int | None, first_id: str | None) -> bytes:
    """One capture without the two empty lines that end it."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            + field("Content-Length", len(payload)) + b"\r\n")
    body = http + payload if first_row is None else http
    head = [lead_lines(archive).encode(),
            field("WARC-Type", "response" if first_row is None else "revisit"),
            field("WARC-Record-ID", record_id(archive, row)), field("WARC-Date", date)]
    if url is not None:
        head.append(field("WARC-Target-URI", quote(url, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")))
    head.append(field("WARC-Payload-Digest", "sha1:" + digest(payload)))
    if first_row is not None:
        head += [field("WARC-Profile", PROFILE), field("WARC-Refers-To", record_id(archive, first_row))]
        if first_id is not None:
            head.append(field("Refers-To-Capture", named(first_id)))
    if id_text is not None:
        head.append(field("Capture", named(id_text)))
    head += [field("Archive-Offset", offset), field("Content-Type", "application/http; msgtype=response"),
             field("Content-Length", len(body)), b"\r\n"]
    return b"".join(head) + body


def info_record(archive: str, date: str) -> bytes:
    body = b"software: clinops\r\nformat: WARC File Format 1.1\r\n"
    return b"".join([lead_lines(archive).encode(),
                     field("WARC-Type", "warcinfo"), field("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                     field("WARC-Date", date), field("Content-Type", "application/warc-fields"),
                     field("Content-Length", len(body)), b"\r\n"]) + body


def split_record(piece: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), block and length of a record; the block must have the stated length."""
    head, _, rest = piece.partition(ENDS)
    fields = {}
    for line in head.decode().split("\r\n"):
        name, colon, value = line.partition(": ")
        if colon:
            fields[name.lower()] = value
    size = int(fields["content-length"])
    if len(rest) < size or rest[size:] not in (b"", ENDS):
        raise ValueError(f"record {fields.get('warc-record-id')}: block of {len(rest)} bytes, {size} stated")
    return fields, rest[:size], len(head) + len(ENDS) + size


def capture(piece: bytes, lead: bytes) -> dict | None:
    """The index entry of a record as the reader cuts it (without the two ``lead`` lines, but for a file's first
    record); None for the warcinfo record."""
    fields, block, length = split_record(piece.removeprefix(lead))
    kind = fields["warc-type"]
    if kind == "warcinfo":
        return None
    http, _, payload = block.partition(ENDS)
    size = int(http.rpartition(b"Content-Length: ")[2])
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"record {fields['warc-record-id']}: payload differs from its digest")
    text = lambda name: unquote_to_bytes(fields[name]).decode() if name in fields else None
    url = fields.get("warc-target-uri")
    return {"__row": int(fields["warc-record-id"].rstrip(">").rpartition(":")[2]), "id_text": text("capture"),
            "url": url, "url_key": url_key(url), "date": fields["warc-date"], "record_type": kind,
            "payload_bytes": size, "payload_digest": stated, "refers_text": text("refers-to-capture"),
            "offset": int(fields["archive-offset"]), "length": len(lead) + length}


# ---------------------------------------------------------------- writing


def write(captures: DataFrame, path: str, archive: str, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html", date_col: str | None = None, captured_at: str = CAPTURED_AT,
          least: int = 0) -> None:
    """Write the archive files of ``captures`` below ``path``; ``archive`` is a fresh UUID."""
    prepare(captures.sparkSession)
    rows = keyed(captures, id_col)
    date = F.lit(captured_at)
    if date_col:
        stamp = F.to_utc_timestamp(F.col(date_col).try_cast("timestamp"), F.current_timezone())
        date = F.coalesce(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), date)
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = rows.select("__row", F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                       date.alias("date"), F.col(payload_col).alias("body"), F.length(body).cast("long").alias("n_bytes"),
                       F.sha2(body, 256).alias("sha"))
    again = first_of_each_payload(rows.select("__row", "id", "n_bytes", "sha"), least)
    again = written(again.withColumn("first_id", F.col("first_id").cast("string")), "revisits")
    texts = packed(rows.withColumn("id", F.col("id").cast("string")), "__row", "id", "url", "date", text_col="body")
    texts = texts.join(again, "__row", "left")

    def run(batches):
        import pyarrow as pa

        from clinops.llm import textops as T

        at = 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("__row", "id", "url", "date", "first_row", "first_id")]
            for k in range(batch.num_rows):
                out = [] if at else [info_record(archive, captured_at)]
                at += sum(len(r) + len(ENDS) for r in out)
                row, id_text, url, day, first_row, first_id = (c[k] for c in cols)
                payload = T.unpack_texts(batch.column("z").slice(k, 1))[0] or b""
                out.append(record(archive, at, row, id_text, url, day, payload, first_row, first_id))
                at += len(out[-1]) + len(ENDS)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    texts.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", ENDS.decode()).text(path)


# ---------------------------------------------------------------- reading and merging


def read_captures(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """One row per capture of the archive files, in the order of the files."""
    lead = lead_lines(archive)
    pieces = spark.read.option("lineSep", ENDS.decode() + lead).text(path).select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_name").alias("file"))
    names = ["__row", "id_text", "url", "url_key", "date", "record_type", "payload_bytes", "payload_digest",
             "refers_text", "offset", "length"]

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(),
                 pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            found = [capture(p.as_buffer().to_pybytes(), lead.encode()) for p in batch.column("piece")]
            keep = [i for i, f in enumerate(found) if f is not None]
            cols = [pa.array([found[i][c] for i in keep], t) for c, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column("file").take(pa.array(keep, pa.int64()))],
                                             [*names, "file"])

    return pieces.mapInArrow(run, "__row long, id_text string, url string, url_key string, date string, "
                                  "record_type string, payload_bytes long, payload_digest string, refers_text string, "
                                  "offset long, length long, file string")


class LoserTree:
    """Tournament over sorted runs: every inner node keeps the loser of its match, so the next smallest entry
    costs one match per level on the path of the run that won."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = len(runs)
        self.loser = [0] * max(k, 1)
        win = [0] * k + list(range(k))  # winner of every node; the leaves are nodes k .. 2k-1
        for node in range(k - 1, 0, -1):
            a, b = win[2 * node], win[2 * node + 1]
            win[node], self.loser[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = win[1] if k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self):
        while self.runs and (head := self.heads[self.winner]) is not None:
            yield head
            up = self.winner
            self.heads[up] = next(self.runs[up], None)
            node = (up + len(self.runs)) // 2
            while node:
                if self.before(self.loser[node], up):
                    up, self.loser[node] = self.loser[node], up
                node //= 2
            self.winner = up


def ascending_runs(keys: list[tuple]) -> list[range]:
    """The maximal ascending stretches of a list: the slices of the runs as they arrive."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [range(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]


def merged_order(keys: list[tuple]) -> Iterable[int]:
    """Positions of ``keys`` in ascending order by a k-way merge of its ascending runs."""
    def entries(run: range):
        return ((keys[i], i) for i in run)

    return (i for _, i in LoserTree([entries(r) for r in ascending_runs(keys)]))


def sorted_runs(captures: DataFrame, name: str = "capture-runs") -> DataFrame:
    """The captures as a table whose files are runs, each sorted by URL key, timestamp and id."""
    runs = captures.withColumn("no_id", F.col("id_text").isNull()).sortWithinPartitions(*ORDER)
    return written(runs, name)


def merge_runs(runs: DataFrame, path: str, merge_rows: int = MERGE_ROWS) -> None:
    """Write the index: the runs in one global order, one key range per file."""
    spark = runs.sparkSession
    n = runs.count()
    tasks = max(1, -(-n // merge_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1024))
    ranges = runs.repartitionByRange(tasks, *ORDER)

    def run(batches):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = list(zip(*(table.column(c).to_pylist() for c in ORDER)))
        order = pa.array(list(merged_order(keys)), pa.int64())
        yield from table.take(order).combine_chunks().to_batches(max_chunksize=10_000)

    names = ", ".join(f"{c} {t}" for c, t in runs.dtypes)
    ranges.mapInArrow(run, names).write.parquet(path)


def index(captures: DataFrame, path: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Write the archives of ``captures``, read them back and return their merged index (also stored at
    ``<path>/index``): id, url, url_key, date, record_type, refers_to, payload_bytes, payload_digest, file, offset,
    length.  ``offset`` and ``length`` locate the record in its file."""
    spark = captures.sparkSession
    path = path or shared_folder(spark, "warc")
    archive = str(uuid.uuid4())
    write(captures, f"{path}/archive", archive, id_col, **options)
    runs = sorted_runs(read_captures(spark, f"{path}/archive", archive))
    merge_runs(runs, f"{path}/index")
    kind = captures.schema[id_col].dataType
    return spark.read.parquet(f"{path}/index").select(
        F.col("id_text").cast(kind).alias("id"), "url", "url_key", "date", "record_type",
        F.col("refers_text").cast(kind).alias("refers_to"), "payload_bytes", "payload_digest", "file", "offset", "length")
