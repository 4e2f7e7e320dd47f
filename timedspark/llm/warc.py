"""Web archives as tables of record chunks, written and read by Spark's own text files."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedspark.operators.stage import shared_folder

#: Code points of a payload in one chunk; longer payloads become several segment records.
CHUNK = 1 << 18
#: Repeated payloads up to which their table is broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000
#: Record version, record end, the profile of a revisit, and the digits of base 32 after those of base 16 and up.
VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CHUNKS = "record string, chunk long, last boolean, kind string, refers_to string, uri string, digest string, payload_bytes long, data string, data_bytes long, so_far string"
READ = "record string, chunk long, last boolean, kind string, refers_to string, n_bytes long, total_bytes long, so_far string, stated string"


def base32_sha1(text: Column) -> Column:
    """Upper-case base-32 SHA-1 of a text's UTF-8 bytes: each five hex digits make four digits."""
    digest = F.sha1(text)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)])
    return F.translate(digits, DIGITS, BASE32)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add digest, payload_bytes, kind and refers_to to page_id, url, html.

    Of equal payloads of at least `least_bytes`, the largest page_id is the response. Only payloads that
    come more than once are joined back; they are counted before the shuffle.
    """
    payload = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", payload.alias("html"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    again = (marked.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes")
             .agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").select("digest", "payload_bytes", "first"))
    few = again.count() <= BROADCAST_ROWS
    joined = marked.join(F.broadcast(again) if few else again, ["digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def _base32(digest: hashlib._Hash) -> str:
    return base64.b32encode(digest.digest()).decode()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of each record in turn; the digest of all bytes so far goes with every chunk."""
    schema = pa.schema([("record", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("kind", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()),
                        ("digest", pa.string()), ("payload_bytes", pa.int64()), ("data", pa.string()), ("data_bytes", pa.int64()), ("so_far", pa.string())])
    for batch in batches:
        rows, held = [], 0
        for k in range(batch.num_rows):
            record, uri, html, digest, n_bytes, kind, refers = (batch.column(c)[k].as_py() for c in ("page_id", "url", "html", "digest", "payload_bytes", "kind", "refers_to"))
            whole = "" if kind == "revisit" else html
            running, cuts = hashlib.sha1(), range(0, max(len(whole), 1), CHUNK)
            for chunk, at in enumerate(cuts):
                data = whole[at:at + CHUNK]
                raw = data.encode()
                running.update(raw)
                rows.append({"record": "null" if record is None else str(record), "chunk": chunk, "last": at + CHUNK >= len(whole), "kind": kind, "refers_to": None if refers is None else str(refers),
                             "uri": uri, "digest": digest, "payload_bytes": n_bytes, "data": data, "data_bytes": len(raw), "so_far": _base32(running)})
                held += len(raw)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def record_text(chunks: DataFrame) -> DataFrame:
    """One text per chunk: its record's headers, then its bytes. The first chunk of a response begins with HTTP headers."""
    http = F.when((F.col("kind") == "response") & (F.col("chunk") == 0),
                  F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))).otherwise("")
    origin = F.concat(F.lit("<urn:page:"), F.col("record"), F.lit(">"))
    parts = ~(F.col("last") & (F.col("chunk") == 0))
    line = lambda name, value, when=F.lit(True): F.when(when, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    first = F.col("chunk") == 0
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.when(first, F.col("kind")).otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, origin).otherwise(F.concat(F.lit("<urn:page:"), F.col("record"), F.lit(":"), F.col("chunk"), F.lit(">")))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("uri", F.lit("")), r"\s", "%20")), F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("Payload-Length", F.col("payload_bytes").cast("string")),
        line("Digest-So-Far", F.concat(F.lit("sha1:"), F.col("so_far")), parts),
        line("WARC-Profile", F.lit(PROFILE), F.col("kind") == "revisit"),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce("refers_to", F.lit("null")), F.lit(">")), F.col("kind") == "revisit"),
        line("WARC-Segment-Number", (F.col("chunk") + 1).cast("string"), parts), line("WARC-Segment-Origin-ID", origin, ~first),
        line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"), F.col("last") & ~first),
        F.when(first & (F.col("kind") == "response"), F.lit("Content-Type: application/http; msgtype=response\r\n")).otherwise(""),
        line("Content-Length", (F.octet_length(http) + F.col("data_bytes")).cast("string")), F.lit("\r\n"))
    return chunks.select(F.concat(head, http, F.col("data")).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per page (page_id, url, html) as gzipped archive files, one per task.

    Null html is an empty payload; null urls are empty; a null page_id is written as "null". Rows that repeat are records of
    their own; if they have the largest page_id of their payload, each is a response. An empty table writes no record.
    Other columns are not read. A task holds one batch of pages and the chunks of one batch at a time.
    """
    given = pages.select("page_id", "url", "html")
    chunks = mark_revisits(given, least_bytes).mapInArrow(_chunks, CHUNKS)
    record_text(chunks).write.option("lineSep", END).option("compression", "gzip").text(path)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows from the lines of archives. Lengths rule: a line inside a block is never taken for a header."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    path, state, left, head = None, "between", 0, {}
    running, total, got, in_http = hashlib.sha1(), 0, 0, False

    def close() -> tuple:
        number = int(head.get("warc-segment-number", 1))
        last = number > 1 and "warc-segment-total-length" in head or number == 1 and "warc-segment-number" not in head
        origin = head.get("warc-segment-origin-id", head.get("warc-record-id"))[10:-1]
        kind = head["warc-type"]
        revisit = kind == "revisit"
        refers = head["warc-refers-to"][10:-1] if revisit else None
        stated = head["warc-payload-digest"].removeprefix("sha1:")
        return (origin, number - 1, last, kind if kind != "continuation" else "response", refers, got, int(head["payload-length"]) if revisit else total,
                stated if revisit else _base32(running), stated)

    for batch in batches:
        out = []
        for line, file in zip(batch.column("value"), batch.column("file").to_pylist(), strict=True):
            if file != path:
                path, state = file, "between"
            rest = line.as_py().encode()
            if state == "block":
                piece = rest + b"\n"
                take, rest = piece[:left], piece[left:]
                left -= len(take)
                if in_http:
                    in_http = take != b"\r\n"
                else:
                    running.update(take)
                    total += len(take)
                    got += len(take)
                if left == 0:
                    out.append(close())
                    state = "between"
                continue
            text = rest.rstrip(b"\r").decode()
            if state == "between":
                if text == VERSION:
                    state, head = "head", {}
            elif text:
                name, _, value = text.partition(": ")
                head[name.lower()] = value
            else:
                left, got = int(head["content-length"]), 0
                in_http = "content-type" in head
                if head["warc-type"] != "continuation":
                    running, total = hashlib.sha1(), 0
                state = "block" if left else "between"
                if not left:
                    out.append(close())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk table of archives: record, chunk, last, kind, refers_to, n_bytes, total_bytes and digest so far, stated digest.

    A file is read by one task, line by line; only a running digest outlives a line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(_records, READ)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from its last chunk: record, kind, refers_to, payload_bytes, payload_digest, intact."""
    last = read_chunks(spark, path).where("last")
    return last.select("record", "kind", "refers_to", F.col("total_bytes").alias("payload_bytes"), F.col("so_far").alias("payload_digest"), (F.col("so_far") == F.col("stated")).alias("intact"))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
