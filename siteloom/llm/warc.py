"""Operator 7, WARC archives with revisit resolution.

Headers (page id, payload digest) are shuffled by digest to find the original of every payload
and the copies of it. The decisions go back to the pages by page id, which no page shares with
many others, so a payload that a third of all pages have gathers its headers only, never its
bytes. The archives are written with fresh headers: one response for a payload, revisit records
without payload for its copies. Reading them back joins revisits to the responses by digest.

Archives are plain WARC/1.1 files, gzip-compressed, written and read by Spark's text source:
records are separated by CRLF CRLF when written, and split before each version line when read,
so neither side holds more than a record. A payload that holds a version line itself is
written with chunked transfer encoding whose chunks end inside that line. Records are parsed
by Content-Length, so pieces that hold several records are read right as well.

Defined results: null html is an empty payload. Payloads under MIN_REVISIT bytes are always
responses. Every row that has the least page_id of its payload is a response (repeated rows
give repeated records); null ids sort last. CR and LF in a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import cut, remove, shared_dir, small_batches, table

#: Equal payloads of at least so many bytes are stored once.
MIN_REVISIT = 100
VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    """Adds payload (string), payload_digest and payload_bytes."""
    payload = F.coalesce("html", F.lit(""))
    return pages.withColumns({"payload_digest": F.sha2(payload, 256), "payload_bytes": F.octet_length(payload).cast("long"), "payload": payload})


def deduplicate(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to."""
    full = headers(pages.select("page_id", "url", "html")).select("page_id", "url", "payload", "payload_digest", "payload_bytes")
    head = full.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest")
    # Written first, so that Spark can split the join at a digest that many headers have.
    originals = cut(head.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("original")).where("n > 1 AND original IS NOT NULL").select("payload_digest", "original"))
    copy = F.col("page_id").isNull() | (F.col("page_id") > F.col("original"))
    copies = head.join(originals, "payload_digest").where(copy).distinct().select(F.col("page_id").alias("id_"), F.col("payload_digest").alias("digest_"), "original")
    joined = full.join(copies.hint("shuffle_hash"), full["page_id"].eqNullSafe(F.col("id_")) & (F.col("payload_digest") == F.col("digest_")), "left")
    copy = F.col("digest_").isNotNull()
    return joined.select(
        "page_id",
        "url",
        F.when(~copy, F.col("payload")).alias("payload"),
        "payload_digest",
        "payload_bytes",
        F.when(copy, "revisit").otherwise("response").alias("record_type"),
        F.when(copy, F.col("original")).alias("refers_to"),
    )


def _chunked(payload: Column) -> Column:
    """Transfer encoding that breaks every version line inside the payload."""
    parts = F.split(payload, r"WARC/1\.1\r\n")
    last = F.size(parts) - 1

    def chunk(part: Column, i: Column) -> Column:
        body = F.concat(F.when(i > 0, "/1.1\r\n").otherwise(""), part, F.when(i < last, "WARC").otherwise(""))
        size = F.octet_length(body)
        return F.when(size == 0, "").otherwise(F.concat(F.hex(size.cast("long")), F.lit("\r\n"), body, F.lit("\r\n")))

    return F.concat(F.array_join(F.transform(parts, chunk), ""), F.lit("0\r\n\r\n"))


def record(date: str) -> Column:
    """The text of a record, without the separator after it."""
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">\r\n"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    plain = F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    block = (
        F.when(revisit, F.concat(http, plain))
        .when(F.col("payload").contains(VERSION), F.concat(http, F.lit("Transfer-Encoding: chunked\r\n\r\n"), _chunked(F.col("payload"))))
        .otherwise(F.concat(http, plain, F.col("payload")))
    )
    return F.concat(
        F.lit(VERSION + "WARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), ident("page_id"),
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), ident("refers_to"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """Write what deduplicate() returns as WARC files below path."""
    lines = records.select(record(date).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    lines.option("maxRecordsPerFile", records_per_file).mode("overwrite").text(path)


def _dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def parse_records(piece: bytes) -> Iterator[dict]:
    """The records of a piece of an archive, each cut by its Content-Length."""
    version, at = VERSION.encode(), 0
    while at < len(piece):
        if piece.startswith(version, at):
            at += len(version)
        elif not piece[at:].strip(b"\r\n"):
            return
        end = piece.index(b"\r\n\r\n", at)
        fields = {k.lower(): v for k, _, v in (x.partition(b": ") for x in piece[at:end].split(b"\r\n"))}
        size = int(fields[b"content-length"])
        block = piece[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a record is shorter than its Content-Length")
        at = end + 4 + size
        if piece.startswith(b"\r\n\r\n", at):
            at += 4
        head, _, body = block.partition(b"\r\n\r\n")
        http = {k.lower(): v for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:])}
        revisit = fields[b"warc-type"] == b"revisit"
        if not revisit and http.get(b"transfer-encoding") == b"chunked":
            body = _dechunk(body)
        ident = lambda x: x.strip(b"<>").rpartition(b":")[2].decode() if x else None
        digest = fields[b"warc-payload-digest"].removeprefix(b"sha256:").decode()
        if not revisit and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError("a payload differs from its digest")
        yield {
            "page_id": ident(fields[b"warc-record-id"]),
            "url": fields[b"warc-target-uri"].decode("utf-8", "replace"),
            "record_type": fields[b"warc-type"].decode(),
            "refers_to": ident(fields.get(b"warc-refers-to")),
            "payload_digest": digest,
            "payload_bytes": None if revisit else len(body),
            "payload": None if revisit else body,
        }


_SCHEMA = {"page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}


def read_archives(spark: SparkSession, path: str, payload: bool = True, ids: str = "long") -> DataFrame:
    """The records of WARC files below path, checked against their digests; a revisit has
    neither payload nor payload_bytes. ids: the type of page ids; those that it can't hold are
    null."""
    small_batches(spark)
    names = [n for n in _SCHEMA if payload or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for piece in batch.column(0).to_pylist() if piece for r in parse_records(piece)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], _SCHEMA[n]) for n in names], names=names)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    schema = ", ".join(f"{n} {kinds[_SCHEMA[n]]}" for n in names)
    lines = spark.read.option("lineSep", "\r\n\r\n" + VERSION).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, schema).withColumns({c: F.nullif(c, F.lit("null")).try_cast(ids) for c in ("page_id", "refers_to")})


def resolve(records: DataFrame, *carried: str) -> DataFrame:
    """Revisits joined to the original response of the same digest: they get its page_id as
    refers_to and what is carried of it (payload_bytes, payload)."""
    originals = (
        records.where("record_type = 'response'")
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), *(F.min(c).alias(f"original_{c}") for c in carried))
    )
    joined = records.where("record_type = 'revisit'").join(originals, "payload_digest", "left")
    kept = [c for c in records.columns if c not in (*carried, "refers_to")]
    found = joined.select(*kept, *(F.col(f"original_{c}").alias(c) for c in carried), F.col("original").alias("refers_to"))
    return records.where("record_type = 'response'").select(*kept, *carried, "refers_to").unionByName(found)


def rewrite(spark: SparkSession, source: str, target: str) -> None:
    """Read archives, give revisits their payloads, and write them deduplicated afresh."""
    whole = resolve(read_archives(spark, source), "payload")
    write_archives(deduplicate(whole.select("page_id", "url", F.col("payload").cast("string").alias("html"))), target)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(deduplicate(table(spark, sf_dir, "pages")), path)
    read = cut(read_archives(spark, path, payload=False).drop("url"))
    remove(spark, path)
    return resolve(read, "payload_bytes").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> original THEN original END AS refers_to
FROM o
"""
