"""WARC archives written and read as tables of record chunks (operator 10).

A record is one row, or, if its payload is oversized, a row per chunk: the
first chunk is the record, the others are its `continuation` records, as the
WARC standard has it. Each row is a complete WARC record with a header of its
own, so archives are written and read in parallel, split anywhere between
records, and no task holds more of an oversized payload than a chunk.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sift
from .storage import new_path, staged

VERSION = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = "page_id long, url string, record_type string, refers_to long, refers_url string, payload_bytes long, payload_digest string, record_id string, chunk int, last boolean, body string"


def payloads(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, body and the body's size and SHA-1 in UTF-8; a null html is empty."""
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("body"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest"))


def with_types(records: DataFrame, least: int = 1000, salts: int = 64) -> DataFrame:
    """Add record_type, refers_to and refers_url.

    Of records with equal payloads of at least `least` bytes, the one with the
    largest page_id is the response and the others revisit it; rows that repeat
    that page_id are responses too. Smaller ones are all responses. Who is what
    is found from ids, sizes and digests alone; then only records that a sieve
    takes for repeated ones travel with their bodies, those of one payload to
    `salts` places.
    """
    key, salt = ["payload_digest", "payload_bytes"], F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")
    records = records.withColumn("_salt", salt)
    parts = records.where(F.col("payload_bytes") >= least).groupBy(*key, "_salt").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("_n"))
    groups = parts.groupBy(*key).agg(F.max("best").alias("winner"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    known = staged(parts.select(*key, "_salt").join(groups, key).withColumn("_key", sift.row_key(*key)), "payloads")
    marked = sift.sifted(records.withColumn("_key", sift.row_key(*key)), known.select("_key"), "_key").drop("_key")
    judged = marked.where("_may").join(known.drop("_key"), [*key, "_salt"], "left")
    kind = "struct<page_id: bigint, url: string>"
    typed = marked.where("NOT _may").withColumn("winner", F.lit(None).cast(kind)).unionByName(judged).drop("_may", "_salt")
    revisit = F.col("winner.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner.page_id"))
    told = {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("winner.page_id")), "refers_url": F.when(revisit, F.col("winner.url"))}
    return typed.withColumns(told).drop("winner")


def chunked(typed: DataFrame, chunk_chars: int = 1 << 16) -> DataFrame:
    """One row per record and chunk, with the digest and size of the payload so far.

    A body is cut every `chunk_chars` characters and inside each string that
    would look like the start of a record, so no chunk holds such a string.
    Bodies that need no cut, and revisits, which have none, stay in the JVM.
    """
    plain = (F.char_length("body") <= chunk_chars) & ~F.contains("body", F.lit(VERSION))
    typed = typed.withColumn("body", F.when(F.col("record_type") == "response", F.col("body")).otherwise(""))
    whole = typed.where(plain).select("page_id", "url", "record_type", "refers_to", "refers_url", "payload_bytes", "payload_digest", F.expr("uuid()").alias("record_id"), F.lit(0).alias("chunk"), F.lit(True).alias("last"), "body")

    cols = ["page_id", "url", "record_type", "refers_to", "refers_url", "body"]

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one body at a time becomes a Python object
                row = {c: batch[c][i].as_py() for c in cols}
                body, sha, size, name = row.pop("body"), hashlib.sha1(), 0, str(uuid.uuid4())
                at, number = 0, 0
                mark = body.find(VERSION)
                while at < len(body):
                    end = min(at + chunk_chars, len(body))
                    while 0 <= mark < at:
                        mark = body.find(VERSION, mark + 1)
                    if 0 <= mark < end:
                        end = min(end, mark + 4)
                    part = body[at:end]
                    raw = part.encode()
                    sha.update(raw)
                    size += len(raw)
                    rows = {**row, "payload_bytes": size, "payload_digest": sha.hexdigest(), "record_id": name, "chunk": number, "last": end == len(body), "body": part}
                    yield pa.RecordBatch.from_pylist([rows], schema=_SCHEMA)
                    at, number = end, number + 1

    return whole.unionByName(typed.where(~plain).select(*cols).mapInArrow(cut, CHUNKS))


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_id", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("body", pa.string()),
])


def _line(name: str, value: Column, when: Column | None = None) -> Column:
    line = F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))
    return F.coalesce(F.when(when, line) if when is not None else line, F.lit(""))


def record_text(chunks: DataFrame) -> DataFrame:
    """The text of each WARC record (`value`), without the empty lines after it.

    White space and control characters in a URL are written as %20; a record
    without a URL gets a urn. The size and digest of a chunk's header are those
    of the payload up to and including it.
    """
    first, response = F.col("chunk") == 0, F.col("record_type") == "response"
    block = F.concat(F.when(first & response, HTTP).otherwise(""), F.col("body"))
    several = ~F.col("last") | (F.col("chunk") > 0)
    own = F.when(first, F.col("record_id")).otherwise(F.concat("record_id", F.lit("-"), F.col("chunk").cast("string")))

    def target(url: str, page: str) -> Column:
        return F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("unknown"))))

    head = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), own, F.lit(">"))),
        _line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        _line("WARC-Target-URI", target("url", "page_id")),
        _line("WARC-Segment-Number", F.col("chunk") + 1, several),
        _line("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">")), ~first),
        _line("WARC-Segment-Total-Length", F.col("payload_bytes") + F.lit(len(HTTP)), several & F.col("last")),
        _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ~response),
        _line("WARC-Refers-To-Target-URI", target("refers_url", "refers_to"), ~response),
        _line("WARC-Refers-To-Date", F.lit("2024-01-01T00:00:00Z"), ~response),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("X-Payload-Length", F.col("payload_bytes")),
        _line("X-Page-ID", F.col("page_id")),
        _line("X-Refers-To-Page-ID", F.col("refers_to")),
        _line("Content-Type", F.when(first, "application/http;msgtype=response").otherwise("application/octet-stream")),
        _line("Content-Length", F.octet_length(block)),
    )
    return chunks.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None, chunk_chars: int = 1 << 16, least: int = 1000, per_file: int = 50_000, compression: str = "gzip") -> str:
    """Write a record per row of `page_id, url, html`; returns the folder of archives.

    A null html is an empty payload, a null page_id a page of no id, which
    nothing refers to; repeated rows are records of their own. Urls and
    payloads may be of any length; other columns aren't read. An empty table
    gives a folder without records.

    Archives are compressed, each file as one gzip stream, unless `compression`
    is none; compressed ones are read as streams, others may also be split
    between records.
    """
    path = path or new_path(pages.sparkSession, "warc")
    text = record_text(chunked(with_types(payloads(pages), least), chunk_chars))
    text.write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", per_file).text(path)
    return path


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of record and chunk number from archives, with the payload bytes of each chunk."""
    lines = spark.read.option("lineSep", "\r\n\r\n" + VERSION).text(path)
    at = F.instr("value", "\r\n\r\n")
    head = F.expr("substring(value, 1, instr(value, '\\r\\n\\r\\n') + 1)")
    rows = lines.where(at > 0).select(head.alias("head"), F.expr("substring(value, instr(value, '\\r\\n\\r\\n') + 4)").cast("binary").alias("rest"))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))

    kind = field("WARC-Type")
    block = F.expr("substring(rest, 1, size)")
    rows = rows.select(
        kind.alias("kind"),
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("number"),
        field("WARC-Segment-Number").isNotNull().alias("several"),
        field("WARC-Segment-Total-Length").isNotNull().alias("last"),
        field("X-Page-ID").cast("long").alias("page_id"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("X-Payload-Length").cast("long").alias("said_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("said_digest"),
        field("Content-Length").cast("int").alias("size"),
        "rest",
    )
    payload = F.when(F.col("kind") == "response", F.expr(f"substring(rest, {len(HTTP) + 1}, size - {len(HTTP)})")).when(F.col("kind") == "continuation", block)
    return rows.withColumn("payload", payload).drop("rest", "size")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record.

    A response's size and digest are computed from the bytes in the archive; a
    record in several chunks is put in order within a task and hashed chunk by
    chunk. What the header of its last chunk says must agree, else the read
    fails. A revisit has no payload and tells what it refers to.
    """
    chunks = read_chunks(spark, path)
    own = F.col("kind") == "response"
    single = chunks.where(~F.col("several")).select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("said_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("said_digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )

    def joined(batches):
        record, sha, size, page = None, None, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["record"] != record:
                    record, sha, size, page = row["record"], hashlib.sha1(), 0, row["page_id"]
                sha.update(row["payload"])
                size += len(row["payload"])
                if row["last"]:
                    if (size, sha.hexdigest()) != (row["said_bytes"], row["said_digest"]):
                        raise ValueError(f"record {record} is damaged")
                    yield pa.RecordBatch.from_pydict({"page_id": pa.array([page], pa.int64()), "payload_bytes": pa.array([size], pa.int64()), "payload_digest": pa.array([sha.hexdigest()])})

    parts = chunks.where("several").select("record", "number", "last", "page_id", "said_bytes", "said_digest", "payload").repartition("record").sortWithinPartitions("record", "number")
    several = parts.mapInArrow(joined, "page_id long, payload_bytes long, payload_digest string")
    return single.unionByName(several.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))
