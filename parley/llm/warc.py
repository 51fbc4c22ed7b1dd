"""Content-addressed web archive.

Payload bytes are stored once per SHA-256, in a table bucketed by it; the exact header block of every record is kept
in a table of its own. Records are rebuilt by a join of the two and every stored payload is verified when it is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, join_groups, small_batches, written

CRLF = "\r\n"
#: Digits of base 32 as conv() writes them and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


@dataclass
class Archive:
    headers: DataFrame  # page_id, head (WARC and HTTP header blocks), sha256
    payloads: DataFrame  # sha256, payload; one row per distinct payload


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2026-01-01T00:00:00Z", least_revisit: int = 0, buckets: int | None = None) -> Archive:
    """Archives every row of pages; the payload is the html in UTF-8, null being empty.

    Of records with equal payloads of at least least_revisit bytes the one with the smallest key is a response (one of
    them, if rows repeat; null keys last) and the others revisit it. A null url gives no target header. An empty table
    gives an empty archive. Other columns are not read.
    """
    slim = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    marked = slim.withColumn("sha256", F.sha2("payload", 256))
    lines = marked.select("page_id", "url", "sha256", F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("second"), base32_sha1(F.col("payload")).alias("sha1"))
    lines = written(lines.withColumn("line", F.monotonically_increasing_id()), "warc-lines")  # the numbers stand from here on
    best = F.min(F.struct(F.isnull("page_id").alias("none"), "page_id", "url", "line")).alias("best")
    found = lines.groupBy("sha256").agg(best, F.count(F.lit(1)).alias("copies"), F.min("second").alias("low"), F.max("second").alias("high"))
    # Texts of one SHA-256 must agree in a second hash too.
    sure = F.when(F.col("low") == F.col("high"), F.col("best")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("best")
    found = written(found.select("sha256", sure, "copies"), "warc-found")
    joined = join_groups(lines, found, "sha256", "copies", lines.count()).withColumn("first", F.col("best.page_id"))
    response = (F.col("size") < least_revisit) | (F.col("line") == F.col("best.line"))
    joined = joined.withColumn("kind", F.when(response, "response").otherwise("revisit"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    block = F.octet_length(http) + F.when(response, F.col("size")).otherwise(0)
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
        F.concat(F.lit(CRLF), http),
    )
    headers = written(joined.select("page_id", head.alias("head"), "sha256"), "warc-headers")
    store = marked.select("sha256", "payload").dropDuplicates(["sha256"])
    return Archive(headers, bucketed(store, "sha256", "warc", buckets))


def verified(archive: Archive) -> DataFrame:
    """The stored payloads, each checked against its key; a corrupt one ends the job."""
    sure = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), F.col("sha256"))))
    return archive.payloads.select("sha256", sure.alias("payload"))


def field(name: str) -> Column:
    """A header field of the WARC block of column head; null if absent."""
    value = F.regexp_extract(F.substring_index("head", CRLF + CRLF, 1), rf"(?:^|\r\n){re.escape(name)}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def records(archive: Archive) -> DataFrame:
    """page_id, head, payload (of responses; null for revisits), rebuilt by a join on the digest.

    Only responses meet the stored payloads, so a payload that many pages share is moved once.
    """
    kinds = archive.headers.withColumn("kind", field("WARC-Type"))
    full = kinds.where("kind = 'response'").join(verified(archive), "sha256", "left")
    bare = kinds.where("kind <> 'response'").withColumn("payload", F.lit(None).cast("binary"))
    return full.unionByName(bare).select("page_id", "kind", "sha256", "head", "payload")


def warc_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archive.

    One row for each row of pages. Nulls, ties, repeated rows and an empty table fare as in write_archive(); a payload may
    be of any length that a row can hold and have any number of copies. Other columns, whatever their names, are not read.
    """
    rebuilt = records(write_archive(pages))
    key = F.regexp_extract(field("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1)
    refers = F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    # The digest and length of a response come from its payload; a revisit's from the response that it refers to.
    read = rebuilt.select(
        key.try_cast("long").alias("page_id"),
        F.col("kind").alias("record_type"),
        refers.try_cast("long").alias("refers_to"),
        "sha256",
        F.octet_length("payload").cast("long").alias("size"),
        base32_sha1(F.col("payload")).alias("digest"),
    )
    read = written(read, "warc-read")
    full = read.groupBy("sha256").agg(F.max("size").alias("payload_bytes"), F.max("digest").alias("payload_digest"), F.count(F.lit(1)).alias("copies"))
    return join_groups(read, written(full, "warc-full"), "sha256", "copies", read.count()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---- WARC files -----------------------------------------------------------------------------------------------------


def export_warc(archive: Archive, path: str, rows_each: int = 5_000) -> None:
    """Writes the records as gzipped WARC files (payloads are UTF-8) of at most rows_each records."""
    text = F.concat("head", F.coalesce(F.decode("payload", "UTF-8"), F.lit("")), F.lit(CRLF + "\r"))  # the line's own end is the last byte
    records(archive).select(text.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", rows_each).text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """kind, record_id, target_uri, digest, refers_to, payload of every record in the WARC files under path."""
    import gzip

    small_batches(spark)
    names = {"kind": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                data, at, out = content.as_py(), 0, []
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    fields = dict(line.split(": ", 1) for line in data[at:end].decode().split(CRLF)[1:])
                    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
                    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                    out.append({k: fields.get(v) for k, v in names.items()} | {"payload": payload})
                    at = end + 8 + len(block)
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*((k, pa.string()) for k in names), ("payload", pa.binary())]))

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, ", ".join(f"{k} string" for k in names) + ", payload binary")
