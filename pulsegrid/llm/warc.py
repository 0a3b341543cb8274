"""WARC archives: writing, reading, and turning repeated payloads into revisit records.

Archives are written by Spark's text sink: one value per record (header block, blank line, payload), with the
blank lines that end a record as the line separator. So Spark's commit protocol covers them, a lost executor
leaves no half file, and compression is Spark's. They are read as binary files and cut by Content-Length.

Revisits: headers (never payloads) are combined by payload digest before they are shuffled; of equal payloads of
at least ``MIN_BYTES`` the one with the largest id is the response, and the others become revisit records that
name it. Payloads move once, by record id, to the tasks that write them, so a payload that a third of all pages
share is spread evenly.

* null payload: empty, a response; null url: an empty target; payloads below ``MIN_BYTES``: responses;
* repeated ids with equal payloads of at least ``MIN_BYTES``: the rule goes by id, so every row of the largest id is a
  response with its payload, and all rows of the other ids revisit it; with different payloads each is judged on its own;
* null ids: never the largest. They revisit an equal payload's largest id; where all its ids are null, they are
  responses. Their record ids are made of url and payload and read back as null;
* an empty table gives an archive without records and no rows; extra columns are left out;
* one file holds at most ``FILE_RECORDS`` records; a record is in one task's memory, as is a file when read.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 1000
FILE_RECORDS = 5000
DATE = "2024-01-01T00:00:00Z"  # of records without a date of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

RECORD = ("record_id string, record_type string, target_uri string, refers_to_id string, payload_digest string, "
          "payload_length long, block_bytes long, digest_ok boolean")


def record_id(page_id: Column) -> Column:
    """``null-`` and a hash of url and payload for a null id, which :func:`page_of` reads back as null."""
    nameless = F.concat(F.lit("null-"), F.sha1(F.concat_ws(" ", F.coalesce(F.col("digest"), F.lit("")), F.col("url")).cast("binary")))
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), nameless), F.lit(">"))


def page_of(record: Column) -> Column:
    return F.regexp_extract(record, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")


def resolved(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``id, url, payload`` rows with ``digest, bytes, kind, original`` by the revisit rule."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    full = records.select("id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"),
                          F.octet_length(payload).cast("long").alias("bytes"))
    headers = full.where(F.col("bytes") >= min_bytes).select("id", "digest")
    originals = headers.groupBy("digest").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 AND original IS NOT NULL")
    revisits = (headers.join(originals, "digest").where("id IS NULL OR id <> original")
                .select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "original").distinct())
    return (full.join(revisits, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id", "_digest")
            .withColumn("kind", F.when(F.col("original").isNull(), "response").otherwise("revisit")))


def record_text(resolved_rows: DataFrame) -> Column:
    """A record without the blank lines that end it."""
    kept = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(""))
    length = F.octet_length(kept)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    revisit = F.when(F.col("kind") == "revisit", F.concat(
        line("WARC-Refers-To", record_id(F.col("original"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", "")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", record_id(F.col("id"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri), revisit,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", length.cast("string")),
        F.lit("\r\n"), kept)


def write(records: DataFrame, path: str, *, min_bytes: int = MIN_BYTES, compression: str = "gzip") -> None:
    """``id, url, payload`` rows as archives without repeated payloads, every record with a fresh header."""
    rows = resolved(records, min_bytes)
    (rows.select(record_text(rows).alias("value")).write
     .option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse(content: bytes):
    """``(header fields, payload)`` of each record of one archive, plain or gzipped."""
    data = memoryview(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
    raw, at = data.obj, 0
    while at < len(data):
        head = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:head].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = head + 4
        end = begin + int(fields["content-length"])
        yield fields, data[begin:end]
        if raw[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end as it should")
        at = end + 4


def _read(batches):
    for batch in batches:
        out = [[] for _ in range(8)]
        for content in batch.column("content"):
            for fields, payload in parse(content.as_py()):
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                for column, value in zip(out, (
                        fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"),
                        fields.get("warc-refers-to"), digest, int(fields.get("x-payload-length", len(payload))),
                        len(payload), revisit or hashlib.sha1(payload).hexdigest() == digest), strict=True):
                    column.append(value)
        kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                         [x.split()[0] for x in RECORD.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of every record; ``digest_ok`` compares a response's payload with its digest."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, RECORD)


def originals(records: DataFrame) -> DataFrame:
    """Records with the payload size of their response, found by joining revisits to what they refer to."""
    answers = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("payload_digest").alias("digest"),
        F.col("block_bytes").alias("original_bytes")).distinct()
    pairs = records.where("record_type = 'revisit'").join(
        answers, (records["refers_to_id"] == answers["refers_to_id"]) & (records["payload_digest"] == answers["digest"]), "left")
    return (records.where("record_type = 'response'").withColumn("payload_bytes", F.col("block_bytes"))
            .unionByName(pairs.select(*[records[c] for c in records.columns], F.col("original_bytes").alias("payload_bytes"))))


def deduplicate(pages: DataFrame, path: str, *, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes ``page_id, url, html`` as archives below ``path`` and returns what they say when read back."""
    write(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")), path, min_bytes=min_bytes)
    back = originals(read(pages.sparkSession, path))
    return back.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of(F.col("refers_to_id")).alias("refers_to"), "digest_ok")
