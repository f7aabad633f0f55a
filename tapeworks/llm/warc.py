"""WARC archives with revisit records (operator 9).

Writing: only record headers (id, payload digest) are shuffled to find, for
each payload, the record that keeps it; every other record with that payload
becomes a revisit with fresh headers and no body. Archives are written by
Spark's text writer, one record per row with the record end as separator, so
the files are plain WARC/1.1 and Spark's commit protocol covers lost tasks.
Reading: archive files are parsed by their Content-Length fields, and revisit
records are joined to the originals by payload digest.

Defined results: a null payload counts as empty; payloads under ``min_bytes``
are never revisits; of equal payloads the largest id is the response, a null
id being smaller than any other (rows that repeat that largest id are all
responses); a null id is written without its field and read back as null; null
addresses are written as ``urn:none``. An empty table gives an empty archive.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored

RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, record_type string, url string, refers_id long, payload_digest string, stated_bytes long, payload binary"


def _record_uri(id_col: Column) -> Column:
    h = F.md5(F.concat(F.lit("record-"), id_col.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolve(pages: DataFrame, id_col: str, payload_col: str, url_col: str, min_bytes: int) -> DataFrame:
    """Each page with its digest, record_type and refers_to.

    The digest groups are combined within tasks before their shuffle and kept
    in a written table, so that the join's two sides are plain exchanges whose
    hot digests adaptive execution splits. Small payloads get keys of their
    own: they match nothing and gather nowhere.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    big = F.col("payload_bytes") >= min_bytes
    groups = stored(
        rows.filter(big).groupBy("payload_digest").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(F.col("payload_digest").alias("key"), "keep_id"),
        "warc-groups",
    )
    own = F.concat(F.lit("own-"), F.xxhash64("page_id", "url").cast("string"))
    joined = rows.withColumn("key", F.when(big, F.col("payload_digest")).otherwise(own)).join(groups, "key", "left")
    revisit = F.col("keep_id").isNotNull() & ~F.col("keep_id").eqNullSafe(F.col("page_id"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_id", F.when(revisit, F.col("keep_id"))).drop("key", "keep_id")


def record_text(date: str) -> Column:
    """One WARC record, without its end mark, of a resolved row."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    url = F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("urn:none"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.coalesce(_record_uri(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        optional("X-Page-Id", F.col("page_id").cast("string")),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To", _record_uri(F.col("refers_id")))).otherwise(F.lit("")),
        F.when(revisit, line("X-Refers-To-Page-Id", F.col("refers_id").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
        http,
        body,
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2000) -> str:
    """Write one record per row; files hold ``records_per_file`` records at most."""
    records = resolve(pages, id_col, payload_col, url_col, min_bytes).select(record_text(date).alias("value"))
    records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).text(path)
    return path


def parse_archive(content: bytes) -> Iterator[tuple]:
    """The records of one archive file, found by their Content-Length."""
    view, at = memoryview(content), 0
    while (end := content.find(b"\r\n\r\n", at)) >= 0:
        head = content[at:end].decode("utf-8")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        size = int(fields["Content-Length"])
        block = view[end + 4 : end + 4 + size]
        split = content.index(b"\r\n\r\n", end + 4) + 4 - (end + 4)
        stated = int(re.search(rb"Content-Length: (\d+)", bytes(block[:split]))[1])
        kind, number = fields["WARC-Type"], lambda name: int(fields[name]) if name in fields else None
        yield number("X-Page-Id"), kind, fields["WARC-Target-URI"], number("X-Refers-To-Page-Id"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), stated, bytes(block[split:]) if kind == "response" else None
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """The records of all archive files below ``path``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in parse_archive(content.as_buffer().to_pybytes()):
                    rows.append(record)
                    held += len(record[-1] or b"")
                    if held >= batch_bytes:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, RECORD_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record with its payload's digest and size, revisits from their originals.

    Responses state what their own bytes give; revisit headers are joined by
    digest to the response they name.
    """
    heads = stored(
        records.select(
            "page_id", "record_type", "url", "refers_id",
            F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        ),
        "warc-heads",
    )
    responses, revisits = heads.filter("record_type = 'response'"), heads.filter("record_type = 'revisit'")
    originals = stored(
        responses.groupBy(F.col("payload_digest").alias("key"), F.col("page_id").alias("original")).agg(F.max("payload_bytes").alias("original_bytes")),
        "warc-originals",
    )
    found = revisits.join(originals, (F.col("payload_digest") == F.col("key")) & (F.col("refers_id") == F.col("original")), "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "url").unionByName(
        found.select("page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to"), "url")
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives into the shared folder and read them back."""
    spark = pages.sparkSession
    return resolve_revisits(read_archives(spark, write_archives(pages, scratch_path(spark, "warc"))))


ORACLE = """
with p as (
  select page_id, coalesce(url, 'urn:none') as url, coalesce(html, '') as payload from pages
), d as (
  select page_id, url, octet_length(encode(payload)) as payload_bytes, sha1(payload) as payload_digest from p
), g as (
  select *, max(page_id) over (partition by payload_digest) as keep_id from d
)
select page_id, payload_bytes, payload_digest, url,
  case when payload_bytes >= 1000 and page_id <> keep_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> keep_id then keep_id end as refers_to
from g
"""
