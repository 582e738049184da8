"""Content-addressed web archive.

Payload bytes are stored once under their SHA-256; the exact header bytes of every record are stored apart, and a
record is put together again by a join on the digest.  A stored payload is verified twice: all payloads of a digest
must agree in length and in a second, unrelated hash when stored, and the digest is computed anew when read.

Defined cases: a null payload is empty; payloads under ``smallest`` bytes are never revisited; the response of a group
of equal payloads is the one with the smallest id (null ids last), among equal ids that with the smallest address, and
of wholly equal rows exactly one; a null address leaves its header line out; line breaks in addresses are written as
%0D and %0A.  Other columns are not archived.  The id column is an integer.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from lakegauge.sources.work import written

SMALLEST = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    headers: DataFrame   # one row per record: its exact header bytes and the digest of its payload
    payloads: DataFrame  # one row per digest: the payload bytes


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                  smallest: int = SMALLEST, date: str = "1970-01-01T00:00:00Z") -> Archive:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    seen = written(pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.regexp_replace(F.col(uri_col), "\r", "%0D"), "\n", "%0A").alias("uri"),
        F.sha2(payload, 256).alias("digest"), F.length(payload).cast("bigint").alias("bytes"),
        F.monotonically_increasing_id().alias("row")), "captures")

    # the first of each group of equal payloads; map-side combined, so a payload that fills a third of the rows is no load
    firsts = (seen.filter(F.col("bytes") >= smallest).groupBy("digest")
              .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uri", "row")).alias("first"), F.count("*").alias("n"))
              .filter("n > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")))
    typed = seen.join(firsts, "digest", "left").withColumn(
        "revisit", F.col("first_row").isNotNull() & (F.col("row") != F.col("first_row")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    block = F.length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", name("id")), F.coalesce(_line("WARC-Target-URI", F.col("uri")), F.lit("")),
        _line("WARC-Date", F.lit(date)), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("revisit"), F.concat(_line("WARC-Refers-To", name("first_id")), _line("WARC-Profile", F.lit(REVISIT_PROFILE))))
        .otherwise(""), _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit("\r\n"), http)
    headers = written(typed.select(header.cast("binary").alias("header"), "digest"), "headers")

    second = F.xxhash64("payload")
    stored = (pages.select(payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).groupBy("digest")
              .agg(F.first("payload").alias("payload"), F.min(second).alias("low"), F.max(second).alias("high"),
                   F.min(F.length("payload")).alias("short"), F.max(F.length("payload")).alias("long")))
    agreed = F.when((F.col("low") == F.col("high")) & (F.col("short") == F.col("long")), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads under one digest: "), F.col("digest"))).cast("binary"))
    return Archive(headers, written(stored.select("digest", agreed.alias("payload")), "payloads"))


def read_archive(archive: Archive) -> DataFrame:
    """One row per record, parsed from its header bytes, with its payload and the verified facts about it."""
    text = F.col("header").cast("string")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    page = lambda name: F.expr(f"try_cast({name} as bigint)")
    records = archive.headers.select(
        "header", field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("uri"),
        F.regexp_extract(field("WARC-Record-ID"), "page:([^>]*)>", 1).alias("id"),
        F.regexp_extract(field("WARC-Refers-To"), "page:([^>]*)>", 1).alias("ref"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha256:(.*)", 1).alias("digest"))
    # facts are taken on the side where each payload stands once
    found = F.sha2("payload", 256)
    payloads = archive.payloads.select(
        "digest", "payload", F.length("payload").cast("bigint").alias("payload_bytes"),
        F.when(found == F.col("digest"), found).otherwise(
            F.raise_error(F.concat(F.lit("payload does not fit its digest: "), F.col("digest"))).cast("string")).alias("payload_digest"))
    return records.join(payloads, "digest").select(
        page("id").alias("page_id"), "uri", "payload_bytes", "payload_digest", "record_type", page("ref").alias("refers_to"),
        "header", "payload")


def warc_records(archive: Archive, originals: bool = False) -> DataFrame:
    """``page_id`` and the bytes of each WARC record; their concatenation is a WARC file.  With ``originals`` a
    revisit carries its payload again, as it was fetched."""
    body = F.col("payload") if originals else F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return read_archive(archive).select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def op1_warc(spark, sf_dir) -> DataFrame:
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


ORACLE = f"""
with p as (select page_id, url as uri, coalesce(html, '') as h, sha256(coalesce(html, '')) as payload_digest from pages),
r as (select *, strlen(h)::bigint as payload_bytes, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {SMALLEST} and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {SMALLEST} and page_id <> first then first end as refers_to, uri from r
"""
