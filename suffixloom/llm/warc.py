"""A content-addressed WARC archive.

``payloads`` holds each distinct payload once under its digest; ``records`` holds each record's exact
header bytes and its payload's digest.  A join gives every original record back, byte for byte.
Payloads are told apart by SHA-256 and addressed by SHA-1 (the digest that WARC headers carry); when
records are read, length and both digests are computed anew from the stored bytes and must agree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, shared_dir, slices

VERSION = "WARC/1.0"
#: Date that records get where the pages have none.
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 0
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digits: Column, n: int = 40) -> Column:
    """RFC 4648 base32 of ``n`` hex digits (a multiple of 5): five digits make four letters."""
    parts = [F.lpad(F.conv(F.substring(hex_digits, i + 1, 5), 16, 32), 4, "0") for i in range(0, n, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _B32)


def header(kind: Column, row: Column, url: Column, date: Column, digest: Column, length: Column, refers_to: Column) -> Column:
    """A record's header lines, with the blank line that ends them.  CR and LF in a URL become blanks."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.translate(F.coalesce(url, F.lit("")), "\r\n", "  ")
    ident = lambda r: F.concat(F.lit("<urn:page:"), F.coalesce(r.cast("string"), F.lit("null")), F.lit(">"))
    return F.concat(
        F.lit(VERSION + "\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", ident(row)), line("WARC-Target-URI", uri), line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), F.when(refers_to.isNotNull(), line("WARC-Refers-To", ident(refers_to))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", length.cast("string")), F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, row: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write ``path/payloads`` (each once, with the number of its records and the largest key among them) and ``path/records``.

    Of records whose equal payloads have ``least_bytes`` or more, that with the largest ``row`` is the
    response and the others revisit it; if rows with that key are repeated, each of them is a response
    (the payload is still stored once).  A null key is less than any other; where all keys of a payload
    are null, all are responses.  Shorter payloads are always responses.  Null bodies are empty payloads.
    """
    data = pages.select(named(row).alias("row"), named(url).cast("string").alias("url"), F.encode(F.coalesce(named(body).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    data = data.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    first = data.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("row").alias("last_row"), F.count("*").alias("n_records"))
    first.select("sha256", base32(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("length"), "payload", "last_row", "n_records").write.parquet(f"{path}/payloads")
    light = data.select("row", "url", "sha256", F.octet_length("payload").cast("bigint").alias("length"), base32(F.sha1("payload")).alias("digest"))
    shared = pages.sparkSession.read.parquet(f"{path}/payloads").filter("n_records > 1").select("sha256", F.col("last_row").alias("last"))  # a plain table, so a hot payload's join can be split
    joined = light.join(shared, "sha256", "left")
    target = F.when((F.col("length") >= least_bytes) & F.col("last").isNotNull() & ~F.col("row").eqNullSafe(F.col("last")), F.col("last"))
    kind = F.when(target.isNull(), "response").otherwise("revisit")
    head = header(kind, F.col("row"), F.col("url"), F.lit(date), F.col("digest"), F.col("length"), target)
    joined.select("row", head.alias("header"), "sha256").write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``row, header, sha256, digest, payload``: each record with the payload that its digest addresses.

    The join is outer: a record whose payload is missing comes back with a null payload, which ``parse`` refuses.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "digest", "payload")
    return spark.read.parquet(f"{path}/records").join(payloads, "sha256", "left").select("row", "header", "sha256", "digest", "payload")


def record_bytes(record_header: bytes, payload: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    return record_header + payload + b"\r\n\r\n"


def read_fields(record_header: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case."""
    lines = record_header.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of each record of a WARC file's bytes, by their stated lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        stop = end + int(read_fields(data[at:end])["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end at its stated length")
        yield data[at:end], data[end:stop]
        at = stop + 4


def parse(records: DataFrame) -> DataFrame:
    """``row, url, record_type, payload_bytes, payload_digest, refers_to`` read from reconstructed records.

    Each record is put together as in a WARC file and read by its header; a payload whose length, SHA-1 or
    SHA-256 is not what header and archive state stops the run.
    """
    kind = records.schema["row"].dataType.simpleString()

    def page(ident: str | None) -> str | None:
        value = ident.removeprefix("<urn:page:").removesuffix(">") if ident else None
        return None if value == "null" else value

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "payload"):
            out = []
            for _, head, sha256, _, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if payload is None:
                    raise ValueError(f"no payload for {head!r}")
                for h, body in split_records(record_bytes(head, payload)):
                    f = read_fields(h)
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    if f["warc-payload-digest"] != f"sha1:{digest}" or hashlib.sha256(body).digest() != sha256:
                        raise ValueError(f"payload does not match its digests: {h!r}")
                    out.append((page(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], len(body), digest, page(f.get("warc-refers-to"))))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    names = ["row", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    out = records.mapInArrow(each, "row string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string")
    return out.select(*[F.col(c).cast(kind).alias(c) if c in ("row", "refers_to") else c for c in names])


def export_warc(spark: SparkSession, path: str, to: str, files: int) -> None:
    """Write the archive's records to ``files`` gzipped WARC files in folder ``to``, payloads in full.

    The text writer ends each row with CRLF CRLF, which is what ends a WARC record.
    """
    text = F.concat(F.col("header").cast("string"), F.col("payload").cast("string"))
    read_archive(spark, path).select(text.alias("value")).repartition(files).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(to)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to an archive in the shared folder, then read every record back."""
    path = shared_dir(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return parse(read_archive(spark, path)).select(F.col("row").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_BIT = "(('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31"
OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, string_agg(substr('{_B32}', CAST(({_BIT}) + 1 AS BIGINT), 1), '' ORDER BY i) AS digest
  FROM (SELECT DISTINCT h FROM p), range(32) r(i) GROUP BY h),
g AS (SELECT t, max(page_id) AS last FROM p GROUP BY t)
SELECT page_id, CAST(octet_length(encode(p.t)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM p JOIN d USING (h) JOIN g ON p.t = g.t
"""
