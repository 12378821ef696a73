"""WARC archives without repeated payloads, and reading them back.

Only headers are shuffled by payload digest: the smallest page of a digest keeps its payload in a response record, the
others become revisit records that refer to it. Payloads of responses are shuffled once, by page id and digest, to meet
that decision. Each record is a gzip member of its own, so it can be read at its offset. Spark's text writer puts the
members into files, so any store that Spark reaches will do: a member's last byte, the highest of its length, is zero,
which serves as the writer's line end. Files are bounded in bytes: large payloads have a file each, others share one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import scratch, small_batches, table

#: Equal payloads of fewer bytes all stay responses. Payloads of BIG bytes or more have a file each, of the others a file
#: holds so many, half a gigabyte at most.
LEAST_BYTES, BIG, MOST_RECORDS = 100, 1 << 20, 500
#: Longer records go on in another gzip member, so that the highest byte of a member's length stays zero.
MEMBER = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def _keys(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.coalesce(F.col("page_id").cast("long"), F.lit(2**63 - 1)).alias("_k"))


def decide(pages: DataFrame) -> DataFrame:
    """(_k, payload_digest, first): of each page, by its id with null last, and payload of LEAST_BYTES or more that recurs, the page that keeps the payload."""
    heads = _keys(pages).where(F.col("payload_bytes") >= LEAST_BYTES).select("_k", "payload_digest")
    first = heads.groupBy("payload_digest").agg(F.min("_k").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return heads.join(first, "payload_digest").groupBy("_k", "payload_digest").agg(F.min("first").alias("first"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    parts = [F.lit("WARC/1.1\r\n")]
    for name, value in pairs:
        parts += [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")]
    return F.concat(*parts, F.lit("\r\n"))


def _record_id(page: Column, digest: Column, nth: Column) -> Column:
    """A record id in the form of a UUID, the same in every run."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest, nth.cast("string")))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def zipped(heads: pd.Series, bodies: pd.Series) -> pd.Series:
    """Records as gzip members, each without its last byte, a zero."""
    out = []
    for head, body in zip(heads, bodies):
        data, members = f"{head}{body}\r\n\r\n".encode(), []
        for i in range(0, len(data), MEMBER):
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            members.append(c.compress(data[i : i + MEMBER]) + c.flush())
        out.append(b"".join(members)[:-1])
    return pd.Series(out, dtype=object)


def write(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write a record for each row of pages(page_id, url, html) as gzipped WARC files into path.

    The payload is the html in UTF-8, empty if null, after an HTTP header of its own; date: by default now. Line breaks
    in a url are percent-encoded, a null url is left out. Ids that are null rank last. Of rows with one id and payload
    the first by url counts as the smallest page, the others revisit it. An empty table writes no record. Very long
    pages have a file each. Extra columns are ignored.
    """
    small_batches(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = _keys(pages.select("page_id", "url", "html"))
    rows = rows.join(decide(pages), ["_k", "payload_digest"], "left")
    same = Window.partitionBy("_k", "payload_digest").orderBy("url")
    rows = rows.withColumn("_nth", F.row_number().over(same))
    again = F.col("first").isNotNull() & ((F.col("first") != F.col("_k")) | (F.col("_nth") > 1))
    first = F.when(again, F.nullif("first", F.lit(2**63 - 1)))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(http, F.when(~again, F.col("html")).otherwise(""))
    head = _lines(
        ("WARC-Type", F.when(again, F.lit("revisit")).otherwise("response")), ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"), F.col("_nth"))), ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        ("WARC-Profile", F.when(again, F.lit(PROFILE))), ("WARC-Refers-To", F.when(again, _record_id(first, F.col("payload_digest"), F.lit(1)))),
        ("X-Page-Id", F.col("page_id").cast("string")), ("X-Refers-To-Page", first.cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(body).cast("string")),
    )
    records = rows.select("payload_bytes", head.alias("head"), body.alias("body"))
    member = F.pandas_udf(zipped, "binary")("head", "body").cast("string").alias("value")

    def put(part: DataFrame, most: int) -> None:
        part.select(member).write.mode("append").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", most).text(path)

    big = F.col("payload_bytes") >= BIG
    put(records.where(~big), MOST_RECORDS)
    if pages.where(F.octet_length("html") >= BIG).take(1):
        put(records.where(big), 1)


def records_in(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a file; a record is unpacked at a time."""
    field = re.compile(rb"([^:\r\n]+): ([^\r\n]*)\r\n")
    at, data = 0, b""
    while at < len(content):
        d = zlib.decompressobj(31)
        while not d.eof and at < len(content):
            data += d.decompress(content[at : at + 65536])
            at = min(at + 65536, len(content)) - len(d.unused_data)
        end = data.index(b"\r\n\r\n") + 4
        head = {k.decode(): v.decode() for k, v in field.findall(data, 0, end)}
        size = int(head["Content-Length"])
        if len(data) < end + size + 4:  # goes on in the next member
            continue
        yield head, data[end : end + size]
        data = b""


def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
    for batch in batches:
        for content in batch["content"]:
            out, size = [], 0
            for head, block in records_in(content):
                http, _, payload = block.partition(b"\r\n\r\n")
                page, to, length = head.get("X-Page-Id"), head.get("X-Refers-To-Page"), re.search(rb"Content-Length: (\d+)", http)
                out.append((
                    None if page is None else int(page), int(length[1]), head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"],
                    None if to is None else int(to), head.get("WARC-Target-URI"), payload.decode(),
                ))
                size += len(payload)
                if size > MEMBER:
                    yield frame(out)
                    out, size = [], 0
            yield frame(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record below path: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (empty for revisits).

    payload_bytes is what the record's HTTP header says. A folder without records gives an empty result.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parsed, RECORD)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives and reads them back. Each payload read is held against its digest."""
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    back = read(spark, path)
    same = (F.col("record_type") == "revisit") | (F.sha2(F.col("payload").cast("binary"), 256) == F.col("payload_digest"))
    return back.where(F.when(same, True).otherwise(F.raise_error("a payload read back has another digest"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
