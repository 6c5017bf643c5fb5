"""WARC archives: one transaction for each page, written and read by Spark's own text source, assembled through concurrent-to identifiers.

A page becomes a request, a response (or, for a payload that another page's response holds, a revisit) and a metadata record; request and
metadata name the response in WARC-Concurrent-To. Records end with two line breaks, which is the text source's line separator here, so the
writer's committed files are plain (gzipped) WARC files on any file system. The reader joins the pieces of a file again and cuts records by
their Content-Length, one record in memory at a time; a payload that holds the separator is no special case. Gzipped files are not split, so
a record never crosses tasks. Each record's payload digest is computed again from what was read.

Of pages with equal payloads (of ``least`` bytes or more) that with the largest page_id is the response. Digests and ids, never payloads, are
shuffled to find it.

Edge cases: null html is an empty payload; a null url is an empty target; a null page_id is never the largest, and if a payload has no other
each of its rows is a response; of rows that repeat the largest page_id each is a response; an empty table gives empty archives; other columns
don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, store, table

BREAK = "\r\n"
END = BREAK * 2
#: The digits of base-32 numbers and of the base-32 encoding.
NUMBER, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32, from built-in functions: four times 40 bits are eight letters each."""
    digest = F.upper(F.sha1(payload))
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0"), NUMBER, LETTERS) for k in range(4)])


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) for each page whose payload another page's response holds; pages: (page_id, digest, bytes), a written table."""
    groups = pages.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    several = store(groups.where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to"), "several")
    found = pages.where(F.col("bytes") >= least).join(several, "digest")
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12)))


def _record(kind: str, record: Column, url: Column, mime: str, block: Column, *more: Column) -> Column:
    head = F.concat_ws(
        BREAK, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <"), record, F.lit(">")), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url), *more, F.lit(f"Content-Type: {mime}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(END), block)


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of pages (page_id, url, html) at path."""
    html = F.coalesce("html", F.lit(""))
    light = store(pages.select("page_id", base32_sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("bytes")), "digests")
    again = store(revisits(light, least), "revisits").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    d = pages.select("page_id", "url", html.alias("html")).withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    d = d.join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").withColumn("row", F.monotonically_increasing_id().cast("string"))
    # a line break would end the header; percent-encode what a URI can't hold
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    response, request, metadata = (_uuid(number, F.col("row"), F.lit(k)) for k in ("response", "request", "metadata"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <"), response, F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    first = F.when(
        F.col("refers_to").isNull(), _record("response", response, url, "application/http;msgtype=response", F.concat(http, "html"), digest)
    ).otherwise(
        _record("revisit", response, url, "application/http;msgtype=response", http, digest, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.concat(F.lit("WARC-Refers-To-Page: "), F.col("refers_to").cast("string")))
    )
    asked = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{END}"))
    known = F.concat(F.lit("page-id: "), number, F.lit(BREAK))
    records = F.array(_record("request", request, url, "application/http;msgtype=request", asked, concurrent), first, _record("metadata", metadata, url, "application/warc-fields", known, concurrent))
    d.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of pieces that were separated by END."""
    end = END.encode()
    held = b""

    def more() -> bool:
        nonlocal held
        piece = next(stream, None)
        if piece is None:
            return False
        held += piece + end
        return True

    while True:
        while held.startswith(b"\r\n") or not held:
            held = held[2:]
            if not held and not more():
                return
        while (at := held.find(end)) < 0:
            if not more():
                raise ValueError("an archive ends inside a record's header")
        lines = held[:at].decode("utf-8", "replace").split(BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one should begin: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        parts, have = [held[at + 4 :]], len(held) - at - 4
        while have < size:
            piece = next(stream, None)
            if piece is None:
                raise ValueError("an archive ends inside a record")
            parts += (piece, end)
            have += len(piece) + 4
        block = b"".join(parts)
        held = block[size:]
        yield headers, block[:size]


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, type, concurrent_to, url, refers_to, digest, payload_bytes, fields, payload) of each record under path.

    digest is checked against the payload, where the record holds one. payloads=False leaves payload null.
    """
    names = ["record_id", "type", "concurrent_to", "url", "refers_to", "digest", "payload_bytes", "fields", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            kinds = [*[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
            rows.clear()
            return batch

        pieces = (x.as_py() for batch in batches for x in batch.column(0))
        for h, block in _parse(pieces):
            kind, digest = h.get("warc-type", ""), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
            payload, size, fields = None, None, None
            if kind in ("response", "revisit"):
                head, _, payload = block.partition(END.encode())
                size = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                if kind == "response":
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                        raise ValueError(f"payload of {h.get('warc-record-id')} doesn't have its digest or length")
                else:
                    payload = None
            else:
                fields = block.decode("utf-8", "replace")
            refers = h.get("warc-refers-to-page")
            rows.append((h.get("warc-record-id", "").strip("<>"), kind, h.get("warc-concurrent-to", "").strip("<>") or None, h.get("warc-target-uri"), int(refers) if refers else None, digest, size, fields, payload if payloads else None))
            held += len(payload or b"") if payloads else 0
            if len(rows) >= 5000 or held > 8 << 20:
                yield out()
                held = 0
        yield out()

    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(run, "record_id string, type string, concurrent_to string, url string, refers_to long, digest string, payload_bytes long, fields string, payload binary")


def captures(found: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, response, request, metadata), joined through concurrent_to.

    A capture is a response or revisit; records that name no capture that is there are left out. A capture has three records, so no key is hot.
    """
    key = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    whole = F.struct("record_id", "type", "url", "refers_to", "digest", "payload_bytes", "payload")
    side = F.struct("record_id", "url", "fields")
    pick = lambda test, value, name: F.first(F.when(test, value), ignorenulls=True).alias(name)
    grouped = found.where(key.isNotNull()).groupBy(key.alias("capture_id"))
    nested = grouped.agg(pick(F.col("type").isin("response", "revisit"), whole, "response"), pick(F.col("type") == "request", side, "request"), pick(F.col("type") == "metadata", side, "metadata"))
    return nested.where(F.col("response").isNotNull())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = F.regexp_extract("metadata.fields", r"^page-id: (-?\d+)", 1)
    return captures(records(spark, path, payloads=False)).select(F.when(page != "", page.cast("long")).alias("page_id"), "response.payload_bytes", F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), "response.refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
bits AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    (CAST(('0x' || substr(hex, CAST(k // 8 AS INTEGER) * 10 + 1, 10)) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top OR top IS NULL THEN NULL ELSE top END AS refers_to
FROM bits
"""
