"""WARC captures: reading and writing record files, and resolving not-modified revisits.

A revisit says that a server answered 304. Its content is that of the latest earlier full response
of the same canonical URL, if the validators agree; the response's headers are updated by those the
304 may change. The as-of join is cut in ranges: all captures are dealt in ranges of URL, time and
record id, each range finds the latest response of a URL inside itself, and the last response of a
URL's earlier ranges is carried in by a window over its ranges. A URL with a third of all captures so
is many groups, even if all have one time or none, and only ids, validators and headers move; bodies
meet their revisits by record id at the end.

Defined cases: a null url is a URL of its own ('') and a null time comes before all others; equal
times are ordered by record id; header names are equal in any case; a revisit without an earlier response, or with other validators,
stays unresolved with null content; repeated rows are captures of their own; null headers are
empty; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

# Headers that a 304 must not change in a stored response (they describe the body
# that was sent then), hop-by-hop ones included.
NOT_MERGED = (
    "content-length content-encoding content-type content-range transfer-encoding connection keep-alive "
    "proxy-authenticate proxy-authorization te trailer upgrade"
).split()
# Query parameters that name no other content.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|msclkid|sessionid|phpsessid)(=.*)?$"
#: Captures in a range of URL, time and id, about.
BUCKET_ROWS = 10_000

#: id may be of any type that has an order.
CAPTURES = "id long, url string, time long, is_full boolean, etag string, modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """host[:port]/path[?sorted query]: no scheme, user, www, default port, fragment, tracking
    parameters or trailing slash; the host in lower case."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _etag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")  # weak comparison


def resolve_revisits(captures: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """captures of the columns of CAPTURES -> one row per capture: id, url_key, status (full, resolved,
    no_response, mismatch), refers_to, digest and headers of the content it stands for; with bodies
    (id, body) also body."""
    c = captures.withColumn("url_key", canonical_url(F.col("url"))).withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    c = cut(c.select("id", "url_key", F.coalesce("time", F.lit(-(2**63))).alias("time"), "is_full", "etag", "modified", "digest", "headers"))
    # what a range holds is sampled, so it is written before it is used twice
    dealt = c.repartitionByRange(c.count() // BUCKET_ROWS + 1, "url_key", "time", "id")
    c = cut(dealt.withColumn("bucket", F.spark_partition_id()))
    full = F.when(F.col("is_full"), F.struct("time", "id", "etag", "modified", "digest", "headers"))
    inside = Window.partitionBy("url_key", "bucket").orderBy("time", "id").rowsBetween(Window.unboundedPreceding, -1)
    near = c.withColumn("near", F.last(full, ignorenulls=True).over(inside))
    latest = (
        c.filter("is_full")
        .groupBy("url_key", "bucket")
        .agg(F.max_by(F.struct("time", "id", "etag", "modified", "digest", "headers"), F.struct("time", "id")).alias("last_full"))
    )
    spots = c.select("url_key", "bucket").distinct().join(latest, ["url_key", "bucket"], "left")
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(spots.select("url_key", "bucket", F.last("last_full", ignorenulls=True).over(before).alias("far")))
    joined = near.join(carried, ["url_key", "bucket"]).withColumn("original", F.coalesce("near", "far"))
    agrees = (
        F.when(F.col("etag").isNotNull() & F.col("original.etag").isNotNull(), _etag(F.col("etag")) == _etag(F.col("original.etag")))
        .when(F.col("modified").isNotNull() & F.col("original.modified").isNotNull(), F.col("modified") == F.col("original.modified"))
        .when(F.col("digest").isNotNull() & F.col("original.digest").isNotNull(), F.col("digest") == F.col("original.digest"))
        .otherwise(F.lit(False))
    )
    status = (
        F.when(F.col("is_full"), "full").when(F.col("original").isNull(), "no_response").when(agrees, "resolved").otherwise("mismatch")
    )
    permitted = F.map_filter("headers", lambda k, _: ~F.lower(k).isin(NOT_MERGED))
    stored = F.map_filter("original.headers", lambda k, _: ~F.exists(F.map_keys(permitted), lambda n: F.lower(n) == F.lower(k)))
    out = joined.withColumn("status", status).select(
        "id",
        "url_key",
        "status",
        F.when(F.col("status") == "resolved", F.col("original.id")).alias("refers_to"),
        F.when(F.col("status") == "full", F.col("digest")).when(F.col("status") == "resolved", F.col("original.digest")).alias("digest"),
        F.when(F.col("status") == "full", F.col("headers")).when(F.col("status") == "resolved", F.map_concat(stored, permitted)).alias("headers"),
    )
    if bodies is None:
        return out
    stands_for = F.when(F.col("status") == "full", F.col("id")).otherwise(F.col("refers_to"))
    b = bodies.select(F.col("id").alias("body_id"), "body")
    return out.join(b, stands_for == F.col("body_id"), "left").drop("body_id")


# -- record files ---------------------------------------------------------------------------------

RECORD = "record_id string, type string, url string, date string, refers_to string, payload_digest string, status int, headers map<string,string>, body binary"


def _head(stream: io.BufferedIOBase) -> tuple[str, dict[str, str]] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    fields: dict[str, str] = {}
    first, last = line.decode("utf-8", "replace").strip(), None
    for raw in iter(stream.readline, b""):
        text = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and last:
            fields[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            fields[last] = value.strip()
    return first, fields


def records_of(content: bytes | pa.Buffer) -> Iterator[dict]:
    """Records of a WARC file's bytes, plain or gzip with a member for each record. One record is held
    at a time, and the file's own bytes once."""
    stream = io.BufferedReader(pa.BufferReader(content))
    if bytes(content[:2]) == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    while head := _head(stream):
        version, fields = head
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {version[:40]!r}")
        block = stream.read(int(fields.get("content-length", 0)))
        status, headers, body = None, {}, block
        if fields.get("warc-type") in ("response", "revisit") and block.startswith(b"HTTP/"):
            inner = io.BytesIO(block)
            line, headers = _head(inner)
            parts = line.split(" ", 2)
            status = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None
            body = inner.read()
        yield {
            "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "url": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest"),
            "status": status, "headers": headers, "body": body,
        }


def to_bytes(records: Iterable[dict], compress: bool = True) -> bytes:
    """A WARC 1.1 file of response and revisit records, the inverse of records_of."""
    out = []
    for r in records:
        body = r.get("body") or b""
        http = b""
        if r.get("status") is not None:
            lines = [f"HTTP/1.1 {r['status']} -", *(f"{k}: {v}" for k, v in sorted((r.get("headers") or {}).items()))]
            http = ("\r\n".join(lines) + "\r\n\r\n").encode()
        named = (
            ("WARC-Record-ID", r.get("record_id")), ("WARC-Type", r.get("type")), ("WARC-Target-URI", r.get("url")), ("WARC-Date", r.get("date")),
            ("WARC-Refers-To", r.get("refers_to")), ("WARC-Payload-Digest", r.get("payload_digest")), ("Content-Length", str(len(http) + len(body))),
        )
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None) + "\r\n"
        record = head.encode() + http + body + b"\r\n\r\n"
        out.append(gzip.compress(record, mtime=0) if compress else record)
    return b"".join(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under a path of any store that Spark reads; a file, of at most 2 GB as
    it is stored, is one row of Spark's and is read record by record."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in it:
            for content in batch.column(0):
                part: list[dict] = []
                size = 0
                for r in records_of(content.as_buffer()):
                    part.append(r)
                    size += len(r["body"])
                    if size > 1 << 25:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] if n != "headers" else list(x[n].items()) for x in part], k) for n, k in zip(names, kinds)], names)
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] if n != "headers" else list(x[n].items()) for x in part], k) for n, k in zip(names, kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, RECORD)


def captures_of(records: DataFrame) -> DataFrame:
    """Response and revisit records in the form resolve_revisits takes; time in microseconds."""
    header = lambda n: F.element_at("headers", F.lit(n))
    return records.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("id"),
        "url",
        F.unix_micros(F.to_timestamp("date")).alias("time"),
        (F.col("type") == "response").alias("is_full"),
        header("etag").alias("etag"),
        header("last-modified").alias("modified"),
        F.col("payload_digest").alias("digest"),
        "headers",
    )


def payload_digest(body: bytes) -> str:
    return "sha256:" + hashlib.sha256(body).hexdigest()
