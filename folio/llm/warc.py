"""WARC archives: write captures as response or revisit, request and metadata records; read archives back; assemble captures.

Writing goes through Spark's own text sink with the record terminator CRLF CRLF as line separator, so an archive is an
ordinary WARC/1.1 file on whatever file system Spark writes to. Captures are written by size class, each with as many in an archive
as fit ARCHIVE bytes, so that an archive is never much larger than that unless one capture is. Reading walks each archive by
Content-Length, so payloads may hold any bytes, blank lines and record markers included; what a task holds is bounded by the
archives' size. Transactions are assembled by grouping records on concurrent-to (a response names itself).

Foreign archives: gzip members, header names in any case, folded headers, records without a content type and blocks that aren't
HTTP are read; a record that can't be (no length, torn header or block, bad gzip) becomes a row with `error`, after which reading goes
on at the next record marker.

Cases: null html is the empty payload; null url becomes urn:none; a null page_id keeps a record id of its own; equal
payloads of at least 1000 bytes are stored once, by the row with the largest page_id (repeated rows of that page_id are
all responses); rows repeated give repeated rows; an empty table gives no archives and an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import shared_dir, small, table, written

CRLF = "\r\n"
END = CRLF + CRLF
#: Bytes of an archive, about, and payload sizes of the classes that are written apart (larger captures have an archive each).
ARCHIVE, CLASSES = 32 << 20, (8 << 10, 64 << 10, 1 << 20, 8 << 20)
#: Payloads of fewer bytes are never revisits.
LEAST = 1000
RECORD = "kind string, record_id string, concurrent_to string, uri string, refers_to string, stated_digest string, stated_bytes long, payload_bytes long, payload_digest string, fields map<string,string>, payload binary, error string"


def _headers(*pairs: tuple[str, F.Column | str]) -> F.Column:
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, F.Column) else F.lit(v), F.lit(CRLF)) for k, v in pairs]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit(CRLF))


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null: a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    base = base.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary"))})
    groups = base.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    # only the groups' digests are joined: no payload is shuffled while they are few enough to be broadcast
    groups = written(groups.where("n > 1").drop("n"), "groups")
    return base.join(small(groups, groups.count()), ["payload_digest", "payload_bytes"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))).drop("top")


def write(planned: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive: int = ARCHIVE) -> None:
    """Archives of what plan() returns, three records a capture, in a folder for each size class that has captures."""
    ident = lambda part: F.concat(F.lit("<urn:folio:page:"), part, F.lit(">"))
    own = ident(F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none-"), F.monotonically_increasing_id().cast("string"))))
    # control characters can't stand in a header
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("urn:none"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))]
    size = lambda col: ("Content-Length", F.octet_length(col).cast("string"))
    response = _headers(("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response"), size(block))
    again = _headers(("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Refers-To", ident(F.col("refers_to").cast("string"))), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response"), size(block))
    asked = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}"))
    request = F.concat(_headers(("WARC-Type", "request"), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))), ("WARC-Concurrent-To", own), common[0], common[1], ("Content-Type", "application/http;msgtype=request"), size(asked)), asked)
    told = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = F.concat(_headers(("WARC-Type", "metadata"), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))), ("WARC-Concurrent-To", own), common[0], common[1], ("Content-Type", "application/warc-fields"), size(told)), told)
    value = F.concat(F.when(revisit, again).otherwise(response), block, F.lit(END), request, F.lit(END), metadata)
    # a revisit has no payload in it
    sizes = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    kind = sum((F.when(sizes > most, 1).otherwise(0) for most in CLASSES), F.lit(0))
    found = {r["k"] for r in planned.select(kind.alias("k")).distinct().collect()} | {0}
    for k in sorted(found):
        most = max(1, archive // CLASSES[k]) if k < len(CLASSES) else 1
        planned.where(kind == k).select(value.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", most).text(f"{path}/size-{k}")


def unpacked(data: bytes) -> tuple[bytes, str | None]:
    """The bytes of an archive, out of its gzip members if it is packed, and what was wrong with them."""
    if not data.startswith(b"\x1f\x8b"):
        return data, None
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            return b"".join(out), "bad gzip member"
        if not member.eof:
            return b"".join(out), "torn gzip member"
        data = member.unused_data
    return b"".join(out), None


def headers(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name; folded lines belong to the one before, lines without a colon to none."""
    lines = re.sub(r"\r?\n[ \t]+", " ", block.decode("utf-8", "replace")).splitlines()
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}


def record(head: dict[str, str], block: bytes, payload: bool) -> dict:
    row = dict.fromkeys(x.split(" ")[0] for x in RECORD.split(", "))
    digest = head.get("warc-payload-digest", "")
    row |= {"kind": head.get("warc-type", "").lower() or None, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"), "stated_digest": digest.removeprefix("sha1:") or None}
    kind, body = head.get("content-type", "").lower(), None
    if kind.startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            row["error"] = "no http header"
        http = headers(block[:cut] if cut >= 0 else block)
        stated = http.get("content-length", "")
        row["stated_bytes"] = int(stated) if stated.isdecimal() else None
        body = block[cut + 4 :] if cut >= 0 else block
    elif row["kind"] == "metadata":
        row["fields"] = list({k.strip(): v.strip() for k, colon, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if colon}.items())
    else:
        body = block
    if row["kind"] in ("response", "resource") and body is not None:
        row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest(), "payload": body if payload else None}
    return row


def parse(data: bytes, payload: bool = False):
    """The records of one archive, in order; errors are rows too."""
    bad = lambda why: dict.fromkeys(x.split(" ")[0] for x in RECORD.split(", ")) | {"error": why}
    data, wrong = unpacked(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        head = headers(data[at:end]) if end >= 0 else {}
        size = head.get("content-length", "")
        stop = end + 4 + int(size) if size.isdecimal() else -1
        if end >= 0 and data.startswith(b"WARC/", at) and 0 <= stop <= len(data):
            yield record(head, data[end + 4 : stop], payload)
            at = stop
            continue
        yield bad("torn header" if end < 0 else "no record marker" if not data.startswith(b"WARC/", at) else "torn block" if stop > len(data) else "no length")
        at = data.find(b"\r\nWARC/1.", at + 1)
        if at < 0:
            break
        at += 2
    if wrong:
        yield bad(wrong)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record of every archive under path; payload: with the bytes of responses."""
    fields = [f.split(" ")[0] for f in RECORD.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = list(parse(data.as_py(), payload))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(fields, types, strict=True)], fields)

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return archives.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit, its request and its metadata, joined by concurrent-to. Records that
    could not be read, and those of no capture, have no row."""
    records = records.where("error is null or kind is not null")
    capture = F.coalesce("concurrent_to", "record_id")
    main = F.col("kind").isin("response", "revisit")
    grouped = records.groupBy(capture.alias("capture_id")).agg(
        F.collect_list(F.when(main, F.struct("kind", "record_id", "uri", "refers_to", "stated_digest", "stated_bytes", "payload_bytes", "payload_digest", "payload"))).alias("responses"),
        F.first(F.when(F.col("kind") == "request", F.struct("record_id", "uri")), True).alias("request"),
        F.first(F.when(F.col("kind") == "metadata", F.struct("record_id", "fields")), True).alias("metadata"),
    )
    return grouped.select("capture_id", F.explode("responses").alias("response"), "request", "metadata")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write(plan(table(spark, sf_dir, "pages")), path)
    captures = assemble(read(spark, path))
    page = lambda col: F.expr(f"try_cast(regexp_extract({col}, '^<urn:folio:page:(-?[0-9]+)>$', 1) as bigint)")
    return captures.select(
        page("capture_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "response.stated_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.stated_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        page("response.refers_to").alias("refers_to"),
        F.col("request.uri").alias("uri"),
    )


ORACLE = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
q AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS top FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
       CASE WHEN g.top IS NULL OR g.top = q.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.top <> q.page_id THEN g.top END AS refers_to,
       q.url AS uri
FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest AND q.payload_bytes >= 1000"""
}
