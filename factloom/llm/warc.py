"""WARC archives: pages written as transactions of records, read back, and joined to one nested row per capture.

A page is a request, a response or revisit, and a metadata record, which name the response in WARC-Concurrent-To. Spark's
text writer makes the files: a row is a record, and the line separator is the two line ends that close one. The reader
frames records by their Content-Length, so that payloads may hold anything. Records that a capture doesn't own meet it by
their identifiers, in either direction and over other records: narrow rows move until none finds its capture any more,
and payloads move once, with the capture's identifier, which no two captures share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, give_back, small, table

CRLF = "\r\n"
#: Smaller payloads are always written whole.
LEAST_BYTES = 100
#: Bytes of payload in an archive file, about; a file is read by one task.
FILE_BYTES = 32 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HUBS = ("response", "revisit")
DATE = "1970-01-01T00:00:00Z"

RECORD = "record_id string, kind string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, head string, payload binary, file string, place long"


def field(name: str, value: Column) -> Column:
    """A header line of a value without line ends; none for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def record(kind: Column, fields: list[Column], content_type: str, block: Column) -> Column:
    """A whole record but for the two line ends that close it."""
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF))
    return F.concat(F.lit(VERSION + CRLF), field("WARC-Type", kind), *fields, field("Content-Type", F.lit(content_type)), length, F.lit(CRLF), block)


def captures(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(capture, page_id, url, html, bytes, digest) of each row; capture is an identifier that no other row has."""
    html = F.coalesce(df[html_col].cast("string"), F.lit(""))
    rows = df.select(F.uuid().alias("capture"), df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), html.alias("html"))
    return rows.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


def write_archives(df: DataFrame, scratch: Scratch, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Archives of all rows of df under path: three records for each.

    The payload is the html in UTF-8, a null being empty. Of rows with equal payloads of `least` bytes or more, one with
    the smallest id is the response and all others revisit it; nulls are the largest ids, and of rows of one id any is it.
    Payloads are told apart by SHA-256 and length. Repeated rows are captures by themselves. A null url has no target;
    url and id stand in the metadata record as they are. Other columns are not read; without rows no archive is written
    that holds a record.
    """
    stored = scratch.save(captures(df, id_col, url_col, html_col), "captures", "zstd")
    narrow = stored.where(F.col("bytes") >= least).select("capture", "page_id", "bytes", "digest")
    first = narrow.groupBy("digest", "bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("lost"), "page_id", "capture")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = narrow.join(small(scratch.save(first.select("digest", "bytes", "first"), "first")), ["digest", "bytes"])
    again = scratch.save(again.where("capture <> first.capture").select("capture", F.col("first.capture").alias("original")), "revisits")
    rows = stored.join(small(again), "capture", "left")
    is_revisit = F.col("original").isNotNull()
    # an identifier for each record: the capture's with another first digit
    urn = lambda digit, of: F.concat(F.lit(f"<urn:uuid:{digit}"), F.substring(of, 2, 35), F.lit(">"))
    own, asked, said, original = urn("a", "capture"), urn("b", "capture"), urn("c", "capture"), urn("a", "original")
    target = F.nullif(F.regexp_replace("url", r"[^\x21-\x7e]", ""), F.lit(""))
    common = [field("WARC-Target-URI", target), field("WARC-Date", F.lit(DATE))]
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    digest = field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    kind = F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))
    response = record(kind, [field("WARC-Record-ID", own), *common, digest, field("WARC-Refers-To", original), field("WARC-Profile", F.when(is_revisit, F.lit(PROFILE)))], "application/http; msgtype=response", F.when(is_revisit, head).otherwise(F.concat(head, F.col("html"))))
    host = F.regexp_extract(F.coalesce(target, F.lit("")), r"^[a-z]+://([^/?#]*)", 1)
    asking = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    request = record(F.lit("request"), [field("WARC-Record-ID", asked), *common, field("WARC-Concurrent-To", own)], "application/http; msgtype=request", asking)
    about = F.to_json(F.struct("page_id", "url"))
    metadata = record(F.lit("metadata"), [field("WARC-Record-ID", said), field("WARC-Date", F.lit(DATE)), field("WARC-Concurrent-To", own)], "application/json", about)
    n, size = stored.agg(F.count("*"), F.sum("bytes")).first()
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    each = 3 * max(1, n * file_bytes // max(1, size or 0))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", each).mode("overwrite").text(path)
    scratch.drop("captures", "first", "revisits")


def frames(content: bytes, file: str) -> Iterator[tuple[int, dict[str, list[bytes]], memoryview]]:
    """(place, headers by lower-case name, block) of the records of a file's bytes, which may be gzip members."""
    if content[:2] == b"\x1f\x8b":
        parts = []
        while content:
            unpack = zlib.decompressobj(31)
            parts.append(unpack.decompress(content) + unpack.flush())
            content = unpack.unused_data.lstrip(b"\0")
        content = b"".join(parts)
    at, whole = 0, memoryview(content)
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].split(b"\r\n") if end >= 0 else []
        if not lines or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"{file}: no record at byte {at}")
        headers: dict[str, list[bytes]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.strip().lower().decode("utf-8", "replace"), []).append(value.strip())
        length = int(headers["content-length"][0])
        if end + 4 + length > len(content):
            raise ValueError(f"{file}: the record at byte {at} ends early")
        yield at, headers, whole[end + 4 : end + 4 + length]
        at = end + 4 + length
        if content[at : at + 4] == b"\r\n\r\n":
            at += 4
        elif at < len(content):
            raise ValueError(f"{file}: the record before byte {at} is longer than it says")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under path, in plain or gzip form: RECORD.

    head and payload are the two parts of an HTTP block, else head is null and payload the block. A file is read whole by
    one task, and files are of less than 2 GB. A file that breaks off, or holds what is no record, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        names = [f.split()[0] for f in RECORD.split(", ")]
        text = lambda x: None if not x else x[0].decode("utf-8", "replace")
        for batch in batches:
            for k in range(batch.num_rows):
                file, rows, held = batch.column("path")[k].as_py(), [], 0
                for place, headers, block in frames(batch.column("content")[k].as_py(), file):
                    head, payload = None, block.tobytes()
                    if (text(headers.get("content-type")) or "").startswith("application/http"):
                        head, _, payload = payload.partition(b"\r\n\r\n")
                        head = head.decode("utf-8", "replace")
                    to = [x.decode("utf-8", "replace") for x in headers.get("warc-concurrent-to", [])]
                    rows.append((text(headers.get("warc-record-id")), text(headers.get("warc-type")), to, *(text(headers.get(h)) for h in ("warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest")), head, payload, file, place))
                    held += len(payload)
                    if held > 4 << 20:
                        yield arrow(rows, names)
                        rows, held = [], 0
                if rows:
                    yield arrow(rows, names)

    kinds = dict(concurrent_to=pa.list_(pa.string()), payload=pa.binary(), place=pa.int64())

    def arrow(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(run, RECORD)


def transactions(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One nested row per capture of records (RECORD): capture, n, response, request, metadata, refers_to.

    A capture is a response or revisit record, and owns the request and metadata records that name it in
    WARC-Concurrent-To, that it names, or that are so linked to a record it owns; a record linked with several captures
    is that of the smallest identifier. n counts from 0: a capture's second request or metadata record is in a row n = 1
    without response, and so on, by identifier and place; the first row is the capture's. Records linked with no capture
    have rows of capture null, n by themselves. refers_to is the identifier that a revisit names. Records of other kinds
    are not read. Of records with one identifier all stay: captures have a row each, and what is linked with them goes to
    that of the smallest file and place.
    """
    stored = scratch.save(records.where(F.col("kind").isin(*HUBS, "request", "metadata")), "records", "zstd")
    is_hub, spot = F.col("kind").isin(*HUBS), F.concat_ws("@", "file", "place")
    hubs = stored.where(is_hub & F.col("record_id").isNotNull()).select("record_id")
    links = stored.where("record_id IS NOT NULL").select("record_id", F.explode("concurrent_to").alias("other"))
    links = links.union(links.select("other", "record_id"))
    others = stored.where(~is_hub)
    owner, fringe, k = None, hubs.select(F.col("record_id").alias("by"), F.col("record_id").alias("capture")), 0
    while True:  # each round reaches records one link farther off: one round for most archives
        k += 1
        reached = links.join(fringe, links["record_id"] == F.col("by")).groupBy(F.col("other").alias("record_id")).agg(F.min("capture").alias("capture"))
        known = hubs if owner is None else hubs.union(owner.select("record_id"))
        found = scratch.save(reached.join(known, "record_id", "left_anti"), f"owned{k}")
        owner = found if owner is None else owner.union(found)
        waiting = others.select("record_id").join(owner.select("record_id"), "record_id", "left_anti").where("record_id IS NOT NULL")
        if not found.limit(1).count() or not waiting.limit(1).count():
            break
        fringe = found.select(F.col("record_id").alias("by"), "capture")
    # payloads of captures move once, by a key that no other capture has; their requests and metadata are put together first
    one = F.struct("record_id", "kind", "uri", "date", "digest", "head", "payload", "refers_to")
    twice = stored.where(is_hub & F.col("record_id").isNotNull()).groupBy("record_id").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1").select("record_id", "first")
    own = stored.where(is_hub).join(small(scratch.save(twice, "twice")), "record_id", "left")
    again = F.col("record_id").isNull() | F.coalesce(F.col("first") != spot, F.lit(False))
    own = own.select(F.when(again, spot).otherwise(F.col("record_id")).alias("key"), F.lit(0).alias("n"), F.col("record_id").alias("hub"), one.alias("response"))
    beside = others.join(owner, "record_id", "left").withColumn("spot", spot).withColumn("key", F.coalesce("capture", "spot"))
    ranked = Window.partitionBy("key", "kind").orderBy("record_id", "spot")
    beside = beside.repartition("key").withColumn("n", F.row_number().over(ranked) - 1)
    beside = beside.groupBy("key", "n").agg(F.max("capture").alias("owned_by"), *(F.max(F.when(F.col("kind") == kind, one)).alias(kind) for kind in ("request", "metadata")))
    nested = own.join(beside, ["key", "n"], "full")
    return nested.select(F.coalesce("hub", "owned_by").alias("capture"), "n", "response", "request", "metadata", F.col("response.refers_to").alias("refers_to"))


def resolved(nested: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of nested captures that tell their page.

    A revisit has length and digest of the payload that it refers to, and its page; nulls if no response has that
    identifier. Of a response both are worked out from the payload that was read.
    """
    about = F.from_json(F.col("metadata.payload").cast("string"), "page_id long, url string")
    rows = nested.where("response IS NOT NULL").select("capture", about.alias("about"), F.col("response.kind").alias("record_type"), "refers_to", F.octet_length("response.payload").cast("long").alias("bytes"), F.sha2("response.payload", 256).alias("sha"))
    rows = scratch.save(rows.select("capture", F.col("about.page_id").alias("page_id"), F.col("about.url").alias("url"), "record_type", "refers_to", "bytes", "sha"), "rows")
    whole = rows.where("record_type = 'response'")
    named = scratch.save(rows.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("capture")).distinct(), "named")
    ends = scratch.save(whole.join(small(named), "capture", "left_semi").groupBy("capture").agg(F.min(F.struct("page_id", "bytes", "sha")).alias("whole")), "ends")
    revisits = rows.where("record_type = 'revisit'").join(small(ends.withColumnRenamed("capture", "of")), F.col("refers_to") == F.col("of"), "left")
    told = whole.select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return told.union(revisits.select("page_id", "url", F.col("whole.bytes"), F.col("whole.sha"), "record_type", F.col("whole.page_id")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table pages as archives in the shared folder, read back: what each page's capture says; odd rows are as in write_archives."""
    scratch = Scratch(spark, "op12")
    path = f"{scratch.root}/archives"
    write_archives(table(spark, sf_dir, "pages"), scratch, path)
    return resolved(transactions(read_records(spark, path), scratch), scratch).drop("url")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND least <> page_id THEN least END AS refers_to
FROM f"""
