"""Legacy archive converter: ARC files in, WARC files out, both read and written through Spark's file sources.

    pages --write_arc--> ARC files --read_arc--> records --deduplicate--> records with a type --write_warc--> WARC files

An ARC file begins with a version block that declares which fields a header line has; the fields of version 1 and 2
differ. Each record's header line declares its length in bytes. From these the converter makes what WARC asks for:
identifiers (a UUID from URL, date, digest and the record's place: its archive's number and its offset there, so repeated
rows differ, and a task that runs again gives the same), ISO timestamps, types, and base32 SHA-1 digests of payload and
block. Archives are gzip files, parsed whole by one task. Their number of records follows the largest page, so that none
has more than ARCHIVE_BYTES of payload; records never meet on the driver.

Revisits: records of equal payload are grouped by its length, SHA-1 and SHA-256, in salted parts first. Only one small row
of each group with two members or more goes back to the records, once for each part that it has. The number of salts
follows that of the records, so a payload that a third of all pages share is no single task's work.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.common import new_folder, table, trim

#: Fixed values of the two formats: the version blocks' second lines, and the profile of revisits.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive's records, and bytes of payload, at most; records of a salt, on average.
RECORDS_PER_FILE, ARCHIVE_BYTES, ROWS_PER_SALT = 4000, 1 << 30, 100_000
ARCHIVE_NUMBER = re.compile(r"(?<=^part-)\d+|(?<=-c)\d+(?=\.)")
#: Bytes of payload in a batch that a task hands to Spark.
BATCH_BYTES = 4 << 20
RECORD = "target_uri string, record_id string, warc_date string, ip string, http_head binary, payload binary, payload_bytes long, payload_digest string, content_key string, response_digest string, head_digest string"
READ = "warc_type string, record_id string, warc_date string, target_uri string, refers_to_uri string, payload binary, payload_bytes long, payload_digest string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def write_arc(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """ARC files of per_file rows of page_id, url, html of one partition: version 1 or 2 by turns of partitions. A record holds an HTTP head and
    the html in UTF-8 (null: no bytes). The page_id goes into the URL's fragment; blanks and control characters of the
    URL are percent-encoded, a null URL is about:blank."""
    html = F.coalesce("html", F.lit(""))
    size = F.octet_length(html)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    url = F.coalesce("url", F.lit("about:blank"))
    for code in (9, 10, 11, 12, 13, 32):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)).cast("long"), F.lit(10**9)) + 800_000_000
    first = F.concat_ws(" ", F.concat(url, F.lit("#page="), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit("192.0.2.1"), F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss"), F.lit("text/html"))
    length = (F.octet_length(head) + size).cast("string")
    number = F.monotonically_increasing_id()
    version = F.pmod(F.shiftright(number, 33), F.lit(2)) + 1

    def block(v: int) -> str:
        body = f"{v} 0 tickerloom\n{FIELDS[v]}\n"
        return f"filedesc://pages.arc 0.0.0.0 19960101000000 text/plain {'200 - - 0 pages.arc ' if v == 2 else ''}{len(body)}\n{body}\n"

    line = F.when(version == 1, F.concat_ws(" ", first, length)).otherwise(F.concat_ws(" ", first, F.lit("200 - - 0 pages.arc"), length))
    opening = F.when(F.pmod(F.pmod(number, F.lit(1 << 33)), F.lit(per_file)) == 0, F.when(version == 1, block(1)).otherwise(block(2))).otherwise("")
    rows = pages.select(F.concat(opening, line, F.lit("\n"), head, html).alias("value"))
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_arc(data: bytes) -> Iterator[tuple[str, str, str, bytes, int]]:
    """(url, ip, date of 14 digits, body, offset) of each record. Raises on a header line that the version doesn't allow."""
    at, after_type = 0, 0
    while True:
        while at < len(data) and data[at] in b"\r\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        size = int(line[-1])
        begin, body, at = at, data[end + 1 : end + 1 + size], end + 1 + size
        if line[0].startswith("filedesc://"):
            declared, names = body.decode().split("\n")[:2]
            if names.split() != FIELDS[int(declared.split()[0])].split():
                raise ValueError(f"unknown ARC fields: {names}")
            after_type = len(names.split()) - 4
            continue
        if not after_type or len(line) < 4 + after_type:
            raise ValueError(f"no ARC header line: {' '.join(line)[:200]}")
        yield line[0], line[1], line[2].ljust(14, "0"), body, begin


def convert(url: str, ip: str, date: str, body: bytes, place: str) -> tuple:
    """The fields of RECORD for one ARC record; place tells it from others of equal URL, date and payload."""
    head, found, payload = body.partition(b"\r\n\r\n")
    head, payload = (head + found, payload) if body.startswith(b"HTTP/") and found else (b"", body)
    digest = sha1_base32(payload)
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    key = f"{digest} {hashlib.sha256(payload).hexdigest()} {len(payload)}"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {stamp} {digest} {place}")
    return url, f"<urn:uuid:{name}>", stamp, ip, head, payload, len(payload), digest, key, sha1_base32(body), sha1_base32(head)


def _batches(rows: Iterator[tuple], schema: pa.Schema, payload: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[payload] or b"") + 500
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


_KINDS = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _contents(batches) -> Iterator[tuple[str, bytes]]:
    """(number, bytes) of each archive: the numbers that Spark's writer gives to a partition and its files."""
    for batch in batches:
        for path, content in zip(*batch.columns):
            name = path.as_py().rsplit("/", 1)[-1]
            yield "-".join(ARCHIVE_NUMBER.findall(name)) or name, gzip.decompress(content.as_py())


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Columns RECORD: each record of the ARC files (.gz) in path, with what a WARC record of it needs."""

    def parse(batches):
        yield from _batches((convert(*record, f"{number}:{at}") for number, data in _contents(batches) for *record, at in parse_arc(data)), _schema(RECORD), 5)
        trim()

    return _files(spark, path).mapInArrow(parse, RECORD)


def deduplicate(records: DataFrame, order: Column, least_bytes: int = 0, salts: int = 16) -> DataFrame:
    """records and refers_to (record_id, target_uri, warc_date): null for a response. Of records with equal payloads of
    least_bytes or more, the one with the largest order (then record_id) is the response."""
    this = F.struct(order.alias("order"), "record_id", "target_uri", "warc_date")
    salted = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    parts = salted.where(F.col("payload_bytes") >= least_bytes).groupBy("content_key", "salt").agg(F.max(this).alias("to"), F.count("*").alias("n"))
    groups = parts.groupBy("content_key").agg(F.max("to").alias("to"), F.sum("n").alias("n")).where("n > 1").drop("n")
    joined = salted.join(parts.select("content_key", "salt").join(groups, "content_key"), ["content_key", "salt"], "left")
    return joined.select(*records.columns, F.when(F.col("to.record_id") != F.col("record_id"), F.col("to")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """WARC files (.gz) of records with refers_to. A revisit has the HTTP head alone as its block."""
    again = F.col("refers_to").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Date: "), "warc_date"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-IP-Address: "), "ip"),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), F.when(again, F.col("head_digest")).otherwise(F.col("response_digest"))),
        F.concat(F.lit("WARC-Profile: "), F.when(again, PROFILE)),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to.record_id"),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), "refers_to.target_uri"),
        F.concat(F.lit("WARC-Refers-To-Date: "), "refers_to.warc_date"),
        F.concat(F.lit("Content-Length: "), (F.octet_length("http_head") + F.when(again, 0).otherwise(F.octet_length("payload"))).cast("string")),
    ]
    head = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")
    record = F.concat(head, "http_head", F.when(again, F.lit(b"")).otherwise(F.col("payload"))).cast("string")
    writer = records.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n")
    writer.option("maxRecordsPerFile", per_file).text(path)


def parse_warc(data: bytes) -> Iterator[tuple]:
    """The fields of READ of each record. Raises where a response's payload hasn't the digest that it declares."""
    at = 0
    while True:
        while at < len(data) and data[at] in b"\r\n":
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:200]}")
        field = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        size = int(field["Content-Length"])
        block, at = data[end + 4 : end + 4 + size], end + 4 + size
        head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        digest, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"]
        if kind == "revisit":
            size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            payload = None
        else:
            size = len(payload)
            if sha1_base32(payload) != digest:
                raise ValueError(f"{field['WARC-Record-ID']}: the payload's digest isn't {digest}")
        yield kind, field["WARC-Record-ID"], field["WARC-Date"], field["WARC-Target-URI"], field.get("WARC-Refers-To-Target-URI"), payload, size, digest


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Columns READ of each record of the WARC files (.gz) in path."""

    def parse(batches):
        yield from _batches((record for _, data in _contents(batches) for record in parse_warc(data)), _schema(READ), 5)
        trim()

    return _files(spark, path).mapInArrow(parse, READ)


def page_of(uri: str) -> Column:
    return F.regexp_extract(uri, r"#page=(-?\d+)$", 1).try_cast("long")


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages to folder/arc, converts to folder/warc, and reads these back (READ). Null page_ids count as
    smallest; rows that repeat a page_id are records of their own; an empty table gives archives without records."""
    spark = pages.sparkSession
    rows, largest = pages.agg(F.count("*"), F.max(F.octet_length("html"))).first()
    per_file = max(1, min(RECORDS_PER_FILE, ARCHIVE_BYTES // max(largest or 0, 1)))
    salts = max(16, -(-rows // ROWS_PER_SALT))
    write_arc(pages.select("page_id", "url", "html"), f"{folder}/arc", per_file)
    write_warc(deduplicate(read_arc(spark, f"{folder}/arc"), page_of("target_uri"), salts=salts), f"{folder}/warc", per_file)
    return read_warc(spark, f"{folder}/warc")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_pages(table(spark, sf_dir, "pages"), new_folder(spark, "op6"))
    return back.select(
        page_of("target_uri").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        page_of("refers_to_uri").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last_id, unhex(sha1(body)) AS raw FROM p),
bits AS (SELECT page_id, body, last_id, string_agg(lpad(bin(get_byte), 8, '0'), '' ORDER BY i) AS b FROM (
  SELECT page_id, body, last_id, i, ('0x' || substr(hex(raw), 2 * i + 1, 2))::INTEGER AS get_byte FROM g, range(20) t(i)) GROUP BY ALL)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (CASE WHEN substr(b, 5 * k + j + 1, 1) = '1' THEN 1 ELSE 0 END) * (16 >> j::INTEGER)))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM bits
"""

QUERIES = {"op6_warc": op6_warc}
ORACLE = {"op6_warc": SQL}
