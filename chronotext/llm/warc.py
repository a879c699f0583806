"""WARC archives: a writer with revisit records and a salvage reader.

Archives are written by Spark's text writer (its line separator is the blank-line pair that ends a WARC record), so they
reach every store that Spark reaches. Reading takes one archive at a time and checks each record: version line, header,
length, closing blank lines, payload digest. Where a check fails the reader looks for the next version line or gzip
member, goes on from there and logs the bytes between as a gap.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table
from chronotext.session import fresh_path, stage

VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
#: Payloads below this many bytes never become revisits.
MIN_REVISIT = 100
#: Bytes meant to go to one archive.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes that are taken apart at a time.
PIECE = 1 << 16

FOUND = (
    "archive string, offset long, length long, kind string, record_type string, page_id long, uri string, "
    "payload_bytes long, payload_digest string, refers_to long, error string, payload binary"
)
COLUMNS = [part.split()[0] for part in FOUND.split(", ")]


def header(name: str, value: Column) -> Column:
    """One header line; nothing if the value is null. Line breaks inside a value would end the line and go."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]", ""), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record per row of `pages` (page_id, url, html) under `path`.

    A null html is an empty payload. Of rows with equal payloads of at least `MIN_REVISIT` bytes, those with the least
    page_id hold the payload and the others, null page_id included, refer to it; if no row of a group has a page_id, all
    hold it. A null page_id or url leaves its header line out. An empty table gives archives without records.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha2("html", 256))
    ids = rows.select("page_id", "bytes", "digest")
    shared = ids.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest")
    shared = shared.agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.sum("bytes").alias("size"))
    shared = stage(shared.where("n > 1 and first is not null").select("digest", "first"), "warc-shared")
    count, size = ids.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    per_file = max(1, ARCHIVE_BYTES * count // max(size, 1)) if count else 1
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    key = F.concat_ws(" ", F.col("page_id").cast("string"), F.col("url"), F.col("digest"))
    record = F.concat(
        F.lit(VERSION),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), F.sha2(key, 256), F.lit(">"))),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("X-Page-Id", F.col("page_id")),
        header("X-Payload-Length", F.col("bytes")),
        header("X-Refers-To-Page", F.when(revisit, F.col("first"))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    record = rows.select(record.alias("value"))
    record.write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines) if value}


def whole_number(value: str | None) -> int | None:
    """The value as a 64-bit number; None for anything else, as a header of a damaged archive can hold any text."""
    number = int(value) if value is not None and re.fullmatch(r"-?[0-9]{1,19}", value) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def record_at(data: bytes, at: int) -> tuple[int, dict] | str:
    """(end, record) of the record that starts at `at`, or what is wrong with it."""
    head_end = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/1.", at) or head_end < 0:
        return "no version line and header"
    named = fields(data[data.find(b"\r\n", at) + 2 : head_end])
    length = whole_number(named.get("content-length"))
    if length is None or length < 0:
        return "no content length"
    start, end = head_end + 4, head_end + 4 + length
    if data[end : end + 4] != b"\r\n\r\n":
        return "record does not end where its length says"
    block = data[start:end]
    http = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -4
    payload = block[http + 4 :] if http != -1 else block
    kind, digest = named.get("warc-type", ""), named.get("warc-payload-digest", "")
    if kind == "revisit":
        size, seen = whole_number(named.get("x-payload-length")), digest.removeprefix("sha256:")
    else:
        size, seen = len(payload), hashlib.sha256(payload).hexdigest()
        if digest.startswith("sha256:") and digest[7:].lower() != seen:
            return "payload digest differs"
    refers = whole_number(named.get("x-refers-to-page"))
    found = {"record_type": kind, "page_id": whole_number(named.get("x-page-id")), "uri": named.get("warc-target-uri")}
    return end + 4, found | {"payload_bytes": size, "payload_digest": seen, "refers_to": refers, "payload": payload}


def inflated(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member at `at` holds up to its end or its first damage, where it ends (None: not known), what is wrong."""
    member, parts, low = zlib.decompressobj(31), [], at
    while low < len(data) and not member.eof:
        before = member.copy()
        try:
            parts.append(member.decompress(data[low : low + PIECE]))
        except zlib.error as error:  # again byte by byte: what comes before the damage counts
            with contextlib.suppress(zlib.error):
                for i in range(low, low + PIECE):
                    parts.append(before.decompress(data[i : i + 1]))
            return b"".join(parts), None, f"member: {error}"
        low += PIECE
    if not member.eof:
        return b"".join(parts), None, "member is cut off or empty"
    return b"".join(parts), min(low, len(data)) - len(member.unused_data), ""


def records(data: bytes) -> Iterator[dict]:
    """Every record and every gap of an archive, in order: together they cover its bytes.

    Members compressed with gzip may hold one record or several; their records and gaps carry the member's offset and
    length. Of a damaged or cut-off member the whole records before the damage are kept, and one more gap says what is
    wrong; it reaches to where the next record or member seems to start.
    """
    at, bad, why = 0, None, ""
    start = re.compile(rb"WARC/1\.[0-9]\r\n|\x1f\x8b\x08")
    while at < len(data):
        got, end = [], at
        if data.startswith(b"\x1f\x8b\x08", at):
            plain, close, problem = inflated(data, at)
            inner = list(records(plain))
            if not any(r["kind"] == "record" for r in inner):
                problem = problem or next((r["error"] for r in inner), "member is cut off or empty")
            else:
                if close is None:
                    following = start.search(data, at + 1)
                    close = following.start() if following else len(data)
                    inner = [r for r in inner if r["kind"] == "record" or r["offset"] + r["length"] < len(plain)]
                    inner.append({"kind": "gap", "error": problem})
                problem, end = "", close
                got = [r | {"offset": at, "length": end - at} for r in inner]
        elif isinstance(one := record_at(data, at), str):
            problem, end = one, at
        else:
            problem, end = "", one[0]
            got = [one[1] | {"kind": "record", "offset": at, "length": end - at, "error": None}]
        if not problem:
            if bad is not None:
                yield {"kind": "gap", "offset": bad, "length": at - bad, "error": why}
                bad = None
            yield from got
            at = end
            continue
        if bad is None:
            bad, why = at, problem
        following = start.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad, "error": why}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (`kind`) of every archive under `path`; `payload` is null without `payloads`.

    An archive is read whole by one task. An empty archive gives no rows.
    """

    def salvage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, kinds[t]) for n, t in (part.split() for part in FOUND.split(", "))])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for row in records(content.as_buffer().to_pybytes()):
                    row["archive"] = name.as_py()
                    payload = row.pop("payload", None)
                    row["payload"] = payload if payloads else None
                    held.append(row)
                    size += len(payload or b"") + 500
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(salvage, FOUND)


WARC_SQL = """
WITH sized AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""


@query("op10_warc_salvage", WARC_SQL)
def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
