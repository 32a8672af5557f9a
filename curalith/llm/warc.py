"""WARC archives written by Spark, their index, and coalesced byte-range reads.

A record's block is an HTTP response whose payload is the page. Records are built as text
columns and written by Spark's text writer, whose line separator is a record's closing blank
lines; so archives are plain WARC files that any file system of Spark holds. An index
(offset, length, URL and digest per record) is made and stored before anything is read
back; reads go by the index, sorted and coalesced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm.common import releasing, scratch_dir, stored

CLOSE = "\r\n\r\n"
#: Payloads below this size are always written whole.
REVISIT_BYTES = 100
#: Ranges closer than this are one read; no read is longer than the second figure (but for one record).
GAP, READ = 64 << 10, 8 << 20
#: The standard's name of a revisit by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
INDEX = "path string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())])


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, n, refers_to`` of pages whose payload an earlier page (smaller id) has.

    Digests are aggregated before the shuffle, so a payload that a third of all pages share
    is one row per task; the stored groups let Spark split such a key in the join.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    each = stored(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n")).where(F.col("n") >= REVISIT_BYTES), "digests")
    groups = stored(each.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1 and refers_to is not null").drop("k"), "payload-groups")
    return each.join(groups, ["digest", "n"]).where("page_id > refers_to").select("page_id", "digest", "n", "refers_to").distinct()


def _header(*lines) -> F.Column:
    return F.concat(*(x for name, value in lines for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))))


def write_archives(pages: DataFrame, path: str) -> None:
    """One WARC record per row of ``page_id, url, html`` under ``path``.

    Null html is an empty payload, a null URL an empty one; line breaks in a URL are
    escaped. Of equal payloads of at least :data:`REVISIT_BYTES` bytes the smallest page id
    is the response (all rows of that id and payload, if repeated); others are revisit records
    without payload. Rows of one id with other payloads are records of their own. A page whose
    id is null is always a response.
    """
    earlier = stored(revisits(pages), "revisits").select(*(F.col(c).alias(f"_{c}") for c in ("page_id", "digest", "n")), "refers_to")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n": F.octet_length("html").cast("long")})
    rows = own.join(earlier, [F.col(c) == F.col(f"_{c}") for c in ("page_id", "digest", "n")], "left")
    again, n = F.col("refers_to").isNotNull(), F.octet_length("html").cast("string")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _header(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", n)), F.lit("\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    common = _header(
        ("WARC-Type", F.when(again, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        ("WARC-Date", F.lit(_DATE)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    refers = F.when(again, _header(("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise("")
    record = F.concat(F.lit("WARC/1.1\r\n"), common, refers, F.lit("\r\n"), block)
    rows.select(record.alias("record")).write.option("lineSep", CLOSE).text(path)


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*(.*)\Z", re.S)


def _fields(head: bytes) -> dict[str, str]:
    found = (_FIELD.match(line) for line in head.split(b"\r\n")[1:])
    return {m[1].decode().lower(): m[2].decode() for m in found if m}


def _number(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """Header fields, HTTP fields, payload and length of the record at a place, closing lines included."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or data[at : at + 5] != b"WARC/":
        raise ValueError("no record begins here")
    fields = _fields(data[at:end])
    block, size = end + 4, int(fields["content-length"])
    if len(data) < block + size + 4:
        raise ValueError("a record is cut short")
    split = data.find(b"\r\n\r\n", block) + 4
    return fields, _fields(data[block : split - 4]), data[split : block + size], block + size + 4 - at


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``: see :data:`INDEX`."""

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data, at, rows = content.as_py(), 0, []
                while at < len(data):
                    fields, http, _, length = parse_record(data, at)
                    refers = fields.get("warc-refers-to")
                    rows.append((name, at, length, fields.get("warc-target-uri", ""), fields["warc-payload-digest"].removeprefix("sha256:"), _number(fields["warc-record-id"]), fields["warc-type"], _number(refers) if refers else None, int(http["content-length"])))
                    at += length
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _INDEX)], schema=_INDEX)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(work, INDEX)


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int]]:
    """Reads (offset, length, number of ranges) that cover sorted (offset, length) ranges."""
    out: list[list[int]] = []
    for offset, length in ranges:
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length - out[-1][0])
            out[-1][2] += 1
        else:
            out.append([offset, length, 1])
    return [(a, b, c) for a, b, c in out]


def _open(path: str):
    system, place = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(place)


def read_records(selected: DataFrame, with_payload: bool = False) -> DataFrame:
    """The selected rows of an index, read back by byte ranges.

    Gives ``page_id, payload_bytes, payload_digest, record_type, refers_to`` (and
    ``payload``; null for a revisit). The digest of a payload is computed anew and must
    equal the index's. Rows of one archive, whose size is bounded by the writer's task, are
    read by one task in order of their offsets.
    """
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)

    def read(path: str, rows: list[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
        k = 0
        with _open(path) as file:
            for offset, length, count in coalesced([(a, b) for a, b, _ in rows]):
                data, out = file.read_at(length, offset), []
                for at, size, digest in rows[k : k + count]:
                    head, http, payload, _ = parse_record(data[at - offset : at - offset + size])
                    again = head["warc-type"] == "revisit"
                    if (head["warc-payload-digest"] if again else "sha256:" + hashlib.sha256(payload).hexdigest()) != f"sha256:{digest}":
                        raise ValueError(f"digest of the record at {at} of {path} does not hold")
                    refers = head.get("warc-refers-to")
                    n = int(http["content-length"]) if again else len(payload)
                    row = (_number(head["warc-record-id"]), n, digest, head["warc-type"], _number(refers) if refers else None)
                    out.append(row + ((None if again else payload),) * with_payload)
                k += count
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    @releasing
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, []
        for batch in batches:
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length", "digest"))):
                if name != path:
                    if held:
                        yield from read(path, held)
                    path, held = name, []
                held.append(tuple(row))
        if held:
            yield from read(path, held)

    rows = selected.select("path", "offset", "length", "digest").repartition("path").sortWithinPartitions("path", "offset")
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return rows.mapInArrow(work, out)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to the shared folder, indexes them, and reads every record back by the index.

    A row per row of ``pages``, repeated ones included: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``. Null html is an empty payload, which is always a
    response; a null id stays null. Payloads of any length are whole records. Ties of equal
    payloads go to the smallest id. Further columns are ignored; an empty table gives an
    empty table.
    """
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_archives(pages, path)
    return read_records(stored(index(spark, path), "warc-index"))
