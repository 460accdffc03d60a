"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing: a page is an HTTP response whose body is framed in chunks. Of the pages with one payload, the one with the
largest page_id becomes a ``response``; the others become ``revisit`` records without body. A block longer than
``SEGMENT`` bytes is split: the first record has segment number 1, ``continuation`` records follow with the origin's
record id, the last one names the total length. Spark's text writer puts the records into compressed files, which keeps to
whatever file system the shared folder is on; segments and records per file bound the size of a file.

Reading: records are cut out by their content length. Continuations are grouped by origin, ordered by segment number,
joined and checked against the total length; then the chunked framing is decoded and the payload digest checked.
A revisit takes size and page of its payload from the response with the same digest.

* Null html is an empty payload. Null url: no target URI. A row without page_id is archived without one; if no page of
  its payload has an id, all of them are responses. Repeated rows are archived each; equal ids and payloads tie, and
  are all responses. Payloads under ``least`` bytes are always responses. Empty tables give an empty archive.
* Missing, repeated or wrongly sized segments and wrong digests raise an error with the record id.
* Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialloom.llm.words import slices
from trialloom.session import cut, shared_dir

SEGMENT = 16 << 10
FRAME = 4 << 10
RECORDS = 512
LEAST = 0
_DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = FRAME) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[at:at + size]), payload[at:at + size]) for at in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = stop + 2
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at:at + size])
        at += size + 2


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(key: str, page_id, url: str | None, payload: bytes, revisit: bool, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, each without the two line ends after it."""
    name = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(key.encode()).digest())}>"
    safe = None if url is None else "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    page = None if page_id is None else str(page_id)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", safe), ("X-Page-Id", page), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisit:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common,
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                         ("Content-Type", "application/http;msgtype=response")], head)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[at:at + segment] for at in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(pieces) == 1:
        return [_record(first, block)]
    records = [_record([*first, ("WARC-Segment-Number", "1")], pieces[0])]
    for number, piece in enumerate(pieces[1:], 2):
        own = uuid.UUID(bytes=hashlib.md5(f"{key}/{number}".encode()).digest())
        records.append(_record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", name),
            ("WARC-Segment-Number", str(number)),
            ("WARC-Segment-Total-Length", str(len(block)) if number == len(pieces) else None)], piece))
    return records


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, records: int = RECORDS, least: int = LEAST) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files below ``path``."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    body = F.unhex(F.sha1(F.col("html").cast("binary")))
    newest = pages.select("page_id", body.alias("_body")).groupBy("_body").agg(F.max("page_id").alias("_newest"))
    first = F.col("page_id").eqNullSafe(F.col("_newest")) | F.col("_newest").isNull() | (F.octet_length("html") < least)
    # the row's number in its task tells repeated rows apart; a task's files are kept or dropped as one
    ready = pages.withColumn("_body", body).join(newest, "_body").select(
        "page_id", "url", "html", (~first).alias("revisit"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            out = []
            for page_id, url, html, revisit, row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "row"))):
                out += page_records(f"{page_id}|{url}|{row}", page_id, url, html.encode("utf-8", "surrogatepass"), revisit, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (ready.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", _END).option("maxRecordsPerFile", records).option("compression", "gzip").text(path))


def parse(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record of a file, compressed or not."""
    data, at = bytes(content), 0
    if data.startswith(b"\x1f\x8b"):
        data = gzip.decompress(data)
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        begin = stop + 4
        size = int(fields["content-length"])
        if data[begin + size:begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} does not end where its length says")
        yield fields, data[begin:begin + size]
        at = begin + size + 4


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response: without headers, and without chunked framing if the headers name it."""
    head, _, body = block.partition(b"\r\n\r\n")
    names = [line.partition(b":") for line in head.lower().split(b"\r\n")[1:]]
    framed = any(n.strip() == b"transfer-encoding" and b"chunked" in v for n, _, v in names)
    return unchunked(body) if framed else body


_RECORDS = ("record_id string, origin string, number int, total long, kind string, page string, url string, digest string, "
            "size long, block binary, html string")


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record. Whole responses are decoded and checked at once; only segments keep their block."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [_row(fields, block, keep_payload) for fields, block in parse(content.as_buffer())]
                yield _batch(rows)

    return files.mapInArrow(run, _RECORDS)


def _row(fields: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    name, kind, number = fields["warc-record-id"], fields["warc-type"], fields.get("warc-segment-number")
    total, expected = fields.get("warc-segment-total-length"), (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    head = [name, fields.get("warc-segment-origin-id", name), int(number) if number else None, int(total) if total else None, kind,
            fields.get("x-page-id"), fields.get("warc-target-uri"), expected]
    if kind == "revisit":
        return (*head, None, None, None)
    if number:
        return (*head, None, block, None)
    payload = checked(name, block, expected)
    return (*head, len(payload), None, payload.decode("utf-8", "replace") if keep_payload else None)


def checked(name: str, block: bytes, expected: str | None) -> bytes:
    payload = payload_of(block)
    if expected and digest(payload) != expected:
        raise ValueError(f"record {name}: the payload has another digest")
    return payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(),
             pa.string()]
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)


def join_segments(name: str, numbers: list[int], blocks: list[bytes], total: int | None) -> bytes:
    """The block of a segmented record; its segments are 1 to n, and as long as the last one says."""
    if numbers != list(range(1, len(numbers) + 1)):
        raise ValueError(f"record {name}: segments {numbers}")
    block = b"".join(blocks)
    if total != len(block):
        raise ValueError(f"record {name}: {len(block)} bytes in its segments, {total} announced")
    return block


def reassemble(records: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Segmented records as whole ones, in the columns of ``records``."""
    parts = records.where("number IS NOT NULL").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max("page").alias("page"), F.max("url").alias("url"), F.max("digest").alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                block = join_segments(r["origin"], [p["number"] for p in r["parts"]], [p["block"] for p in r["parts"]], r["total"])
                payload = checked(r["origin"], block, r["digest"])
                yield _batch([(r["origin"], r["origin"], None, None, "response", r["page"], r["url"], r["digest"], len(payload), None,
                               payload.decode("utf-8", "replace") if keep_payload else None)])

    return parts.mapInArrow(run, _RECORDS)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to[, html]) for every page of the archives."""
    records = cut(read_records(spark, path, keep_payload))
    whole = records.where("number IS NULL").unionByName(reassemble(records, keep_payload))
    responses = whole.where("kind = 'response'")
    known = responses.groupBy(F.col("digest").alias("_digest")).agg(
        F.max("size").alias("_size"), F.max(F.col("page").cast("decimal(38,0)")).cast("string").alias("_page"))
    revisits = whole.where("kind = 'revisit'").join(known, F.col("digest") == F.col("_digest"), "left")
    columns = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["html"] * keep_payload
    return (responses.withColumns({"payload_bytes": F.col("size"), "refers_to": F.lit(None).cast("string")}).unionByName(
        revisits.withColumns({"payload_bytes": F.col("_size"), "refers_to": F.col("_page")}), allowMissingColumns=True)
        .withColumnsRenamed({"kind": "record_type", "digest": "payload_digest"}).select(*columns))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives, by default below the shared folder, and reads them back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
