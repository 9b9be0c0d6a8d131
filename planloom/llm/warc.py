"""WARC archives, index first: records are written with an index row each (file, offset, length, URL,
digest); reads select index rows and fetch their byte ranges, neighbours in one read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, packs, shared_dir, written

RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest())}>"


def one_line(text: str) -> str:
    """A header value: control characters and spaces at its ends percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit holds no payload; its length and digest are in its header."""
    block = HTTP_HEAD + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {REVISIT if revisit else RESPONSE}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("the record is cut short")
    return fields, rest[:size]


MOST_TASKS = 100_000
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 1000, roll: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a gzip-member record per row of pages(page_id, url, html); returns the index, which is
    itself written to the shared folder.

    Of rows with equal payloads of at least `least` bytes, those with the largest page_id become the
    response and the others revisits of it; all others are responses. So repeated rows of that
    largest id are all responses, a null id revisits any other, and among null ids alone all are
    responses. A null html is an empty payload. A task that is run again writes a new file; only files
    that the index names count.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    text = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("html"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    # rows too small to be copies get keys of their own, so that no key gathers them
    key = F.when(F.col("bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("digest"))))
    rows = rows.withColumn("key", key)
    # written, so that the join deals both sides itself and can split a payload that very many pages share
    tops = written(rows.where(F.col("bytes") >= least).groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top"))
    typed = rows.join(tops, "key", "left").select("page_id", "url", "html", "digest", F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        out, name, at = None, "", 0
        for b in packs(batches, "html", 8 << 20):
            index = []
            for page_id, url, html, digest, refers in zip(*(col(b, c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None or at > roll:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                raw = gzip.compress(record(page_id, url, payload, digest, refers, refers is not None, date), 6, mtime=0)
                out.write(raw)
                index.append((page_id, url, digest, len(payload), REVISIT if refers is not None else RESPONSE, refers, f"{folder}/{name}", at, len(raw)))
                at += len(raw)
            columns = list(zip(*index, strict=True))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    return written(typed.mapInArrow(write, INDEX))


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, block: int = 8 << 20, payloads: bool = False) -> DataFrame:
    """Per selected index row: page_id, payload_bytes, payload_digest, record_type and refers_to, as
    the record itself has them (and html for responses, if `payloads`).

    Rows are dealt by file and block of the file, over as many tasks as the records' own bytes (not
    those of their short index rows) make blocks, and sorted by offset; ranges less than `gap` bytes
    apart are fetched by one read of at most `most` bytes (a longer record is a read of its own).
    A payload that does not fit its digest raises an error.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + (["html"] if payloads else [])
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", html string" if payloads else "")
    blocks = index.select(F.countDistinct("file", F.floor(F.col("offset") / block))).first()[0]
    tasks = min(max(1, blocks), MOST_TASKS)
    picked = index.select("file", "offset", "length").withColumn("block", F.floor(F.col("offset") / block)).repartition(tasks, "file", "block").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def number(fields: dict[str, str], name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, opened = None, None
        for b in batches:
            ranges = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            lo = 0
            while lo < len(ranges):
                file, begin, size = ranges[lo]
                end, hi = begin + size, lo + 1
                while hi < len(ranges) and ranges[hi][0] == file and ranges[hi][1] <= end + gap and ranges[hi][1] + ranges[hi][2] - begin <= most:
                    end, hi = max(end, ranges[hi][1] + ranges[hi][2]), hi + 1
                if file != opened:
                    if stream:
                        stream.close()
                    system, path = file_system(file)
                    stream, opened = system.open_input_file(path), file
                raw = stream.read_at(end - begin, begin)
                rows = []
                for _, at, size in ranges[lo:hi]:
                    fields, body = parse(gzip.decompress(raw[at - begin : at - begin + size]))
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    payload = body.partition(b"\r\n\r\n")[2]
                    kind = fields["warc-type"]
                    if kind == RESPONSE and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file}: the payload at {at} does not fit its digest")
                    row = (number(fields, "x-page-id"), number(fields, "x-payload-length"), digest, kind, number(fields, "x-refers-to-page-id"))
                    rows.append(row + ((payload.decode("utf-8", "surrogatepass") if kind == RESPONSE else None,) if payloads else ()))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
                lo = hi
        if stream:
            stream.close()

    return picked.mapInArrow(read, schema)
