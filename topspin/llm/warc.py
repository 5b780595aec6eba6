"""Web archives in seekable Zstandard bundles (operator 8).

Records are gathered into independent Zstandard frames and frames into bundles. A bundle ends with the seek table of the
Zstandard seekable format (a skippable frame that lists the compressed and plain size of each frame), so a frame is found
without reading what stands before it. The index maps each record to its bundle, its frame and its place in the frame.

Of records with equal payloads the one with the smallest id is a response; the others revisit it and carry no payload.
Tasks write their bundles straight into the folder, under names that no other attempt uses, and then return their part of the
index; a failed attempt leaves a bundle behind that no index knows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topspin.llm.shared import by_bytes, materialise, shared_dir

#: Plain bytes after which a frame and a bundle are closed.
FRAME_BYTES, BUNDLE_BYTES = 512 << 10, 64 << 20
#: Payloads below this are never replaced by revisits.
LEAST_BYTES = 100
#: Magic numbers of the Zstandard seekable format. Fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-page:(.*)>")
#: Characters that stay as they are in target addresses, and the field for an address that holds escapes itself.
_URI, _AS_GIVEN = ":/?#[]@!$&'()*+,;=%~", "X-Target-As-Given"
INDEX = "record_id string, bundle string, frame int, at long, length long"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record(page_id: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC 1.1 record; a revisit has the payload's size and digest, but not the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload or b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{quote(page_id, safe='')}>", f"WARC-Date: {date}"]
    if url is not None:
        target = quote(url, safe=_URI)
        head.append(f"WARC-Target-URI: {target}")
        if unquote(target) != url:  # with escapes of its own
            head.append(f"{_AS_GIVEN}: {quote(url, safe='')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{quote(refers_to, safe='')}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The parts of one record: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest`` and ``payload``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    page = lambda name: unquote(_ID.match(fields[name])[1])
    refers_to = page("WARC-Refers-To") if kind == "revisit" else None
    url = fields.get(_AS_GIVEN, fields.get("WARC-Target-URI"))
    return {"page_id": page("WARC-Record-ID"), "url": None if url is None else unquote(url), "record_type": kind, "refers_to": refers_to, "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


class BundleWriter:
    """Writes records to a bundle; ``close`` adds the seek table."""

    def __init__(self, uri: str, level: int = 3):
        system, path = file_system(uri)
        self.uri, self.plain = uri, 0
        self._file = system.open_output_stream(path, compression=None)
        self._coder = zstandard.ZstdCompressor(level=level)
        self._sizes: list[tuple[int, int]] = []
        self._frame = bytearray()

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, place in the frame, and length."""
        if self._frame and len(self._frame) + len(data) > FRAME_BYTES:
            self._flush()
        at = len(self._frame)
        self._frame += data
        self.plain += len(data)
        return len(self._sizes), at, len(data)

    def _flush(self) -> None:
        done = self._coder.compress(bytes(self._frame))
        self._file.write(done)
        self._sizes.append((len(done), len(self._frame)))
        self._frame = bytearray()

    def close(self) -> None:
        if self._frame:
            self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, SEEKABLE)
        self._file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self._file.close()


class BundleReader:
    """Reads single frames of a bundle."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self._file = system.open_input_file(path)
        end = self._file.size()
        count, _, magic = struct.unpack("<IBI", self._file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self._file.read_at(8 * count, end - 9 - 8 * count)
        self._places, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self._places.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self._places[k]
        return zstandard.ZstdDecompressor().decompress(self._file.read_at(packed, at), max_output_size=plain)


@functools.lru_cache(1)
def _reader(uri: str) -> BundleReader:
    return BundleReader(uri)


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` below ``folder`` and return the index ``(record_id, bundle, frame, at, length)``.

    The job runs here, once. A null page has an empty payload, a null URL no target; ids are written as text, a null one as
    empty text. Rows that share id and payload are all responses (or all revisit the same one). Digests travel without the
    pages to find equal payloads; the pages themselves are shuffled once, by their id.
    """
    rows = pages.select(F.col(id_column).alias("key"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    marks = rows.select("key", "digest", "size").distinct()
    first = marks.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("key").alias("first"))
    marks = marks.join(first, "digest", "left").select(F.col("key").alias("own_key"), F.col("digest").alias("own_digest"), F.when(F.coalesce(F.col("key") > F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))
    same = F.col("key").eqNullSafe(F.col("own_key")) & (F.col("digest") == F.col("own_digest"))
    plan = rows.join(marks, same).select(F.col("key").cast("string").alias("id"), "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "digest", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, index = None, []

        def done() -> pa.RecordBatch:
            bundle.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["record_id", "bundle", "frame", "at", "length"])

        for batch in by_bytes(batches, "html"):
            for page_id, url, text, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                place = bundle.add(record(page_id or "", url, text and text.encode("utf-8", "replace"), size, digest, refers_to, date))
                index.append((page_id or "", bundle.uri, *place))
                if bundle.plain >= BUNDLE_BYTES:
                    yield done()
                    bundle, index = None, []
        if bundle is not None:
            yield done()

    return materialise(plan.mapInArrow(run, INDEX))


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` lists: ``(page_id string, url, record_type, refers_to string, payload_bytes, payload_digest, payload)``.

    Any part of an index will do. Each frame is read and unpacked once for neighbouring rows; digests of responses are checked.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, data = None, b""
        for batch in batches:
            out, size = [], 0
            for bundle, frame, at, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "at", "length")), strict=True):
                if held != (bundle, frame):
                    held, data = (bundle, frame), _reader(bundle).frame(frame)
                found = parse(data[at : at + length])
                if not payloads:
                    found["payload"] = None
                out.append(found)
                size += len(found["payload"] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names=names)
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names=names)

    return index.select("bundle", "frame", "at", "length").mapInArrow(run, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for bundles below the application's folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/topspin/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    return folder
