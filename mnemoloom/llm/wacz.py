"""WARC records in ZIP-packaged archives: written once, then read by ranges.

An archive is a ZIP file with two stored members, `archive/data.warc.gz` (every record a gzip member
of its own) and `indexes/index.cdxj` (a line per record with its place). The reader takes the end of
the file, finds the central directory there, by the ZIP64 records where the classic ones are full,
and from it the places of the members; it reads the index, and then runs of neighbouring records,
each run with one range read. Nothing is unpacked to disk.

Archives live in the folder that the session names for shared data, reached through Arrow's file
systems, and a task's archive counts only once its row of the list of archives is committed: a task
that runs twice leaves an unlisted file behind and no record twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, stored

# Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
# Bytes of neighbouring records that one range read takes.
RUN_BYTES = 1 << 20
# Bytes of archives that one reading task takes.
TASK_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there. A path without a scheme is local."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


# Records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of another page's response, as one WARC record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(data: bytes) -> dict:
    """Page, type, payload (of a response), its full size and digest, and the page that a revisit refers to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", warc.get(name, ""))) else None
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    out = {"page_id": page("warc-record-id"), "record_type": warc["warc-type"], "refers_to": page("warc-refers-to"), "payload_digest": digest}
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(_fields(http)["content-length"])}
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {out['page_id']} does not have its digest")
    return out | {"payload": payload, "payload_bytes": len(payload)}


# Archives


class ArchiveWriter:
    """Writes records into the data member as they come, and the index after them. The output need not be seekable."""

    def __init__(self, out):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, refers_to), 6, mtime=0)
        self.data.write(packed)
        self.lines.append(json.dumps({"page": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("\n".join(self.lines).encode())
        self.zip.close()


def central_directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Stored members of a ZIP file: place of the local header, size, and CRC. `read(offset, n)` reads a range."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    # A comment may hold the signature: the real record's comment ends the file.
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator_at = tail_at + end - 20
        locator = read(locator_at, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    directory, at, members = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        crc, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", directory, at + 16)
        local, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                # Of the ZIP64 values only those are there whose classic field is full, in this order.
                at_value = k + 4
                wide = []
                for value in (plain, packed, local):
                    if value == 0xFFFFFFFF:
                        value, = struct.unpack_from("<Q", extra, at_value)
                        at_value += 8
                    wide.append(value)
                plain, packed, local = wide
            k += 4 + n
        if method == 0 and packed == plain:
            members[name] = (local, plain, crc)
        at += 46 + n_name + n_extra + n_comment
    return members


def member_start(read, local: int) -> int:
    """First byte of a member's data: behind its local header, whose name and extra fields have lengths of their own."""
    header = read(local, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    return local + 30 + sum(struct.unpack_from("<HH", header, 26))


def read_index(read, size: int) -> tuple[int, list[dict]]:
    """Where the data member begins, and the lines of the index."""
    members = central_directory(read, size)
    local, length, _ = members[INDEX]
    text = read(member_start(read, local), length).decode()
    return member_start(read, members[DATA][0]), [json.loads(line) for line in text.split("\n") if line]


# Tables


def roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(`id`, `digest`, `refers_to`) of the pages that are revisits: same payload of `least` bytes or more as a larger id."""
    told = pages.select("id", "digest").filter(F.col("size") >= least)
    first = told.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return told.join(first, "digest").filter("id <> refers_to").select("id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record for every row and lists the archives: `path` and `records`.

    The payload is the text in UTF-8, null is empty. A null key is written, but neither refers to
    another page nor is referred to. Rows with the same key and payload are the same page and get
    the same record each. Other columns are not written.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "archives")
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"), text.alias("text"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("size"))
    rows = rows.join(roles(rows), ["id", "digest"], "left").select("id", "url", "text", "refers_to")

    def run(batches):
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}.wacz"
        writer = out = None
        count = 0
        for batch in batches:
            if batch.num_rows and writer is None:
                out = files.open_output_stream(path)
                writer = ArchiveWriter(out)
            ids, urls, texts, refers = batch.columns
            for i in range(batch.num_rows):
                writer.add(ids[i].as_py(), urls[i].as_py(), texts[i].as_py().encode(), refers[i].as_py())
            count += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([count], pa.int64())], names=["path", "records"])

    return stored(rows.mapInArrow(run, "path string, records bigint"))


def _reader(path: str):
    folder, name = path.rsplit("/", 1)
    files, root = open_folder(folder)
    source = files.open_input_file(f"{root}/{name}")
    return (lambda offset, n: source.read_at(n, offset)), source.size()


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """`page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to` and, if asked for, `payload` of every record.

    Size and digest are those of the full payload. A revisit has no payload of its own. A response
    whose payload does not have the digest of its header is an error.
    """

    def runs(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                read, size = _reader(path)
                start, lines = read_index(read, size)
                ends = np.cumsum([x["length"] for x in lines], dtype=np.int64)
                cut = np.searchsorted(ends, np.arange(0, int(ends[-1]) + RUN_BYTES, RUN_BYTES)) if len(lines) else []
                cut = sorted({*map(int, cut), len(lines)})
                for a, b in zip(cut, cut[1:]):
                    lengths = [x["length"] for x in lines[a:b]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([start + lines[a]["offset"]], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], names=["path", "at", "lengths"]
                    )

    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    if payloads:
        kinds = kinds.append(pa.field("payload", pa.binary()))

    def records(batches):
        for batch in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                read, _ = _reader(path)
                data, k, found = read(at, sum(lengths)), 0, []
                for n in lengths:
                    found.append(parse_record(gzip.decompress(data[k : k + n])))
                    k += n
                yield pa.RecordBatch.from_pylist(found, schema=kinds)

    listed = stored(archives.select("path").mapInArrow(runs, "path string, at bigint, lengths array<bigint>"))
    # Ranges are small and what they stand for is not, so the number of tasks follows the archives' bytes.
    size = listed.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, n: s + n))).first()[0] or 0
    spread = listed.repartition(-(-size // TASK_BYTES) or 1, F.col("path"), F.col("at"))
    out = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return spread.mapInArrow(records, out + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of all pages, written to archives and read back from them."""
    return read_archives(write_archives(pages), payloads=False)
