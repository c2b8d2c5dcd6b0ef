"""WARC records in ZIP packages, written by tasks and read back by range.

A package is a ZIP file with two stored (uncompressed) members: `archive/data.warc.gz`, one gzip
member per record, and `indexes/index.cdxj`, one JSON line per record with its offset and length in
that archive. A reader needs no extraction: it reads the end of the file, the ZIP64 records if there
are any, the central directory and the local headers, then the index, then the byte ranges of records.

Payloads are stored once: of pages with equal payloads of at least `MIN_SHARED` bytes, that with the
smallest page_id becomes a `response` record and the others `revisit` records that name it; smaller
payloads are always responses. The rows that decide this are digests, counted map-side.

Defined cases: null html is the empty payload; a null page_id is written without the page header and
reads back as null, and refers_to is null when no page of the group has an id. Pages that repeat the
smallest page_id are responses too. Null url: no target header. Line breaks and control characters in
a url are percent-encoded. An empty table gives no package. A compressed or encrypted archive member
is an error, since no range of it can be read. Files of failed task attempts are not in the manifest
and are never read.
"""
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm.shared import join_counted, new_folder, text_of, written

MIN_SHARED = 100
PACKAGE_BYTES = 64 << 20
CAPTURED = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# ---------------------------------------------------------------- records

def _record_id(page_id, digest):
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def _header_value(text):
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace"))
                   for c in text)


def record_bytes(page_id, url, payload, size, digest, first_id):
    """One WARC record; a revisit of the page `first_id` when `payload` is None."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}",
             f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {CAPTURED}",
             f"WARC-Payload-Digest: sha256:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if payload is None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_record_id(first_id, digest)}")
        if first_id is not None:
            lines.append(f"WARC-Refers-To-Page-ID: {first_id}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(block):
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def parse_record(data):
    """Headers, HTTP headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


# ---------------------------------------------------------------- ZIP directories

def _zip64(extra, wanted):
    """Values of the ZIP64 extra field for the `wanted` 32-bit fields that are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = struct.unpack_from(f"<{size // 8}Q", extra, at + 4)
            return dict(zip(wanted, values))
        at += 4 + size
    raise ValueError("ZIP64 extra field is missing")


def read_directory(read, size):
    """name -> (offset of the data, length) of the stored members; `read(offset, length)` gives bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator is missing")
        (at,) = struct.unpack_from("<Q", locator, 8)
        count, length, start = struct.unpack_from("<QQQ", read(at, 56), 32)
    directory, at, members = read(start, length), 0, {}
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full = struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, at + 28)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode("utf-8")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        wide = [k for k, v in (("full", full), ("packed", packed), ("header", header)) if v == 0xFFFFFFFF]
        if wide:
            found = _zip64(extra, wide)
            packed, header = found.get("packed", packed), found.get("header", header)
        at += 46 + n_name + n_extra + n_note
        if name.startswith(("archive/", "indexes/")) and not name.endswith("/"):
            if method != 0 or flags & 1:
                raise ValueError(f"member {name} is not stored, so no range of it can be read")
            local = read(header, 30)
            n_local, n_more = struct.unpack_from("<HH", local, 26)
            members[name] = (header + 30 + n_local + n_more, packed)
    return members


# ---------------------------------------------------------------- packages

def _file_system(uri):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


class _Package:
    """Collects records up to a package's size in memory, then writes the file in one go."""

    def __init__(self, folder):
        self.folder, self.data, self.index = folder, io.BytesIO(), []

    def add(self, record, entry):
        packed = gzip.compress(record, 3, mtime=0)
        self.index.append(json.dumps(entry | {"offset": self.data.tell(), "length": len(packed)}))
        self.data.write(packed)

    def write(self):
        import zipfile
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_STORED) as out:
            for name, content in ((ARCHIVE, self.data.getbuffer()), (INDEX, "\n".join(self.index).encode())):
                with out.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                    member.write(content)
        system, folder = _file_system(self.folder)
        path = f"{folder}/{uuid.uuid4().hex}.wacz"
        with system.open_output_stream(path) as out:
            out.write(body.getbuffer())
        return path.rsplit("/", 1)[1], body.tell(), len(self.index)


def decide_records(pages):
    """`pages` with payload (binary), payload_bytes, digest and first_id: the page to be referred to,
    null where the record is a response."""
    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    rows = rows.select("page_id", "url", "html", F.octet_length("html").cast("long").alias("payload_bytes"),
                       F.sha2("html", 256).alias("digest"))
    large = F.col("payload_bytes") >= MIN_SHARED
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"),
                                                     F.count(F.lit(1)).alias("n")).where("n > 1")
    # What many pages share is known before anything is shuffled: their copies go on without payload.
    joined = join_counted(
        rows, written(firsts, "repeated-payloads"), ["digest"], "n", ["page_id"],
        between=lambda df: df.withColumn("html", F.when(
            F.col("_heavy").isNull() | F.col("_heavy_first_id").eqNullSafe(F.col("page_id")), F.col("html"))))
    is_first = F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "payload_bytes", "digest",
        F.when(~is_first, F.col("first_id")).alias("first_id"),
        F.when(is_first | F.col("first_id").isNull(), F.encode("html", "UTF-8")).alias("payload"))


def write_packages(pages, folder, package_bytes=PACKAGE_BYTES):
    """Write the records of `pages` below `folder`; returns the manifest: file, bytes, records."""
    def pack(batches):
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        package, done = _Package(folder), []
        for batch in batches:
            columns = [batch.column(c) for c in
                       ("page_id", "url", "payload", "payload_bytes", "digest", "first_id")]
            for values in zip(*columns):
                page_id, url, payload, size, digest, first_id = (v.as_py() for v in values)
                package.add(record_bytes(page_id, url, payload, size, digest, first_id),
                            {"page_id": page_id, "digest": digest})
                if package.data.tell() >= package_bytes:
                    done.append(package.write())
                    package = _Package(folder)
        if package.index:
            done.append(package.write())
        if done:
            names, sizes, counts = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                ["file", "bytes", "records"])

    manifest = decide_records(pages).mapInArrow(pack, "file string, bytes long, records long")
    return written(manifest, "warc-manifest")


def _reader(source):
    def read(offset, length):
        source.seek(offset)
        data = source.read(length)
        if len(data) != length:
            raise ValueError("package is shorter than its directory says")
        return data
    return read


def read_packages(manifest, folder, merge_bytes=1 << 20):
    """A row per record: page_id, url, record_type, payload (null for a revisit), payload_bytes,
    payload_digest, refers_to. Neighbouring ranges are fetched together, up to `merge_bytes`."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def rows_of(read, at, entries):
        data = read(at + entries[0]["offset"], entries[-1]["offset"] + entries[-1]["length"] - entries[0]["offset"])
        for e in entries:
            start = e["offset"] - entries[0]["offset"]
            fields, http, payload = parse_record(zlib.decompress(data[start:start + e["length"]], 31))
            said = fields["warc-payload-digest"].removeprefix("sha256:")
            revisit = fields["warc-type"] == "revisit"
            if not revisit and hashlib.sha256(payload).hexdigest() != said:
                raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
            page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
            yield (page and int(page), fields.get("warc-target-uri"), fields["warc-type"],
                   None if revisit else payload,
                   int(http["content-length"]) if revisit else len(payload), said, refers and int(refers))

    def unpack(batches):
        system, path = _file_system(folder)
        for batch in batches:
            for name, size in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist()):
                with system.open_input_file(f"{path}/{name}") as source:
                    read = _reader(source)
                    members = read_directory(read, size)
                    lines = read(*members[INDEX]).decode().split("\n")
                    at, entries = members[ARCHIVE][0], []
                    for line in [*lines, None]:
                        if line is not None:
                            entries.append(json.loads(line))
                        full = entries and entries[-1]["offset"] + entries[-1]["length"] - entries[0]["offset"] >= merge_bytes
                        if entries and (line is None or full):
                            got = list(zip(*rows_of(read, at, entries)))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, f.type) for c, f in zip(got, schema)], schema=schema)
                            entries = []

    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "file")
    return spread.mapInArrow(unpack, "page_id long, url string, record_type string, payload binary, "
                                     "payload_bytes long, payload_digest string, refers_to long")


def archive_round_trip(pages):
    """Write `pages` into new packages and read every record back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder), folder)
