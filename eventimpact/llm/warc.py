"""WARC archives as seekable Zstandard bundles: independent frames, a footer seek table, frame-relative offsets."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, partitions, written

FRAME = 1 << 20           # uncompressed bytes after which a frame is closed
BUNDLE = 64 << 20         # compressed bytes after which a bundle is closed
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1   # fixed values of the public seekable format
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One WARC record. A revisit has no block; its header names the record it refers to and the payload's size."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(i))}>"
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}",
                 f"X-Payload-Length: {len(payload)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, block, end) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not at a record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    return fields, data[end + 4:end + 4 + n], end + 8 + n


class BundleWriter:
    """Frames of whole records; ``close`` appends the seek table as a skippable frame."""

    def __init__(self, stream, level: int = 3):
        import zstandard
        self.stream, self.zip = stream, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table, self.held, self.size, self.written = [], [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.size and self.size + len(data) > FRAME:
            self.flush()
        place = len(self.table), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.held))
            self.stream.write(packed)
            self.table.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class Bundle:
    """Random access by the seek table: only the asked frame is read and unpacked."""

    def __init__(self, uri: str):
        import zstandard
        fs, path = file_system(uri)
        self.file, self.zip = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {uri}")
        raw = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames = [struct.unpack_from("<II", raw, 8 * i) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.frames:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, i: int) -> bytes:
        packed, size = self.frames[i]
        return self.zip.decompress(self.file.read_at(packed, self.starts[i]), max_output_size=size)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def classify(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """Adds ``payload`` (UTF-8 of the html, null: empty), ``sha1``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``least`` bytes the smallest id is the response. Rows that repeat that id are
    responses too, and so is every row of a payload whose ids are all null; a null id is never the smallest.
    Payloads are compared by SHA-1 and length. Smallest ids are summed up before they are shuffled; the join back
    has one row a payload on its right side, so AQE can split a hot payload's rows.
    """
    new = ("payload", "sha1", "record_type", "refers_to", "__first")
    keep = [c for c in pages.columns if c.lower() not in new]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep]).withColumn("payload", F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    small = rows.select(id_col, "sha1", F.length("payload").alias("__len")).filter(F.col("__len") >= least)
    first = small.groupBy("sha1").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    joined = rows.join(first, "sha1", "left")
    again = F.col("__first").isNotNull() & ~F.coalesce(F.col(id_col) == F.col("__first"), F.lit(False))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")) \
        .withColumn("refers_to", F.when(again, F.col("__first"))).drop("__first")


def write_archive(records: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Writes one record per row of ``classify`` and returns the index: id, bundle, frame and offset in the frame.

    A task writes its rows to bundles of its own and holds one frame; only bundles in the index count, so a lost
    attempt leaves nothing behind that is read. A record longer than a frame is a frame of its own.
    """
    url = F.col(url_col) if url_col in records.columns else F.lit(None)
    src = records.select(F.col(id_col).cast("long").alias("id"), url.cast("string").alias("url"), "payload", "sha1",
                         "record_type", F.col("refers_to").cast("long").alias("refers_to"))

    def write(parts):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        out = stream = name = None
        rows = []

        def close():
            out.close()
            stream.close()
            got = pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())]))
            rows.clear()
            return got

        for b in parts:
            for r in b.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    stream = fs.open_output_stream(f"{path}/{name}", compression=None)
                    out = BundleWriter(stream)
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                frame, offset = out.add(record(r["record_type"], r["id"], r["url"], r["payload"], digest, r["refers_to"]))
                rows.append({"id": r["id"], "bundle": f"{folder}/{name}", "frame": frame, "offset": offset})
                if out.written > BUNDLE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(src.mapInArrow(write, "id long, bundle string, frame int, offset long"), "index")


def read_archive(index: DataFrame) -> DataFrame:
    """Every record of the index, read through the seek tables: id, ``record_type``, ``payload_bytes``,
    ``payload_digest``, ``refers_to`` and ``payload`` (null for revisits). A response's digest and size are those
    of the block read, and must agree with its header."""
    asked = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # a frame: 1 MB
    asked = asked.repartition(partitions(index.sparkSession), "bundle", "frame")
    schema = pa.schema([("id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    number = lambda s: int(s) if s else None

    def load(parts):
        held = {}
        for b in parts:
            for bundle, frame, offsets in zip(*(c.to_pylist() for c in b.columns)):
                if bundle not in held:
                    if len(held) > 16:
                        held.clear()
                    held[bundle] = Bundle(bundle)
                data, rows = held[bundle].frame(frame), []
                for at in offsets:
                    f, block, _ = parse(data, at)
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    row = {"id": number(f["X-Page-ID"]), "record_type": f["WARC-Type"], "payload_digest": digest,
                           "payload_bytes": int(f.get("X-Payload-Length") or len(block)), "refers_to": number(f.get("X-Refers-To-Page"))}
                    if row["record_type"] == "response":
                        if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                            raise ValueError(f"damaged record in {bundle}")
                        row["payload"] = block
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return asked.mapInArrow(load, "id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
