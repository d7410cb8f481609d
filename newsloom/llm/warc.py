"""WARC records in seekable Zstandard bundles.

Every task writes its records to bundles of a bounded size. Records are grouped into independent Zstandard
frames; a skippable frame at the end holds the seek table (compressed and decompressed size of each frame), so
any frame is found from the footer alone. The index maps a record to (bundle, frame, offset in the frame).

Bundle names are unique per task attempt and the index is written by Spark's committer: an attempt that was
lost leaves files that no index row names.

Defined results: null html is the empty payload. Of equal payloads of at least ``least`` bytes the smallest
``page_id`` is the response and the others are revisits that refer to it; a null id is larger than any, and
repeated rows of the smallest id are all responses. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, text_chunks
from newsloom.skew import keyed_lookup

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, FOOTER_BYTES = 0x184D2A5E, 0x8F92EAB1, 9

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 32 << 20
#: Frames that a task reads back on average, and the bytes of a bundle whose frames stay together.
FRAMES_PER_TASK, RUN_BYTES = 32, 2 << 20
#: Records of one payload above which they are spread over several tasks.
HOT_ROWS = 20_000
DATE = "1970-01-01T00:00:00Z"
INDEX = (
    "page_id bigint, record_id string, record_type string, refers_to bigint, bundle string, frame int, "
    "frame_start bigint, frame_bytes bigint, record_start bigint, record_bytes bigint"
)
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(record: str) -> int | None:
    number = record.rpartition(":")[2]
    return int(number) if number else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(page_id)}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Refers-To", f"<{record_id(refers_to)}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at`` and the place after it; its digests are checked."""
    head_end = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:head_end].decode().split("\r\n")[1:])
    start, length = head_end + 4, int(fields["Content-Length"])
    block = data[start : start + length]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}" or kind == "response" and digest != digest_of(payload):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": page_of(fields["WARC-Record-ID"][1:-1]), "url": fields["WARC-Target-URI"], "record_type": kind,
        "refers_to": page_of(refers[1:-1]) if refers else None, "payload_bytes": int(http.rpartition(b": ")[2]), "payload_digest": digest,
        "payload": payload,
    }, start + length + 4


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, folder: str, frame_bytes: int):
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.uri, self.out = f"{folder}/{name}", fs.open_output_stream(f"{path}/{name}", compression=None)
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=3)
        self.sizes: list[tuple[int, int]] = []
        self.start = self.written = 0
        self._new_frame()

    def _new_frame(self) -> None:
        self.buffer, self.waiting = bytearray(), []

    def add(self, record: bytes, row: dict) -> list[dict]:
        """Index rows of the frame that this record completes, if it does."""
        row |= {"bundle": self.uri, "frame": len(self.sizes), "record_start": len(self.buffer), "record_bytes": len(record)}
        self.waiting.append(row)
        self.buffer += record
        self.written += len(record)
        return self.flush() if len(self.buffer) >= self.frame_bytes else []

    def flush(self) -> list[dict]:
        if not self.buffer:
            return []
        data = self.zstd.compress(bytes(self.buffer))
        self.out.write(data)
        rows = [r | {"frame_start": self.start, "frame_bytes": len(data)} for r in self.waiting]
        self.sizes.append((len(data), len(self.buffer)))
        self.start += len(data)
        self._new_frame()
        return rows

    def close(self) -> list[dict]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + FOOTER_BYTES) + table + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC))
        self.out.close()
        return rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer of an open bundle."""
    size = file.size()
    file.seek(size - FOOTER_BYTES)
    frames, descriptor, magic = struct.unpack("<IBI", file.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if descriptor & 128 else 8
    file.seek(size - FOOTER_BYTES - frames * entry)
    table, out, start = file.read(frames * entry), [], 0
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", table, i * entry)
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(file, start: int, packed: int, plain: int) -> bytes:
    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, bundle, done = _arrow(INDEX), None, []
        for batch in text_chunks(batches, "payload"):  # few rows at a time become Python objects
            for row in batch.to_pylist():
                bundle = bundle or BundleWriter(folder, frame_bytes)
                entry = {"page_id": row["page_id"], "record_id": record_id(row["page_id"]), "record_type": row["kind"], "refers_to": row["refers_to"]}
                done += bundle.add(warc_record(row["page_id"], row["url"], row["payload"], row["kind"], row["refers_to"]), entry)
                if bundle.written >= bundle_bytes:
                    done, bundle = done + bundle.close(), None
            if done:
                yield _batch(done, schema)
                done = []
        if bundle:
            yield _batch(bundle.close(), schema)

    return run


def write_archive(pages: DataFrame, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one record per page; return the index table (see ``INDEX``)."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("same", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("first is not null")
    revisit = F.col("first").isNotNull() & (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    # Pages that many records share (empty or default ones) are spread over several tasks.
    typed = keyed_lookup(rows, first, ["same"], "page_id", weight="n", hot_rows=HOT_ROWS).select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to")
    )
    return scratch.cut(typed.mapInArrow(_write(scratch.path("bundles"), frame_bytes, bundle_bytes), INDEX), "index")


def read_archive(index: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the bundles that ``index`` names, read through their seek tables; digests are checked."""
    ddl = RECORD + (", payload binary" if payloads else "")
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted: dict[str, set[int]] = {}
            for row in batch.to_pylist():
                wanted.setdefault(row["bundle"], set()).add(row["frame_start"])
            for uri, starts in wanted.items():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as file:
                    frames = [f for f in seek_table(file) if f[0] in starts]
                    if len(frames) < len(starts):
                        raise ValueError(f"{uri}: frames of the index are not in the seek table")
                    for start, packed, plain in frames:
                        data, at, found = read_frame(file, start, packed, plain), 0, []
                        while at < len(data):
                            record, at = parse_record(data, at)
                            found.append(record)
                        yield _batch([{n: r[n] for n in schema.names} for r in found], schema)

    # Runs of neighbouring frames are dealt out, not whole bundles: their number follows the archive.
    frames = index.groupBy("bundle", "frame_start").agg(F.count(F.lit(1)).alias("n"))
    tasks = 1 + frames.count() // FRAMES_PER_TASK
    run_of = F.floor(F.col("frame_start") / RUN_BYTES)
    return frames.repartition(tasks, "bundle", run_of).select("bundle", "frame_start").mapInArrow(run, ddl)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the ids in ``wanted`` (page_id), each read alone from its frame, with payload."""
    ddl = RECORD + ", payload binary"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["bundle"])
                with fs.open_input_file(path) as file:
                    file.seek(row["frame_start"])
                    data = zstandard.ZstdDecompressor().decompress(file.read(row["frame_bytes"]))
                found.append({n: v for n, v in parse_record(data, row["record_start"])[0].items() if n in schema.names})
            yield _batch(found, schema)

    places = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    return places.select("bundle", "frame_start", "frame_bytes", "record_start").mapInArrow(run, ddl)
