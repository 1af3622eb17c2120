"""WARC records in seekable Zstandard bundles.

A bundle is a valid .warc.zst file: records lie in independent Zstandard frames of about
FRAME bytes, and a skippable frame at the end holds a seek table, the compressed and plain
size of every frame, as the public seekable format lays it out. Beside the bytes a bundle
keeps its index: for each record its identifier, its frame and its place within the plain
frame. One record is thus read by decompressing one frame.

Bundles are rows of a Parquet table (BUNDLE bytes of plain text each, or one record if that
is longer), so Spark commits them and lost executors' tasks simply run again; `export` writes
the same bytes as files. Of records with equal payloads of at least REVISIT bytes the one with
the smallest id is a response and the others are revisits, which carry no payload; a record
with a null id is never that one unless all are null.
"""

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdframe.llm.common import tidied, written

#: Plain bytes of a frame and of a bundle, Zstandard's level, and the smallest payload that is worth a revisit.
FRAME, BUNDLE, LEVEL, REVISIT = 256 << 10, 16 << 20, 3, 100
#: Repeated digests that every task may hold, of about 100 bytes each.
HELD = 200_000
#: Fixed values of the seekable format: magic numbers of skippable frames and of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_HEAD = b"WARC/1.1\r\n"
_INDEX = "bundle string, archive binary, ids array<long>, frames array<int>, offsets array<long>, lengths array<long>"
_RECORD = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(records: DataFrame) -> DataFrame:
    """Adds digest and refers_to to (id, url, payload binary).

    Only (digest, id) are grouped, with partial sums first, so copies may be any share of the
    records. The table of repeated digests is written and counted: up to HELD of them go to every
    task and no payload moves; beyond that payloads meet one row a digest in a join whose
    skewed partitions Spark splits.
    """
    marked = records.withColumn("digest", F.sha2("payload", 256))
    firsts = marked.where(F.octet_length("payload") >= REVISIT).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    firsts = written(firsts.where("copies > 1").select(F.col("digest").alias("of"), "first_id"), "digests")
    firsts = F.broadcast(firsts) if firsts.count() <= HELD else firsts.hint("shuffle_hash")
    joined = marked.join(firsts, F.col("digest") == F.col("of"), "left")
    later = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select("id", "url", "payload", "digest", F.when(later, F.col("first_id")).alias("refers_to"))


def _key(record_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'record {record_id}'.encode()).hexdigest())}>"


def record_bytes(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_key(record_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if record_id is not None:
        head.append(f"X-Record-Number: {record_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_key(refers_to)}", f"X-Refers-To-Number: {refers_to}"]
    return _HEAD + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record; of a revisit the payload is null, its length and digest those of the response's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(_HEAD):
        raise ValueError("no WARC record starts here")
    fields = dict(x.split(": ", 1) for x in head[len(_HEAD) :].decode().split("\r\n"))
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    long = int(http.rpartition(b"Content-Length: ")[2])
    number, refers = fields.get("X-Record-Number"), fields.get("X-Refers-To-Number")
    response = fields["WARC-Type"] == "response"
    digest = hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if response and (len(payload) != long or f"sha256:{digest}" != fields["WARC-Payload-Digest"]):
        raise ValueError("a payload doesn't match its digest")
    return {
        "id": None if number is None else int(number),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if response else None,
        "payload_bytes": long,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
    }


class Bundle:
    """A bundle that grows record by record."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.sizes, self.open, self.plain = [], [], [], 0
        self.index, self.total = [], 0

    def add(self, record_id: int | None, raw: bytes) -> None:
        if self.open and self.plain + len(raw) > FRAME:
            self._close()
        self.index.append((record_id, len(self.frames), self.plain, len(raw)))
        self.open.append(raw)
        self.plain += len(raw)
        self.total += len(raw)

    def _close(self) -> None:
        frame = self.packer.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.plain))
        self.open, self.plain = [], 0

    def row(self) -> dict:
        if self.open:
            self._close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        archive = b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        ids, frames, offsets, lengths = map(list, zip(*self.index, strict=True))
        name = hashlib.sha256(archive).hexdigest()[:32]
        return {"bundle": name, "archive": archive, "ids": ids, "frames": frames, "offsets": offsets, "lengths": lengths}


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """From the footer: (start, compressed size, plain size) of every frame."""
    n, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    table, at = archive[-9 - n * each : -9], 0
    out = []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * each)
        out.append((at, packed, plain))
        at += packed
    return out


def bundles(records: DataFrame) -> DataFrame:
    """Bundles of (id, url, payload, digest, refers_to), packed as the rows lie in their partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle", pa.string()), ("archive", pa.binary()), ("ids", pa.list_(pa.int64())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
        bundle = Bundle()
        for batch in tidied(batches):
            for k in range(batch.num_rows):
                record_id, url, payload, digest, refers = (c[k].as_py() for c in batch.columns)
                bundle.add(record_id, record_bytes(record_id, url, payload or b"", digest, refers))
                if bundle.total >= BUNDLE:
                    yield pa.RecordBatch.from_pylist([bundle.row()], schema)
                    bundle = Bundle()
        if bundle.index:
            yield pa.RecordBatch.from_pylist([bundle.row()], schema)

    return records.select("id", "url", "payload", "digest", "refers_to").mapInArrow(pack, _INDEX)


def write(records: DataFrame, path: str) -> None:
    """Archives (id long, url string, payload binary) at `path`. Null payloads are empty."""
    records = records.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    bundles(with_revisits(records)).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The records of the archives at `path`; with `ids`, only those, and only their frames are decompressed."""
    wanted = None if ids is None else frozenset(ids)
    archives = spark.read.schema(_INDEX).parquet(path)
    if wanted is not None:
        archives = archives.where(F.arrays_overlap("ids", F.lit(list(wanted)).cast("array<long>")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        reader = zstandard.ZstdDecompressor()
        for batch in tidied(batches):
            for k in range(batch.num_rows):
                _, archive, keys, frames, offsets, lengths = (c[k].as_py() for c in batch.columns)
                table, now, plain, out = seek_table(archive), -1, b"", []
                for key, frame, at, long in zip(keys, frames, offsets, lengths, strict=True):
                    if wanted is not None and key not in wanted:
                        continue
                    if frame != now:
                        if out:
                            yield pa.RecordBatch.from_pylist(out, schema)
                        start, packed, size = table[frame]
                        now, plain, out = frame, reader.decompress(archive[start : start + packed], max_output_size=size), []
                    out.append(parse_record(plain[at : at + long]))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return archives.mapInArrow(unpack, _RECORD)


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes each bundle as `folder`/<bundle>.warc.zst, a folder that every executor can write, and returns the names.

    A file appears under its name when it is whole, and a repeated task writes the same bytes.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in tidied(batches):
            names = batch.column(0).to_pylist()
            for name, archive in zip(names, batch.column(1), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(archive.as_buffer())
                store.move(part, f"{root}/{name}.warc.zst")
            yield pa.RecordBatch.from_pydict({"file": pa.array([f"{n}.warc.zst" for n in names], pa.string())})

    return spark.read.schema(_INDEX).parquet(path).select("bundle", "archive").mapInArrow(put, "file string")
