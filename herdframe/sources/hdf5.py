"""Detections and calibrations in HDF5 files, as a Spark data source.

A file holds, for one recording and camera, `coordinates` (N, T, K, 2), `confidences` (N, T, K),
`affinities` and `identities` (N, N, T, K). Its T frames begin with the number in the attribute `first_frame` of the
coordinates, or with 0 where there is none, so a file is as long as what it holds, wherever that lies. Reading is by ranges of frames: a partition seeks to its
parts of each dataset and hands on batches of bounded size, so a file of any length is many tasks, and many short files are one. Files are opened by
pyarrow's file systems, so any store that it knows will do. Writing is by file: rows are packed by file where they are and
move once; each task lays its files out and fills them in place under a hidden name; they get their names when the whole job commits, and go if it aborts.

Read are files as they are written by default: superblocks of version 0 or 1, groups by symbol tables, datasets in one
run or compact, numbers of the machine's order and strings of fixed length. Anything else, and a
file that is cut off, is an error that names the file and what it is.
"""

import json
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from herdframe.schemas import AFFINITIES, DETECTIONS, IDENTITIES, SERIES

#: The signature of the format, and the sizes of its structures at the default settings.
SIGNATURE, UNDEFINED = b"\x89HDF\r\n\x1a\n", 2**64 - 1
SUPERBLOCK, TREE_NODE, SYMBOLS = 96, 544, 328
SPACE, TYPE, FILL, LAYOUT, ATTRIBUTE, CONTINUED, FILTERS, TABLE = 0x01, 0x03, 0x05, 0x08, 0x0C, 0x10, 0x0B, 0x11
FIRST = "first_frame"
#: Frames of a partition, and rows of a batch.
FRAMES, ROWS = 20_000, 1 << 16


class Hdf5Error(ValueError):
    """A file that isn't what it should be."""


@dataclass
class Dataset:
    shape: tuple[int, ...]
    dtype: np.dtype
    address: int
    inline: bytes | None = None
    first: int = 0


class File:
    """The datasets of one file, by path within it; values are read by ranges."""

    def __init__(self, path: str):
        self.path = path
        system, name = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
        self.f = system.open_input_file(name)
        self.size = self.f.size()
        head = self._at(0, SUPERBLOCK)
        if head[:8] != SIGNATURE:
            raise Hdf5Error(f"{path}: not an HDF5 file")
        if head[8] > 1 or head[13] != 8 or head[14] != 8:
            raise Hdf5Error(f"{path}: superblock version {head[8]} isn't read")
        shift = 4 if head[8] == 1 else 0
        (self.end,) = struct.unpack_from("<Q", self._at(40 + shift, 8))
        if self.end > self.size:
            raise Hdf5Error(f"{path}: cut off, {self.size} of {self.end} bytes")
        self.datasets: dict[str, Dataset] = {}
        self._object(struct.unpack_from("<Q", self._at(64 + shift, 8))[0], "")

    def __enter__(self) -> "File":
        return self

    def __exit__(self, *_: object) -> None:
        self.f.close()

    def _at(self, place: int, size: int) -> bytes:
        if place + size > self.size:
            raise Hdf5Error(f"{self.path}: cut off, nothing at {place}")
        self.f.seek(place)
        return self.f.read(size)

    def _messages(self, address: int) -> list[tuple[int, bytes]]:
        version, _, count, _, size = struct.unpack("<BBHII", self._at(address, 12))
        if version != 1:
            raise Hdf5Error(f"{self.path}: object headers of version {version} aren't read")
        runs, out = [(address + 16, size)], []
        while runs and len(out) < count:
            place, left = runs.pop(0)
            raw, k = self._at(place, left), 0
            while k + 8 <= left and len(out) < count:
                kind, long = struct.unpack_from("<HH", raw, k)
                body = raw[k + 8 : k + 8 + long]
                if kind == CONTINUED:
                    runs.append(struct.unpack("<QQ", body[:16]))
                out.append((kind, body))
                k += 8 + long
        return out

    def _object(self, address: int, name: str) -> None:
        messages = self._messages(address)
        held = dict(messages)
        if TABLE in held:
            tree, heap = struct.unpack("<QQ", held[TABLE][:16])
            for child, place in self._members(tree, heap):
                self._object(place, f"{name}/{child}".lstrip("/"))
        elif LAYOUT in held and SPACE in held and TYPE in held:
            self.datasets[name] = self._dataset(held, name)
            for kind, body in messages:
                if kind == ATTRIBUTE:
                    self.datasets[name].first = self._first(body, self.datasets[name].first)

    def _first(self, body: bytes, otherwise: int) -> int:
        """The first frame, if this attribute says it: a whole number behind its name, type and space, each filled up to eight bytes in version 1."""
        name, kind, space = struct.unpack_from("<HHH", body, 2)
        place, filled = 8 + (body[0] == 3), lambda size: -(-size // 8) * 8 if body[0] == 1 else size
        if body[place : place + name].rstrip(b"\0") != FIRST.encode():
            return otherwise
        place += filled(name)
        if body[place] & 15 or body[place + 1] & 1 or struct.unpack_from("<I", body, place + 4)[0] != 8:
            raise Hdf5Error(f"{self.path}: {FIRST} isn't a whole number of 64 bits in the machine's order")
        return struct.unpack_from("<q", body, place + filled(kind) + filled(space))[0]

    def _members(self, tree: int, heap: int) -> Iterator[tuple[str, int]]:
        magic, names = struct.unpack("<4s20xQ", self._at(heap, 32))
        if magic != b"HEAP":
            raise Hdf5Error(f"{self.path}: no heap of names at {heap}")
        todo = [tree]
        while todo:
            at = todo.pop(0)
            if self._at(at, 4) == b"TREE":
                (used,) = struct.unpack("<H", self._at(at + 6, 2))
                todo += [struct.unpack("<Q", self._at(at + 24 + 8 + 16 * k, 8))[0] for k in range(used)]
                continue
            if self._at(at, 4) != b"SNOD":
                raise Hdf5Error(f"{self.path}: no symbols at {at}")
            (used,) = struct.unpack("<H", self._at(at + 6, 2))
            for k in range(used):
                name, place = struct.unpack("<QQ", self._at(at + 8 + 40 * k, 16))
                raw = self._at(names + name, min(256, self.size - names - name))
                yield raw[: raw.index(b"\0")].decode(), place

    def _dataset(self, held: dict[int, bytes], name: str) -> Dataset:
        space, kind, layout = held[SPACE], held[TYPE], held[LAYOUT]
        rank, first = space[1], 8 if space[0] == 1 else 4
        shape = struct.unpack_from(f"<{rank}Q", space, first)
        (size,) = struct.unpack_from("<I", kind, 4)
        order = ">" if kind[1] & 1 else "<"
        if kind[0] & 15 == 0:
            dtype = np.dtype(f"{order}{'i' if kind[1] & 8 else 'u'}{size}")
        elif kind[0] & 15 == 1:
            dtype = np.dtype(f"{order}f{size}")
        elif kind[0] & 15 == 3:
            dtype = np.dtype(f"S{size}")
        else:
            raise Hdf5Error(f"{self.path}: {name} is of a type that isn't read")
        if layout[0] != 3 or layout[1] > 1 or FILTERS in held:
            raise Hdf5Error(f"{self.path}: {name} is stored in chunks, which aren't read; store it in one run")
        if layout[1] == 0:
            (long,) = struct.unpack_from("<H", layout, 2)
            return Dataset(shape, dtype, 0, layout[4 : 4 + long])
        address, long = struct.unpack_from("<QQ", layout, 2)
        if address != UNDEFINED and address + long > self.size:
            raise Hdf5Error(f"{self.path}: cut off within {name}")
        return Dataset(shape, dtype, address)

    def dataset(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise Hdf5Error(f"{self.path}: no dataset {name}, only {sorted(self.datasets)}")
        return self.datasets[name]

    def values(self, name: str) -> np.ndarray:
        """All of a small dataset."""
        d = self.dataset(name)
        return self._run(d, 0, prod(d.shape)).reshape(d.shape)

    def _run(self, d: Dataset, first: int, count: int) -> np.ndarray:
        """`count` values from the first one on, in the order in which they lie."""
        if d.address == UNDEFINED:  # never written
            return np.zeros(count, d.dtype)
        raw = d.inline[first * d.dtype.itemsize :] if d.inline is not None else self._at(d.address + first * d.dtype.itemsize, count * d.dtype.itemsize)
        return np.frombuffer(raw, d.dtype, count)

    def frames(self, name: str, axis: int, start: int, stop: int) -> np.ndarray:
        """The values of the frames from start to stop, which lie along this axis: one run for each place of the axes before it."""
        d = self.dataset(name)
        inner = prod(d.shape[axis + 1 :])
        runs = [self._run(d, (k * d.shape[axis] + start) * inner, (stop - start) * inner) for k in range(prod(d.shape[:axis]))]
        return np.stack(runs).reshape(*d.shape[:axis], stop - start, *d.shape[axis + 1 :]).astype(float)


def _message(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def _names(names: list[str]) -> tuple[bytes, dict[str, int]]:
    """A heap of names, and where each begins."""
    out, at = b"\0" * 8, {}
    for n in names:
        at[n] = len(out)
        out += n.encode() + b"\0" * (8 - len(n) % 8)
    return out, at


def _group_size(names: list[str]) -> int:
    return 40 + 32 + len(_names(names)[0]) + TREE_NODE + SYMBOLS


def _group(place: int, members: dict[str, int]) -> bytes:
    """A group at this place whose members (at most eight) lie at these addresses: header, heap, tree of one node, symbols."""
    names = sorted(members)
    held, at = _names(names)
    heap = place + 40
    tree = heap + 32 + len(held)
    symbols = tree + TREE_NODE
    out = struct.pack("<BxHII4x", 1, 1, 1, 24) + _message(TABLE, struct.pack("<QQ", tree, heap))
    out += struct.pack("<4sB3xQQQ", b"HEAP", 0, len(held), 1, heap + 32) + held
    node = struct.pack("<4sBBHQQ QQQ", b"TREE", 0, 0, 1, UNDEFINED, UNDEFINED, 0, symbols, at[names[-1]])
    table = struct.pack("<4sBxH", b"SNOD", 1, len(names)) + b"".join(struct.pack("<QQI4x16x", at[n], members[n], 0) for n in names)
    return out + node + b"\0" * (TREE_NODE - len(node)) + table + b"\0" * (SYMBOLS - len(table))


def _attribute(name: str, value: int) -> bytes:
    fill = lambda raw: raw + b"\0" * (-len(raw) % 8)
    text, kind, space = name.encode() + b"\0", struct.pack("<BBBBIHH", 0x10, 8, 0, 0, 8, 0, 64), struct.pack("<B7x", 1)
    return _message(ATTRIBUTE, struct.pack("<BxHHH", 1, len(text), len(kind), len(space)) + fill(text) + fill(kind) + space + struct.pack("<q", value))


def _header(shapes: dict[str, tuple[int, ...]], types: dict[str, np.dtype] | None = None, group: str | None = None, first: dict[str, int] | None = None) -> tuple[bytes, dict[str, int], int]:
    """The bytes in front of the data of a file with these datasets (doubles, or strings of fixed length), in the root or in one group, and with the first frame of those that have one; where each one's data begin, and where the file ends."""
    names, types, first = sorted(shapes), types or {}, first or {}
    place = SUPERBLOCK + _group_size([group] if group else names)
    inner = place
    if group:
        place += _group_size(names)
    bodies, objects, size = {}, {}, {}
    for n in names:
        size[n] = np.dtype(types.get(n, np.float64)).itemsize
        kind = struct.pack("<BBBBI", 0x13, 1, 0, 0, size[n]) if n in types else struct.pack("<BBBBI HHBBBBI", 0x11, 0x20, 0x3F, 0, 8, 0, 64, 52, 11, 0, 52, 1023)
        bodies[n] = _message(SPACE, struct.pack("<BBBx4x", 1, len(shapes[n]), 0) + struct.pack(f"<{len(shapes[n])}Q", *shapes[n])) + _message(TYPE, kind) + _message(FILL, struct.pack("<BBBB", 2, 2, 2, 0)) + (_attribute(FIRST, first[n]) if n in first else b"")
        objects[n] = place
        place += 16 + len(bodies[n]) + 32
    data, begin = {}, place
    for n in names:
        data[n] = begin
        begin += size[n] * prod(shapes[n])
    out = SIGNATURE + struct.pack("<BBBxBBBx HH I QQQQ", 0, 0, 0, 0, 8, 8, 4, 16, 0, 0, UNDEFINED, begin, UNDEFINED)
    top = _group(SUPERBLOCK, {group: inner} if group else objects)
    heap = SUPERBLOCK + 40
    out += struct.pack("<QQI4xQQ", 0, SUPERBLOCK, 1, heap + 32 + len(_names([group] if group else names)[0]), heap) + top
    if group:
        out += _group(inner, objects)
    for n in names:
        layout = _message(LAYOUT, struct.pack("<BBQQ", 3, 1, data[n], size[n] * prod(shapes[n])))
        out += struct.pack("<BxHII4x", 1, 4 + (n in first), 1, len(bodies[n]) + len(layout)) + bodies[n] + layout
    return out, data, begin


@dataclass
class Frames(InputPartition):
    """Ranges of frames: recording, camera, path, start and stop within the file."""

    ranges: list[tuple[str, int, str, int, int]]


ROW = "recording string, camera long, frame long, keypoint long, instance long"
#: What is read of a file at a time: coordinates and confidences, or one of the two lists of weights.
TABLES = {"detections": f"{ROW}, x double, y double, confidence double", "affinities": f"{ROW}, affinities array<double>", "identities": f"{ROW}, identities array<double>"}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.frames, self.table = int(options.get("frames", FRAMES)), options["table"]

    def partitions(self) -> list[Frames]:
        """Ranges in order of the files, as many as have `frames` frames together."""
        out, room = [], 0
        for recording, camera, path in self.files:
            with File(path) as f:
                n, t, k = _sizes(f)
                for name, shape in {"coordinates": (n, t, k, 2), "affinities": (n, n, t, k), "identities": (n, n, t, k)}.items():
                    if f.dataset(name).shape != shape:
                        raise Hdf5Error(f"{path}: {name} is {f.dataset(name).shape}, not {shape}")
            for a in range(0, t, self.frames):
                b = min(t, a + self.frames)
                if b - a > room:
                    out.append(Frames([]))
                    room = self.frames
                out[-1].ranges.append((recording, camera, path, a, b))
                room -= b - a
        return out

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for recording, camera, path, first, stop in partition.ranges:
            with File(path) as f:
                n, _, k = _sizes(f)
                step = max(1, ROWS // (n * k))
                for start in range(first, stop, step):
                    held.append(_batch(f, self.table, recording, camera, n, k, start, min(stop, start + step)))
                    rows += len(held[-1])
                    if rows >= ROWS:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _sizes(f: File) -> tuple[int, int, int]:
    shape = f.dataset("confidences").shape
    if len(shape) != 3:
        raise Hdf5Error(f"{f.path}: confidences is {shape}, not animals by frames by keypoints")
    return shape


def _batch(f: File, table: str, recording: str, camera: int, n: int, k: int, start: int, stop: int) -> pa.RecordBatch:
    """Rows in order of frame, keypoint and instance."""
    t, first = stop - start, f.dataset("coordinates").first
    rows = t * k * n
    number = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
    if table == "detections":
        xy = f.frames("coordinates", 1, start, stop).transpose(1, 2, 0, 3).reshape(-1, 2)
        cells = [number(xy[:, 0]), number(xy[:, 1]), number(f.frames("confidences", 1, start, stop).transpose(1, 2, 0).reshape(-1))]
    else:
        weights = f.frames(table, 2, start, stop).transpose(2, 3, 0, 1).reshape(-1)
        cells = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n, pa.int32()), number(weights))]
    places = np.meshgrid(np.arange(start, stop) + first, np.arange(k), np.arange(n), indexing="ij")
    keys = [pa.array([recording], pa.string()).take(pa.array(np.zeros(rows, np.int64))), pa.array(np.full(rows, camera)), *(pa.array(x.reshape(-1).astype(np.int64)) for x in places)]
    return pa.RecordBatch.from_arrays([*keys, *cells], names=[c.split()[0] for c in TABLES[table].split(", ")])


#: Rows of one file on their way to it: first a row of the kind FILE with its first frame and number of frames, then rows of detections and of weights, packed.
PACKED = "recording string, camera long, kind int, first long, rows long, held binary"
FILE, COLUMNS = 0, {1: ("x", "y", "confidence"), 2: ("parent_instance", "weight"), 3: ("animal", "weight")}
PLACE = ("frame", "keypoint", "instance")
#: Rows of detections take 7 bytes at this level in the shuffle, 10 at the lowest.
CODEC, LEVEL = "zstd", 6


def _packed(kind: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows of detections or weights as one run of compressed columns a file and some ROWS rows."""
    types = dict.fromkeys((*PLACE, "parent_instance", "animal"), np.int64)

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        recording, camera = t.column("recording").combine_chunks().dictionary_encode(), t.column("camera").to_numpy()
        cameras, which = np.unique(camera, return_inverse=True)
        file = recording.indices.to_numpy() * len(cameras) + which
        order = np.argsort(file, kind="stable")
        columns = [t.column(c).to_numpy().astype(types.get(c, np.float64), copy=False)[order].view(np.int64) for c in (*PLACE, *COLUMNS[kind])]
        cuts = np.flatnonzero(np.diff(file[order], prepend=-1, append=-1))
        lengths, top = np.diff(cuts), order[cuts[:-1]]
        codec = pa.Codec(CODEC, LEVEL)
        held = [codec.compress(np.stack([c[a:b] for c in columns]), asbytes=True) for a, b in zip(cuts, cuts[1:], strict=False)]
        same = lambda v, kind: pa.array(np.full(len(held), v), kind)
        cells = [recording.dictionary.take(recording.indices.take(pa.array(top))), pa.array(camera[top]), same(kind, pa.int32()), same(0, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(held, pa.binary())]
        return pa.RecordBatch.from_arrays(cells, names=[c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held, rows = [*held, b], rows + len(b)
            if rows >= ROWS:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    return run


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.n, self.k = options["path"].removeprefix("file://"), int(options["animals"]), int(options["keypoints"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come by file, first the one that says which frames it has; weights of a file without detections are left out."""
        from pyspark import TaskContext

        attempt, files, now, held = TaskContext.get().taskAttemptId(), [], None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if (row["recording"], row["camera"]) != now:
                    self._closed(held)
                    now, held = (row["recording"], row["camera"]), None
                if row["kind"] == FILE:
                    name = f"{now[0]}.{now[1]}.h5"
                    files.append((os.path.join(self.folder, f".{name}.{attempt}"), os.path.join(self.folder, name)))
                    held = self._opened(files[-1][0], row["first"], row["rows"])
                elif held:
                    self._put(held, row)
        self._closed(held)
        return Written(files)

    def _opened(self, path: str, first: int, t: int) -> dict[str, np.ndarray]:
        n, k = self.n, self.k
        shapes = {"coordinates": (n, t, k, 2), "confidences": (n, t, k), "affinities": (n, n, t, k), "identities": (n, n, t, k)}
        head, data, end = _header(shapes, first={"coordinates": first})
        os.makedirs(self.folder, exist_ok=True)
        with open(path, "wb") as f:
            f.write(head)
            f.truncate(end)
        maps = {name: np.memmap(path, np.float64, "r+", data[name], shape) for name, shape in shapes.items()}
        for name in ("coordinates", "affinities", "identities"):  # what no row says is missing
            for part in maps[name]:
                part[:] = np.nan
        return maps | {"first": first, "seen": np.zeros(shapes["confidences"], bool)}

    def _put(self, maps: dict[str, np.ndarray], row: dict) -> None:
        """Of repeated weights the largest counts; those of detections that no row says anything of are left out."""
        names, count = (*PLACE, *COLUMNS[row["kind"]]), row["rows"]
        raw = np.frombuffer(pa.decompress(row["held"], count * len(names) * 8, CODEC), np.int64).reshape(len(names), count)
        t, k, i = raw[0] - maps["first"], raw[1], raw[2]
        if row["kind"] == 1:
            x, y, c = raw[3:].view(np.float64)
            maps["coordinates"][i, t, k, 0], maps["coordinates"][i, t, k, 1] = x, y
            maps["confidences"][i, t, k] = np.nan_to_num(c)
            maps["seen"][i, t, k] = True
            return
        weight, into = raw[4].view(np.float64), maps["affinities" if row["kind"] == 2 else "identities"]
        inside = (t >= 0) & (t < maps["seen"].shape[1]) & ~np.isnan(weight)
        inside[inside] = maps["seen"][i[inside], t[inside], k[inside]]
        order = np.flatnonzero(inside)[np.argsort(weight[inside], kind="stable")]
        place = i[order], raw[3][order], t[order], k[order]
        into[place] = np.fmax(into[place], weight[order])

    def _closed(self, maps: dict[str, np.ndarray] | None) -> None:
        """Weights that no row says are 0."""
        for name in ("affinities", "identities") if maps else ():
            for part in maps[name]:
                part[np.isnan(part)] = 0.0

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for hidden, name in m.files if m else []:
                os.replace(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for hidden, _ in m.files if m else []:
                if os.path.exists(hidden):
                    os.remove(hidden)


class KeypointFiles(DataSource):
    """The format "keypoint_hdf5": reads a `table` of `files` (JSON of [recording, camera, path]), writes a folder of one file a recording and camera."""

    @classmethod
    def name(cls) -> str:
        return "keypoint_hdf5"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def read_hdf5(recordings: DataFrame, frames: int = FRAMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detections, affinities, identities) of the files of recordings (recording, camera, path). The driver reads each file's header; NaN is NULL, and the root's affinities are left as they are."""
    spark = recordings.sparkSession
    spark.dataSource.register(KeypointFiles)
    files = json.dumps(sorted(tuple(r) for r in recordings.select("recording", F.col("camera").cast("long"), "path").collect()))
    key = [*SERIES, "frame"]
    rows = lambda table: spark.read.format("keypoint_hdf5").options(files=files, frames=frames, table=table).load()
    each = lambda name, other: rows(name).select(*key, F.posexplode(name).alias(other, "weight")).withColumn(other, F.col(other).cast("long"))
    tables = rows("detections"), each("affinities", "parent_instance"), each("identities", "animal")
    return tuple(t.select(*[f.split()[0] for f in schema.split(", ")]) for t, schema in zip(tables, (DETECTIONS, AFFINITIES, IDENTITIES), strict=True))


def write_hdf5(detections: DataFrame, affinities: DataFrame, identities: DataFrame, folder: str, animals: int, keypoints: int) -> DataFrame:
    """Writes one file a recording and camera into a folder that all executors share, and returns (recording, camera, path).

    Missing coordinates are NaN, missing weights 0. A file has frames from its first detection's to its last one's. Numbers beyond
    animals and keypoints are an error.
    """
    spark = detections.sparkSession
    spark.dataSource.register(KeypointFiles)
    files = detections.groupBy("recording", "camera").agg(F.min("frame").alias("first"), (F.max("frame") - F.min("frame") + 1).alias("frames"))
    rows = files.select("recording", "camera", F.lit(FILE).alias("kind"), "first", F.col("frames").alias("rows"), F.lit(None).cast("binary").alias("held"))
    for kind, table in ((1, detections), (2, affinities), (3, identities)):
        numbers = [F.col(c).cast("double" if c in ("x", "y", "confidence", "weight") else "long").alias(c) for c in ("camera", *PLACE, *COLUMNS[kind])]
        rows = rows.unionByName(table.select("recording", *numbers).mapInArrow(_packed(kind), PACKED))
    rows = rows.repartition("recording", "camera").sortWithinPartitions("recording", "camera", "kind")
    rows.write.format("keypoint_hdf5").options(animals=animals, keypoints=keypoints).mode("append").save(folder)
    return files.select("recording", "camera", F.concat(F.lit(folder.rstrip("/") + "/"), "recording", F.lit("."), F.col("camera").cast("string"), F.lit(".h5")).alias("path"))


def write_calibration_hdf5(cameras: DataFrame, path: str) -> None:
    """The cameras' names, rotations, translations, intrinsics and lenses as one small file, in order of cameras."""
    rows = cameras.orderBy("camera").select("name", "rotation", "translation", "intrinsic", "dist_coefs").collect()
    held = {n: np.array([r[n] for r in rows], float) for n in ("rotation", "translation", "intrinsic", "dist_coefs")}
    held["camera_names"] = np.array([r.name.encode() for r in rows], "S")
    head, data, end = _header({n: v.shape for n, v in held.items()}, {"camera_names": held["camera_names"].dtype}, "camera_parameters")
    with open(path, "wb") as f:
        f.write(head + b"".join(held[n].tobytes() for n in sorted(held, key=data.__getitem__)))
        assert f.tell() == end


def read_calibration_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """Cameras (as sources.detections.read_calibration) of a file with the group camera_parameters; one row a camera."""
    from herdframe.schemas import CALIBRATION

    with File(path) as f:
        held = {n: f.values(f"camera_parameters/{n}") for n in ("camera_names", "rotation", "translation", "intrinsic", "dist_coefs")}
    rows = []
    for c, name in enumerate(held["camera_names"]):
        rotation, translation, intrinsic, lens = (held[n][c].astype(float) for n in ("rotation", "translation", "intrinsic", "dist_coefs"))
        projection = intrinsic @ np.c_[rotation, translation]
        rows.append((c, name.decode(), rotation.tolist(), translation.tolist(), intrinsic.tolist(), lens.tolist(), projection.tolist()))
    return spark.createDataFrame(rows, CALIBRATION)
