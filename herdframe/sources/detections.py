"""Detections from foreign files, as rows.

Files are binaryFile rows, so Spark spreads them and retries lost ones; a task decodes one file
and hands on raw peaks, and the rest (best peaks, edges, order of keypoints) is DataFrame work.
"""

import io
import pickle
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdframe.operators.transforms import top_detections
from herdframe.schemas import AFFINITIES, CALIBRATION, DETECTIONS, IDENTITIES, MATCHED_FRAMES, RECORDINGS
from herdframe.sources.shared import written

_ALLOWED = {
    ("numpy", "ndarray"),
    ("numpy", "dtype"),
    ("numpy.core.multiarray", "_reconstruct"),
    ("numpy._core.multiarray", "_reconstruct"),
    ("numpy.core.multiarray", "scalar"),
    ("numpy._core.multiarray", "scalar"),
    ("numpy._core.numeric", "_frombuffer"),
    ("numpy.core.numeric", "_frombuffer"),
    ("collections", "OrderedDict"),
    ("_codecs", "encode"),
}


class _Restricted(pickle.Unpickler):
    """Builds arrays and plain containers only: a pickle of another kind is an error, not code."""

    def find_class(self, module: str, name: str):  # noqa: ANN202
        if (module, name) in _ALLOWED:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")


def restricted_load(raw: bytes):  # noqa: ANN201
    return _Restricted(io.BytesIO(raw)).load()


#: Rows that a task hands on at a time.
ROWS = 1 << 16
PEAKS = "recording string, camera long, kind string, frame long, keypoint long, peak long, other long, other_peak long, x double, y double, score double"


def deeplabcut_rows(raw: bytes, recording: str, camera: int, bodyparts: list[str]) -> Iterator[tuple]:
    """Raw rows of one full-detections file: peaks, identity scores and part affinities, by the file's keypoint numbers."""
    data = restricted_load(raw)
    meta = data["metadata"]
    if list(meta["all_joints_names"]) != list(bodyparts):
        raise ValueError(f"{recording}: body parts {list(meta['all_joints_names'])} are not {bodyparts}")
    graph = meta["PAFgraph"]
    number = lambda v: None if v is None or not np.isfinite(v) else float(v)
    for key, frame in data.items():
        if not key.startswith("frame"):
            continue
        t = int(key[5:])
        for k, (conf, xy, ids) in enumerate(zip(frame["confidence"], frame["coordinates"][0], frame["identity"], strict=True)):
            for peak in range(len(conf)):
                yield recording, camera, "peak", t, k, peak, None, None, number(xy[peak][0]), number(xy[peak][1]), number(np.ravel(conf[peak])[0])
                for animal, w in enumerate(ids[peak]):
                    yield recording, camera, "identity", t, k, peak, animal, None, None, None, number(w)
        for edge, cost in frame["costs"].items():
            a, b = graph[edge]
            for i, row in enumerate(np.asarray(cost["m1"])):
                for j, w in enumerate(row):
                    yield recording, camera, "affinity", t, a, i, b, j, None, None, number(w)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark's readers name files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def read_deeplabcut(spark: SparkSession, recordings: DataFrame, bodyparts: list[str], order: list[int], parents: list[int], n: int, individuals: list[str] | None = None, recorded: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detections, affinities, identities) of all files of recordings (recording, camera, path).

    Of each frame and keypoint the n most confident peaks stay, as instances 0 to n - 1. Keypoints
    are numbered in the order of the tree; only its edges have affinities, child to parent, and
    only recorded individuals have identities. Files of one name in several folders are different
    files: recordings meet them by the whole path, as the file system completes it. Each file is
    unpickled once, in batches of at most ROWS rows, and its rows are written in the shared folder, which all three
    tables read. The driver lists the paths, one a file; no recordings give no rows.
    """
    paths = {r.path: qualified(spark, r.path) for r in recordings.select("path").distinct().collect()}
    files = spark.read.format("binaryFile").load(list(paths)) if paths else spark.createDataFrame([], "path string, content binary")
    full = spark.createDataFrame(list(paths.items()), "path string, name string")
    named = recordings.join(full, "path").select("recording", "camera", "name")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in PEAKS.split(", ")]
        for batch in batches:
            for recording, camera, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = deeplabcut_rows(raw, recording, camera, bodyparts)
                while some := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

    raw = files.withColumnRenamed("path", "name").join(named, "name").select("recording", "camera", "content").mapInArrow(decode, PEAKS)
    raw = written(raw, "peaks")
    place = F.create_map(*[F.lit(v).cast("long") for k, s in enumerate(order) for v in (s, k)])
    raw = raw.withColumn("keypoint", place[F.col("keypoint")])
    by = ["recording", "camera", "frame", "keypoint"]
    peaks = top_detections(raw.where("kind = 'peak'").withColumnRenamed("score", "confidence"), n, by, tie="peak").withColumnRenamed("slot", "instance")
    slots = peaks.select(*by, "peak", "instance")
    detections = peaks.select("recording", "camera", "frame", "keypoint", "instance", "x", "y", "confidence")
    channels = [individuals.index(r) for r in recorded] if individuals and recorded else list(range(n))
    animal = F.create_map(*[F.lit(v).cast("long") for a, c in enumerate(channels) for v in (c, a)])
    ids = raw.where("kind = 'identity'").withColumn("animal", animal[F.col("other")]).where("animal is not null").join(slots, [*by, "peak"])
    identities = ids.select("recording", "camera", "frame", "keypoint", "instance", "animal", F.col("score").alias("weight"))
    edges = raw.where("kind = 'affinity'").withColumn("other", place[F.col("other")])
    flipped = F.col("keypoint") < F.col("other")
    edges = edges.select("recording", "camera", "frame", *[F.when(flipped, F.col(b)).otherwise(F.col(a)).alias(a2) for a, b, a2 in (("keypoint", "other", "keypoint"), ("peak", "other_peak", "peak"), ("other", "keypoint", "parent"), ("other_peak", "peak", "parent_peak"))], F.col("score").alias("weight"))
    parent = F.create_map(*[F.lit(v).cast("long") for k, p in enumerate(parents) for v in (k, p)])
    edges = edges.where(F.col("parent") == parent[F.col("keypoint")]).join(slots, [*by, "peak"])
    above = slots.select("recording", "camera", "frame", F.col("keypoint").alias("parent"), F.col("peak").alias("parent_peak"), F.col("instance").alias("parent_instance"))
    affinities = edges.join(above, ["recording", "camera", "frame", "parent", "parent_peak"]).select("recording", "camera", "frame", "keypoint", "instance", "parent_instance", "weight")
    return detections, affinities, identities


def missing_edges(spark: SparkSession, available: list[list[int]], order: list[int], parents: list[int]) -> list[tuple[int, int]]:
    """Edges of the tree, in the file's numbers, for which the file has no affinities."""
    have = {tuple(sorted(e)) for e in available}
    need = [tuple(sorted((order[k], order[p]))) for k, p in enumerate(parents) if k != p]
    return [e for e in need if e not in have]


def sleap_tables(peaks: DataFrame, edges: DataFrame, order: list[int], parents: list[int], n: int) -> tuple[DataFrame, DataFrame]:
    """(detections, affinities) from peaks (recording, camera, frame, peak, channel, x, y, value) and edges (recording, camera, frame, edge, peak_a, peak_b, score).

    Negative peaks are padding. Of an edge that occurs twice the later one counts, and pairs of
    instances on an edge of the tree without a score have 0.
    """
    place = F.create_map(*[F.lit(v).cast("long") for k, s in enumerate(order) for v in (s, k)])
    view = ["recording", "camera", "frame"]
    numbered = peaks.withColumn("keypoint", place[F.greatest("channel", F.lit(0))])
    best = top_detections(numbered, n, [*view, "keypoint"], score="value", tie="peak").withColumnRenamed("slot", "instance")
    detections = best.select(*view, "keypoint", "instance", "x", "y", F.col("value").alias("confidence"))
    at = numbered.select(*view, "peak", "keypoint")
    used = edges.where("peak_a >= 0 and peak_b >= 0")
    used = used.join(at.select(*view, F.col("peak").alias("peak_a"), F.col("keypoint").alias("ka")), [*view, "peak_a"]).join(at.select(*view, F.col("peak").alias("peak_b"), F.col("keypoint").alias("kb")), [*view, "peak_b"])
    child = F.when(F.col("ka") > F.col("kb"), F.struct(F.col("peak_a").alias("c"), F.col("peak_b").alias("p"))).otherwise(F.struct(F.col("peak_b").alias("c"), F.col("peak_a").alias("p")))
    used = used.withColumn("e", child).groupBy(*view, F.col("e.c").alias("peak"), F.col("e.p").alias("parent_peak")).agg(F.max_by("score", "edge").alias("score"))
    parent = F.create_map(*[F.lit(v).cast("long") for k, p in enumerate(parents) for v in (k, p)])
    own = best.select(*view, "keypoint", "peak", "instance").withColumn("parent", parent[F.col("keypoint")]).where("parent <> keypoint")
    above = best.select(*view, F.col("keypoint").alias("parent"), F.col("peak").alias("parent_peak"), F.col("instance").alias("parent_instance"))
    pairs = own.join(above, [*view, "parent"]).join(used, [*view, "peak", "parent_peak"], "left")
    return detections, pairs.select(*view, "keypoint", "instance", "parent_instance", F.coalesce("score", F.lit(0.0)).alias("weight"))


def infer_peaks(frames: DataFrame, predict, batch_size: int = 32) -> DataFrame:  # noqa: ANN001
    """Peaks of frames (recording, camera, frame, image binary) by a model: predict(list of images) gives, for each, rows (channel, x, y, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, batch_size):
                rows = batch.slice(k, batch_size).to_pylist()
                found = predict([r["image"] for r in rows])
                out = [(r["recording"], r["camera"], r["frame"], i, *map(float, p)) for r, peaks in zip(rows, found, strict=True) for i, p in enumerate(peaks)]
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), *[pa.array(v, pa.int64()) for v in c[1:4]], pa.array([int(v) for v in c[4]], pa.int64()), *[pa.array(v, pa.float64()) for v in c[5:]]], names=["recording", "camera", "frame", "peak", "channel", "x", "y", "value"])

    return frames.select("recording", "camera", "frame", "image").mapInArrow(run, "recording string, camera long, frame long, peak long, channel long, x double, y double, value double")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections that sinks.write_detections wrote; recording and camera prune folders."""
    rows = spark.read.parquet(path)
    return rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in DETECTIONS.split(", ")])


def read_matched_frames(spark: SparkSession, path: str, cameras: list[str]) -> DataFrame:
    """(sync_idx, camera, frame) of a CSV with a column for each camera, whatever the number of rows or columns.

    Row numbers come from the reading order of one file, which Spark keeps within a partition.
    """
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    numbered = rows.select(F.monotonically_increasing_id().alias("sync_idx"), *[F.trim(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(cameras) if c in rows.columns])
    long = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("camera"), F.col(f"c{k}").cast("long").alias("frame")) for k, c in enumerate(cameras) if c in rows.columns]))
    return numbered.select("sync_idx", long.alias("f")).select("sync_idx", "f.camera", "f.frame").where("frame is not null")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Cameras from JSON lines (name, rotation, translation, intrinsic, dist_coefs), numbered as in the file, with projection = intrinsic [rotation | translation]."""
    schema = "name string, rotation array<array<double>>, translation array<double>, intrinsic array<array<double>>, dist_coefs array<double>"
    rows = spark.read.schema(schema).json(path).withColumn("camera", F.monotonically_increasing_id())
    cells = "transform(sequence(0, 2), i -> transform(sequence(0, 3), j -> aggregate(sequence(0, 2), 0D, (s, k) -> s + intrinsic[i][k] * if(j < 3, rotation[k][j], translation[k]))))"
    return rows.withColumn("projection", F.expr(cells)).select(*[f.split()[0] for f in CALIBRATION.split(", ")])


def multicamera(spark: SparkSession, detections: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Detections of synchronised cameras; without matched frames all cameras of a recording must have as many frames."""
    from herdframe.operators.transforms import require_equal_lengths, synchronize

    if matched is not None:
        return synchronize(detections, matched)
    if bad := require_equal_lengths(detections).take(5):
        raise ValueError(f"cameras with unequal numbers of frames need matched frames: {[r.recording for r in bad]}")
    return detections


SCHEMAS = {"detections": DETECTIONS, "identities": IDENTITIES, "affinities": AFFINITIES, "matched_frames": MATCHED_FRAMES, "recordings": RECORDINGS}
