"""Writing detections and pictures' geometry."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_detections(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet by recording and camera. Recordings that are there stay, unless overwrite: then just those written are replaced."""
    spark = rows.sparkSession
    if not overwrite:
        try:
            there = spark.read.parquet(path).select("recording", F.col("camera").cast("long").alias("camera")).distinct()
        except Exception as e:  # nothing there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            rows = rows.join(there, ["recording", "camera"], "left_anti")
    writer = rows.repartition("recording", "camera", F.expr("frame div 100000")).write.partitionBy("recording", "camera")
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite" if overwrite else "append").parquet(path)


def convert_deeplabcut(recordings: DataFrame, path: str, bodyparts: list[str], order: list[int], parents: list[int], n: int, individuals: list[str] | None = None, recorded: list[str] | None = None, overwrite: bool = False) -> None:
    """All files of recordings (recording, camera, path) to `path`/detections, /affinities and /identities, as one job each."""
    from herdframe.sources.detections import read_deeplabcut

    tables = read_deeplabcut(recordings.sparkSession, recordings, bodyparts, order, parents, n, individuals, recorded)
    for name, rows in zip(("detections", "affinities", "identities"), tables, strict=True):
        write_detections(rows, f"{path}/{name}", overwrite)


def crop_boxes(centroids: DataFrame, width: int, height: int, crop: int | tuple[int, int]) -> DataFrame:
    """(x0, y0, x1, y1, pad_left, pad_top) of a square, or of a rectangle (w, h), around each centroid, clamped to the image."""
    w, h = crop if isinstance(crop, tuple) else (crop, crop)

    def edge(c: str, shift: int, most: int):  # noqa: ANN202
        return F.greatest(F.lit(0), F.least(F.lit(most), F.col(c).cast("int") + shift))

    boxes = centroids.withColumns({"x0": edge("cx", -(w // 2), width), "y0": edge("cy", -(h // 2), height), "x1": edge("cx", w // 2, width), "y1": edge("cy", h // 2, height)})
    return boxes.withColumns({"pad_left": F.expr(f"({w} - (x1 - x0)) div 2"), "pad_top": F.expr(f"({h} - (y1 - y0)) div 2")})


#: The ends of the default colours of keypoints, red to yellow.
AUTUMN = ((255, 0, 0), (255, 255, 0))


def overlay(frames: DataFrame, segments: DataFrame, width: int, height: int, points: DataFrame | None = None, keypoints: int = 1, colours: list | None = None, line_width: int = 1, node_size: int = 2, opacity: float = 1.0) -> DataFrame:
    """Frames (recording, camera, frame, image: width x height x 3 bytes) with each animal's bones and keypoints drawn.

    segments come from poses.overlay_segments (which takes a choice of keypoints), points are
    detections, drawn as discs. colours has a pair of ends for each animal; a keypoint's colour lies
    between them by its number among `keypoints`. What lies outside the image isn't drawn, and
    frames without anything to draw stay as they are. Of a frame at most animals x keypoints rows are gathered.
    """
    import numpy as np
    import pyarrow as pa

    keys = ["recording", "camera", "frame"]
    ends = np.array(colours or [AUTUMN], float)
    number = F.col("keypoint") if "keypoint" in segments.columns else F.lit(0)
    lines = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("instance").cast("double"), number.cast("double"), "x", "y", "px", "py"))).alias("lines"))
    inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    seen = (segments.limit(0) if points is None else points.where(inside)).groupBy(*keys)
    dot = F.struct(F.col("instance").cast("double"), (F.lit(0) if points is None else F.col("keypoint")).cast("double"), "x", "y")
    dots = seen.agg(F.array_sort(F.collect_list(dot)).alias("dots"))

    def square(size: int) -> np.ndarray:
        return np.stack(np.meshgrid(*[np.arange(size) - (size - 1) // 2] * 2), -1).reshape(-1, 2)

    disc = square(2 * node_size + 1)
    disc = disc[(disc**2).sum(1) <= node_size**2]

    def colour(rows: np.ndarray) -> np.ndarray:
        share = np.clip(rows[:, 1] / max(1, keypoints - 1), 0, 1)[:, None]
        of = ends[rows[:, 0].astype(int) % len(ends)]
        return (of[:, 0] * (1 - share) + of[:, 1] * share).astype(np.uint8)

    def stamp(canvas: np.ndarray, xy: np.ndarray, shape: np.ndarray, paint: np.ndarray) -> None:
        """Colours the shape around each place (rows, places, 2)."""
        at = xy[:, :, None, :] + shape
        row = np.broadcast_to(np.arange(len(xy))[:, None, None], at.shape[:3])
        ok = ((at >= 0) & (at < (width, height))).all(3)
        canvas[at[ok][:, 1], at[ok][:, 0]] = paint[row[ok]]

    @F.arrow_udf("binary")
    def draw(images: pa.Array, lines: pa.Array, dots: pa.Array) -> pa.Array:
        out = []
        for raw, a, b in zip(images.to_pylist(), lines.to_pylist(), dots.to_pylist(), strict=True):
            if not a and not b:
                out.append(raw)
                continue
            image = np.frombuffer(raw, np.uint8).reshape(height, width, 3)
            canvas = image.copy()
            if a:
                rows = np.array([list(r.values()) for r in a])
                start, stop = rows[:, 2:4].astype(int), rows[:, 4:6].astype(int)
                steps = np.linspace(0, 1, int(np.abs(start - stop).max()) + 2)[:, None]
                stamp(canvas, np.rint(start[:, None] * (1 - steps) + stop[:, None] * steps).astype(int), square(line_width), colour(rows))
            if b:
                rows = np.array([list(r.values()) for r in b])
                stamp(canvas, rows[:, None, 2:4].astype(int), disc, colour(rows))
            out.append((canvas if opacity >= 1 else np.rint(image * (1 - opacity) + canvas * opacity).astype(np.uint8)).tobytes())
        return pa.array(out, pa.binary())

    return frames.join(lines, keys, "left").join(dots, keys, "left").withColumn("image", draw("image", "lines", "dots")).drop("lines", "dots")


def cropped(frames: DataFrame, boxes: DataFrame, width: int, height: int, crop: int | tuple[int, int]) -> DataFrame:
    """Each frame's box as an image of crop x crop x 3 bytes (or w x h of a rectangle), what lies outside the image black; boxes from crop_boxes."""
    import pyarrow as pa

    keys = ["recording", "camera", "frame"]
    w, h = crop if isinstance(crop, tuple) else (crop, crop)

    @F.arrow_udf("binary")
    def cut(images: pa.Array, boxes: pa.Array) -> pa.Array:
        import numpy as np

        out = []
        for raw, b in zip(images.to_pylist(), boxes.to_pylist(), strict=True):
            image, canvas = np.frombuffer(raw, np.uint8).reshape(height, width, 3), np.zeros((h, w, 3), np.uint8)
            part = image[b["y0"] : b["y1"], b["x0"] : b["x1"]]
            canvas[b["pad_top"] : b["pad_top"] + len(part), b["pad_left"] : b["pad_left"] + part.shape[1]] = part
            out.append(canvas.tobytes())
        return pa.array(out, pa.binary())

    box = F.struct("x0", "y0", "x1", "y1", "pad_left", "pad_top")
    return frames.join(boxes, keys).select(*keys, cut("image", box).alias("image"))
