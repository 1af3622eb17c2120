"""From raw detections to model-ready rows: interpolation, log-probabilities, top detections, synchronised frames."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from herdframe.functions.scalars import is_missing, log_normalized, log_sigmoid, outlier_prob, undistorted
from herdframe.operators.spread import spread
from herdframe.schemas import SERIES, VIEW

#: Frames of a segment: a series is interpolated by segments, so one series may be of any length.
SEGMENT = 10_000


def with_outlier_probs(detections: DataFrame) -> DataFrame:
    return detections.withColumn("outlier_prob", outlier_prob(F.col("confidence"), is_missing(F.col("x"), F.col("y"))))


def interpolate(detections: DataFrame, segment: int = SEGMENT, series: list[str] = SERIES, axes: str = "xy") -> DataFrame:
    """Missing coordinates by linear interpolation along a series' frames; constant beyond its ends, NULL if all are missing.

    A row misses its coordinates if it misses one of them. Each segment of a series needs its own
    rows and two more: the last valid one before it and the first one after. Those come from one
    row a segment, so no task holds a whole series.
    """
    rows = detections.withColumn("segment", F.expr(f"frame div {segment}"))
    valid = ~is_missing(*[F.col(c) for c in axes])
    point = F.when(valid, F.struct("frame", *axes))
    edges = rows.where(valid).groupBy(*series, "segment").agg(F.min_by(point, "frame").alias("head"), F.max_by(point, "frame").alias("tail"))
    edges = rows.select(*series, "segment").distinct().join(edges, [*series, "segment"], "left")
    by = W.partitionBy(*series).orderBy("segment")
    edges = edges.select(
        *series,
        "segment",
        F.last("tail", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)).alias("carried"),
        F.first("head", ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing)).alias("coming"),
    )
    inside = W.partitionBy(*series, "segment").orderBy("frame")
    before = F.coalesce(F.last(point, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("carried"))
    after = F.coalesce(F.first(point, ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing)), F.col("coming"))
    rows = rows.join(edges, [*series, "segment"]).select(*detections.columns, before.alias("b"), after.alias("a"))
    share = (F.col("frame") - F.col("b.frame")) / F.when(F.col("a.frame") > F.col("b.frame"), F.col("a.frame") - F.col("b.frame"))

    def filled(c: str) -> Column:
        line = F.col(f"b.{c}") + (F.col(f"a.{c}") - F.col(f"b.{c}")) * F.coalesce(share, F.lit(0.0))
        return F.coalesce(line, F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)

    return rows.select(*[filled(c) if c in axes else F.col(c) for c in detections.columns])


def _once(rows: DataFrame, of: str) -> DataFrame:
    """Rows (series, frame, of, weight), one a cell: of repeated ones the largest weight. Dealt out by view first, which all that follows needs."""
    return spread(rows, VIEW).groupBy(*SERIES, "frame", of).agg(F.max("weight").alias("weight"))


def affinity_logprobs(affinities: DataFrame, center: float = 0.2, gain: float = 20.0) -> DataFrame:
    """log sigmoid((weight - center) * gain), normalised over the parent's instances; of repeated rows the largest weight counts.

    Rows are dealt out by view, which serves making them distinct, this window, the aggregation by view that the tree
    decoder starts with, and its join: one exchange instead of four.
    """
    score = log_sigmoid((F.coalesce("weight", F.lit(0.0)) - center) * gain)
    normal, _ = log_normalized(F.col("score"), [*SERIES, "frame"])
    return _once(affinities, "parent_instance").withColumn("score", score).withColumn("logp", normal).drop("score")


def identity_logprobs(identities: DataFrame, pseudocount: float = 0.1) -> DataFrame:
    """log(weight + pseudocount), normalised over animals; of repeated rows the largest weight counts. Dealt out by view, like affinities."""
    normal, _ = log_normalized(F.col("score"), [*SERIES, "frame"])
    return _once(identities, "animal").withColumn("score", F.log(F.coalesce("weight", F.lit(0.0)) + pseudocount)).withColumn("logp", normal).drop("score")


def transform_detections(detections: DataFrame, affinities: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outlier probabilities and filled coordinates, affinity and identity log-probabilities."""
    return interpolate(with_outlier_probs(detections)), affinity_logprobs(affinities), identity_logprobs(identities)


def top_detections(peaks: DataFrame, n: int, by: list[str], score: str = "confidence", tie: str = "instance") -> DataFrame:
    """The n best rows of each key, numbered from 0 as `slot`; of equal scores the later one comes first."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.desc(tie)))
    valid = peaks.where(F.col(score).isNotNull() & ~F.isnan(score))
    return valid.withColumn("slot", rank).where(F.col("slot") <= n).withColumn("slot", F.col("slot").cast("long") - 1)


def synchronize(detections: DataFrame, matched: DataFrame) -> DataFrame:
    """Detections of matched frames, with sync_idx as their frame; frames may repeat or be left out."""
    rows = detections.join(matched, ["camera", "frame"])
    return rows.select(*[F.col("sync_idx").alias("frame") if c == "frame" else F.col(c) for c in detections.columns])


def require_equal_lengths(detections: DataFrame) -> DataFrame:
    """Recordings whose cameras have unequal numbers of frames, which need a table of matched frames."""
    each = detections.groupBy("recording", "camera").agg((F.max("frame") + 1).alias("frames"))
    return each.groupBy("recording").agg(F.min("frames").alias("least"), F.max("frames").alias("most")).where("least <> most")


def undistort(detections: DataFrame, lens: Callable[[int], dict], cameras: list[int], steps: int = 5) -> DataFrame:
    """Coordinates without lens distortion; a camera's numbers are constants of the plan."""
    by_camera = [lens(c) for c in cameras]
    place = F.array_position(F.array(*[F.lit(c).cast("long") for c in cameras]), F.col("camera")).cast("int") - 1
    numbers = {k: F.get(F.array(*[F.lit(float(n[k])) for n in by_camera]), place) for k in by_camera[0]}
    fixed = detections.withColumn("fixed", undistorted(F.col("x"), F.col("y"), numbers, steps))
    return fixed.select(*[F.col(f"fixed.{c}").alias(c) if c in ("x", "y") else F.col(c) for c in detections.columns])
