"""Keypoint views that Spark derives from the events table: N animals, K keypoints in a chain, C cameras.

Integer arithmetic only, so any SQL engine derives the same rows. Event e is instance e % 2 of
keypoint e div 2 % 4 in camera e div 8 % 3 of frame e div 24; a recording is FRAMES frames.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N, K, C, FRAMES = 2, 4, 3, 100
PARENTS = [0, 0, 1, 2]
NAMES = ["nose", "neck", "spine", "tail"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props")
    return e.select(
        F.concat(F.lit("rec"), F.expr("event_id div 24 div 100")).alias("recording"),
        F.expr("event_id div 8 % 3").alias("camera"),
        F.expr("event_id div 24").alias("frame"),
        F.expr("event_id div 2 % 4").alias("keypoint"),
        F.expr("event_id % 2").alias("instance"),
        "event_id",
        "user_id",
        (F.col("event_type") == "error").alias("missing"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    seen = ~F.col("missing")
    return e.select(
        "recording",
        "camera",
        "frame",
        "keypoint",
        "instance",
        F.when(seen, F.col("value")).alias("x"),
        F.when(seen, F.col("k")).alias("y"),
        F.when(seen, F.expr("user_id * 37 % 101") / 101).otherwise(0.0).alias("confidence"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("animal", F.explode(F.array(*[F.lit(a).cast("long") for a in range(N)])))
    return e.select("recording", "camera", "frame", "keypoint", "instance", "animal", (F.expr("(event_id * 31 + animal * 53) % 97") / 97).alias("weight"))


def affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("keypoint > 0").withColumn("parent_instance", F.explode(F.array(*[F.lit(a).cast("long") for a in range(N)])))
    parent = F.expr("frame * 24 + camera * 8 + (keypoint - 1) * 2 + parent_instance")
    return e.select("recording", "camera", "frame", "keypoint", "instance", "parent_instance", ((F.col("event_id") * 13 + parent * 7) % 89 / 89).alias("weight"))


def matched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras start one frame apart: sync_idx s is frame s + camera."""
    frames = events(spark, sf_dir).select("camera", "frame").distinct()
    return frames.where("frame >= camera").select((F.col("frame") - F.col("camera")).alias("sync_idx"), "camera", "frame")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses in 3-D, one for each (frame, instance): x and y of the first two cameras."""
    d = detections(spark, sf_dir)
    one = d.where("camera = 0").select("frame", "instance", "keypoint", "x", "y")
    two = d.where("camera = 1").select("frame", "instance", "keypoint", F.col("y").alias("z"))
    return one.join(two, ["frame", "instance", "keypoint"]).select((F.col("frame") * N + F.col("instance")).alias("pose_id"), "keypoint", "x", "y", "z")


def intrinsics(camera: int) -> dict:
    """A rectified rig: equal cameras side by side, with a little lens distortion."""
    return {"fx": 300.0, "fy": 300.0, "cx": 245.0, "cy": 50.0, "k1": -0.05 * (camera + 1), "k2": 0.01, "p1": 0.001, "p2": -0.002, "k3": 0.0}


def projection(camera: int) -> list[list[float]]:
    return [[300.0, 0.0, 245.0, -150.0 * camera], [0.0, 300.0, 50.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
