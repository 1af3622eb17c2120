"""Frame-local operators on streams of detections.

What looks at one frame only runs on a stream as it is. Cells are gathered by event time with a
watermark, so the state of a frame goes once it can't change any more.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdframe.operators.permutations import all_permutations


def best_identities(identities: DataFrame, n: int, time: str = "ts", late: str = "10 seconds", value: str = "logp") -> DataFrame:
    """The most likely permutation of each (recording, frame, camera, keypoint) of a stream, once its frame is complete.

    Rows have a timestamp `time`; all rows of a frame share it. Rows later than `late` are left out, and of
    repeated ones the largest value counts.
    """
    by = ["recording", "frame", "camera", "keypoint"]
    cells = [F.coalesce(F.max(F.when((F.col("instance") == i) & (F.col("animal") == a), F.col(value))), F.lit(0.0)).alias(f"s{i}_{a}") for i in range(n) for a in range(n)]
    wide = identities.withWatermark(time, late).groupBy(F.window(time, "1 second").alias("w"), *by).agg(*cells)
    best = F.array_max(F.array(*[F.struct(F.round(sum((F.col(f"s{i}_{a}") for a, i in enumerate(p)), F.lit(0.0)), 9).alias("score"), F.lit(-k).cast("long").alias("minus_p")) for k, p in enumerate(all_permutations(n))]))
    return wide.select(*by, best.alias("b")).select(*by, (-F.col("b.minus_p")).alias("p"), F.col("b.score").alias("score"))
