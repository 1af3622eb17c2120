"""K-means over the rows of a table: several starts at once, one pass over the rows a step."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herdframe.sources.shared import removed, written

#: Distances that a task holds at once, and points of a packed block.
CELLS, PACKED = 1 << 22, 4096
#: Partial sums that reach the driver at most; those of more tasks are added up in so many tasks before.
FAN = 64


def _batches(x: np.ndarray, width: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(1, width))
    return (x[k : k + step] for k in range(0, len(x), step))


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (starts, points, clusters)."""
    products = (x @ centroids.reshape(-1, x.shape[1]).T).reshape(len(x), *centroids.shape[:2]).transpose(1, 0, 2)
    return np.maximum((x**2).sum(1)[None, :, None] - 2 * products + (centroids**2).sum(2)[:, None, :], 0)


def seeded_starts(rows: DataFrame, key: str, points: str, k: int, n_init: int) -> np.ndarray:
    """(starts, k, dimensions): for each start the k rows with the smallest digests of start and key; every task keeps its k smallest before they meet."""
    tagged = rows.select(F.col(points).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))).alias("s"), F.col(key).alias("key"))
    tagged = tagged.withColumn("h", F.md5(F.concat_ws("|", F.col("s").cast("string"), F.col("key").cast("string"))))
    rank = F.row_number().over(W.partitionBy("s").orderBy("h", "key"))
    found = tagged.withColumn("rank", rank).where(F.col("rank") <= k).select("s", "rank", "v").collect()
    found.sort(key=lambda r: (r.s, r["rank"]))
    return np.array([[r.v for r in found if r.s == s] for s in range(n_init)], float)


def packed(rows: DataFrame, points: str) -> DataFrame:
    """(n, block): the points as blocks of up to PACKED rows of doubles, made where the rows lie."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PACKED):
                x = _points(batch.column(0).slice(k, PACKED))
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["n", "block"])

    return rows.select(points).mapInArrow(pack, "n int, block binary")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = [np.frombuffer(x.as_buffer()) for batch in batches for x in batch.column(0)]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, 0).tobytes()], pa.binary())], names=["sums"])


def added_up(sums: DataFrame) -> np.ndarray:
    """The sum of all rows (sums binary), as many doubles each. Rows of more than FAN tasks are added up in FAN tasks before any reach the driver."""
    if sums.rdd.getNumPartitions() > FAN:
        sums = sums.repartition(FAN).mapInArrow(_added, "sums binary")
    return np.sum([np.frombuffer(r.sums) for r in sums.collect()] or [np.zeros(1)], 0)


def kmeans_rows(rows: DataFrame, key: str, points: str, k: int, n_init: int = 10, max_iters: int = 100, tol: float = 1e-4) -> DataFrame:
    """(key, cluster): Lloyd's algorithm, the best of n_init starts by inertia (to six decimals, the first of equals).

    A start stops when its inertia changes by less than tol. Ties go to the lowest cluster, and an empty
    one lies at the origin. Rows without a point are left out; of fewer than k rows each is a
    cluster. Points are packed into blocks once. In a step every task sums up its blocks by start and
    cluster into one row; beyond FAN tasks those rows are added up in FAN tasks, so what
    reaches the driver, and goes out again, is a bounded number of times starts x clusters x dimensions.
    """
    rows = rows.where(F.col(points).isNotNull() & F.col(key).isNotNull()).select(key, points)
    centroids = seeded_starts(rows, key, points, k, n_init)
    if not centroids.size:
        return rows.select(key, F.lit(0).cast("long").alias("cluster"))
    size, dims = centroids.shape[1:]
    last, live = np.full(n_init, np.inf), np.arange(n_init)
    final = last.copy()
    blocks = written(packed(rows, points), "points")
    for _ in range(max_iters):
        now = centroids[live]

        def summed(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            n, total, inertia = np.zeros(now.shape[:2]), np.zeros(now.shape), np.zeros(len(now))
            for batch in batches:
                for block in batch.column(1):
                    for x in _batches(np.frombuffer(block.as_buffer()).reshape(-1, dims), now.size):
                        d = _distances(x, now)
                        member = (d.argmin(2)[..., None] == np.arange(size)).astype(float)
                        n += member.sum(1)
                        total += member.transpose(0, 2, 1) @ x
                        inertia += d.min(2).sum(1)
            sums = np.concatenate([n[..., None], total, np.repeat(inertia[:, None], size, 1)[..., None]], 2)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        sums = added_up(blocks.mapInArrow(summed, "sums binary")).reshape(len(live), size, dims + 2)
        inertia = sums[:, 0, -1]
        final[live] = inertia
        moves = np.abs(last[live] - inertia) >= tol
        means = np.where(sums[..., :1] > 0, sums[..., 1:-1] / np.maximum(sums[..., :1], 1), 0.0)
        centroids[live[moves]] = means[moves]
        last[live] = inertia
        live = live[moves]
        if not len(live):
            break
    removed(blocks)
    best = centroids[[int(np.argmin(np.round(final, 6)))]]

    @F.arrow_udf("long")
    def nearest(column: pa.Array) -> pa.Array:
        parts = [_distances(x, best)[0].argmin(1) for x in _batches(_points(column), best.size)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return rows.select(key, nearest(points).alias("cluster"))
