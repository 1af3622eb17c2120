"""Pairs of detections in two cameras: triangulation errors and identity divergences, made in one join."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdframe.functions.scalars import is_missing, jensen_shannon
from herdframe.operators.spread import spread
from herdframe.schemas import CELL, SERIES


def located(detections: DataFrame, most_outlier: float = 0.2) -> DataFrame:
    """Detections that geometry may use: present, and with an outlier probability below the threshold."""
    return detections.where(~is_missing(F.col("x"), F.col("y")) & (F.col("outlier_prob") < most_outlier))


def identity_arrays(identities: DataFrame, n: int, value: str = "logp") -> DataFrame:
    """(recording, frame, camera, keypoint, instance, probs): probabilities of the n animals from log-probabilities."""
    cells = [F.coalesce(F.max(F.when(F.col("animal") == a, F.exp(F.col(value)))), F.lit(0.0)) for a in range(n)]
    return identities.groupBy(*SERIES, "frame").agg(F.array(*cells).alias("probs"))


def camera_pairs(points: DataFrame) -> DataFrame:
    """Each pair of detections of a keypoint in two cameras, cam1 > cam2. The keys are equal, so Spark hashes or sorts."""
    extra = [c for c in points.columns if c not in (*CELL, "camera", "instance")]

    def side(k: int) -> DataFrame:
        return points.select(*CELL, F.col("camera").alias(f"cam{k}"), F.col("instance").alias(f"inst{k}"), *[F.col(c).alias(f"{c}{k}") for c in extra])

    return side(1).join(side(2), CELL).where("cam1 > cam2")


def divergence(p: Column, q: Column) -> Column:
    return jensen_shannon(p, q)


def two_view_errors(p1: np.ndarray, p2: np.ndarray, xy1: np.ndarray, xy2: np.ndarray) -> np.ndarray:
    """Mean pixel distance of two views after linear triangulation; projections (n, 3, 4), points (n, 2)."""
    rows = [xy[:, [d]] * p[:, 2] - p[:, d] for p, xy in ((p1, xy1), (p2, xy2)) for d in (0, 1)]
    point = np.linalg.svd(np.stack(rows, 1))[2][:, -1]

    def error(p: np.ndarray, xy: np.ndarray) -> np.ndarray:
        seen = np.einsum("nij,nj->ni", p, point)
        return np.linalg.norm(seen[:, :2] / seen[:, 2:] - xy, axis=1)

    with np.errstate(all="ignore"):
        return (error(p1, xy1) + error(p2, xy2)) / 2


def triangulation_error(projections: list[list[list[float]]]):  # noqa: ANN201
    """Column function (cam1, cam2, x1, y1, x2, y2): the mean reprojection error, NULL if it or a coordinate isn't finite.

    projections holds one 3 by 4 matrix a camera; a batch of pairs is one call of the SVD.
    """
    table = np.array(projections, float)

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            c1, c2, *xy = (a.to_numpy(zero_copy_only=False) for a in batch)
            if not len(c1):
                yield pa.array([], pa.float64())
                continue
            at = np.stack(xy, 1).astype(float)
            seen, e = np.isfinite(at).all(1), np.full(len(at), np.nan)
            e[seen] = two_view_errors(table[c1[seen]], table[c2[seen]], at[seen, :2], at[seen, 2:])
            yield pa.array(e, pa.float64(), mask=~np.isfinite(e))

    return run.asNondeterministic()  # so that a filter on the error isn't moved below, where the kernel would run once more


def rectified_error(y1: Column, y2: Column) -> Column:
    """The same for the best triangulation in a rectified rig: depth absorbs the difference along rows, so half of that across is left in each view."""
    return F.abs(y1 - y2) / 2


def cell_pairs(points: DataFrame, identity: DataFrame, n: int, value: str = "logp") -> DataFrame:
    """(recording, frame, keypoint, cam1, inst1, x1, y1, probs1, cam2, ..., probs2) with cam1 > cam2.

    A cell has at most cameras x instances detections, so both tables are gathered by cell, one
    exchange each, and the pairs come out of the cell's own array: nothing is joined by pair. Rows
    stay dealt out by cell, which is what the graph stages need. Equal detections count once, and of
    repeated identity rows the largest value.
    """
    each = identity_arrays(spread(identity, CELL), n, value)  # one row a detection, so its place in the cell is a key
    probs = each.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct(F.col("camera") * n + F.col("instance"), "probs"))).alias("p"))
    seen = spread(points, CELL).groupBy(*CELL).agg(F.array_sort(F.collect_set(F.struct("camera", "instance", "x", "y"))).alias("d"))

    def weights(d: str) -> str:
        return f"coalesce(p[{d}.camera * {n} + {d}.instance], array_repeat(0D, {n}))"

    both = "flatten(transform(d, a -> transform(filter(d, b -> b.camera < a.camera), b -> struct(a as u, b as v))))"
    rows = seen.join(probs, CELL).select(*CELL, "p", F.explode(F.expr(both)).alias("e")).select(*CELL, "p", "e.u", "e.v")
    sides = [c for k, d in ((1, "u"), (2, "v")) for c in (F.col(f"{d}.camera").alias(f"cam{k}"), F.col(f"{d}.instance").alias(f"inst{k}"), F.col(f"{d}.x").alias(f"x{k}"), F.col(f"{d}.y").alias(f"y{k}"), F.expr(weights(d)).alias(f"probs{k}"))]
    return rows.select(*CELL, *sides)


def pair_scores(detections: DataFrame, identity: DataFrame, n: int, projections: list[list[list[float]]] | None, most_outlier: float = 0.2) -> DataFrame:
    """(recording, frame, keypoint, cam1, inst1, cam2, inst2, error, divergence); without projections the rig is rectified."""
    pairs = cell_pairs(located(detections, most_outlier), identity, n)
    error = rectified_error(F.col("y1"), F.col("y2")) if projections is None else triangulation_error(projections)("cam1", "cam2", "x1", "y1", "x2", "y2")
    return pairs.select(*CELL, "cam1", "inst1", "cam2", "inst2", error.alias("error"), divergence(F.col("probs1"), F.col("probs2")).alias("divergence"))


def edges(pairs: DataFrame, most_error: float = 15.0, most_divergence: float = 0.1) -> DataFrame:
    """Pairs that agree in place and identity; NULL never agrees."""
    return pairs.where((F.col("error") < most_error) & (F.col("divergence") < most_divergence))


#: The least last coordinate of a unit homogeneous point that isn't counted as lying at infinity.
FAR = 1e-9


def many_view_points(projections: np.ndarray, cameras: list[np.ndarray], xy: list[np.ndarray]) -> np.ndarray:
    """Points in space from two or more views each; cells with equally many views are one SVD. NaN for fewer, and for points out of reach."""
    out, views = np.full((len(cameras), 3), np.nan), np.array(list(map(len, cameras)), np.int64)
    for n in set(views.tolist()) - {0, 1}:
        rows = np.flatnonzero(views == n)
        p = projections[np.stack([cameras[k] for k in rows])]
        at = np.stack([xy[k] for k in rows])
        system = at[..., None] * p[:, :, 2:3] - p[:, :, :2]
        point = np.linalg.svd(system.reshape(len(rows), 2 * n, 4))[2][:, -1]
        near = np.abs(point[:, 3]) > FAR
        out[rows[near]] = point[near, :3] / point[near, 3:]
    return out


#: Inverse iteration as SQL does it: where it starts, what is added to the diagonal, and its steps.
START, SHIFT, STEPS = (1.0, 0.7, 1.3, 0.4), 1e-3, 70


def rectified_points(projections: np.ndarray, cameras: list[np.ndarray], xy: list[np.ndarray]) -> np.ndarray:
    """As many_view_points() for equal cameras side by side, by inverse iteration of all cells at once.

    The steps are those of SQL, number by number, as far points and ends of windows magnify what is left of a difference. They end at the best
    fit, but between two directions that fit nearly alike: of 179,647 points of random views 37 are elsewhere in four decimals.
    """
    (f, cx, cy), shifts = projections[0, [0, 0, 1], [0, 2, 2]], -projections[:, 0, 3]
    if any((p != [[f, 0, cx, -t], [0, f, cy, 0], [0, 0, 1, 0]]).any() for p, t in zip(projections, shifts, strict=True)):
        raise ValueError("the cameras aren't equal and side by side")
    views = np.array(list(map(len, cameras)), np.int64)
    out, seen = np.full((len(views), 3), np.nan), views > 1
    if not seen.any():
        return out
    cell, place = np.repeat(np.arange(len(views)), views), np.concatenate(xy)
    u, v, t = place[:, 0] - cx, place[:, 1] - cy, shifts[np.concatenate(cameras).astype(np.int64)]
    a, m02, m03, m12, m22, m23, m33 = (x[seen] for x in (f * f * views + SHIFT, *(s * np.bincount(cell, x, len(views)) + d for s, x, d in ((-f, u, 0), (-f, t, 0), (-f, v, 0), (1, u * u + v * v, SHIFT), (1, u * t, 0), (1, t * t, SHIFT)))))
    s22, s23, s33 = m22 - (m02 * m02 + m12 * m12) / a, m23 - m02 * m03 / a, m33 - m03 * m03 / a  # X and Y don't meet in the matrix, so they go first
    det = s22 * s33 - s23 * s23
    x, y, z, w = (np.full(len(a), c) for c in START)
    for _ in range(STEPS):
        p, q = z - m02 * x / a - m12 * y / a, w - m03 * x / a
        z, w = (s33 * p - s23 * q) / det, (s22 * q - s23 * p) / det
        x, y = (x - m02 * z - m03 * w) / a, (y - m12 * z) / a
        norm = np.sqrt(x * x + y * y + z * z + w * w)
        x, y, z, w = x / norm, y / norm, z / norm, w / norm
    near = np.abs(w) > FAR
    out[np.flatnonzero(seen)[near]] = np.stack([c[near] / w[near] for c in (x, y, z)], 1)
    return out


def triangulated(located_by_animal: DataFrame, projections: list[list[list[float]]], solved: Callable[..., np.ndarray] = many_view_points) -> DataFrame:
    """(recording, frame, keypoint, animal, x, y, z) of what at least two cameras see; at most one row a camera and cell."""
    table = np.array(projections, float)
    seen = located_by_animal.where(~is_missing(F.col("x"), F.col("y")))
    cells = seen.groupBy(*CELL, "animal").agg(F.array_sort(F.collect_list(F.struct("camera", "x", "y"))).alias("views")).where(F.size("views") > 1)

    @F.arrow_udf("x double, y double, z double")
    def solve(views: pa.Array) -> pa.Array:
        rows = views.to_pylist()
        points = solved(table, [np.array([v["camera"] for v in r]) for r in rows], [np.array([[v["x"], v["y"]] for v in r], float) for r in rows])
        bad = ~np.isfinite(points).all(1)
        return pa.StructArray.from_arrays([pa.array(points[:, d], pa.float64(), mask=bad) for d in range(3)], ["x", "y", "z"])

    once = solve.asNondeterministic()  # or the filter would be moved below and run the kernel a second time
    return cells.select(*CELL, "animal", once("views").alias("point")).select(*CELL, "animal", "point.x", "point.y", "point.z").where("x is not null")


def pairwise_median(projections: np.ndarray, cameras: list[np.ndarray], xy: list[np.ndarray]) -> np.ndarray:
    """The coordinate-wise median over the points that each two of a cell's views give; NaN for fewer than two views, and if no pair has a point within reach."""
    first, second, of = [], [], []
    at = np.append(0, np.cumsum(list(map(len, cameras)))).astype(int)
    for k, c in enumerate(cameras):
        i, j = np.triu_indices(len(c), 1)
        first.append(at[k] + i)
        second.append(at[k] + j)
        of.append(np.full(len(i), k))
    out = np.full((len(cameras), 3), np.nan)
    if not sum(map(len, of)):
        return out
    first, second, of = (np.concatenate(x) for x in (first, second, of))
    camera, place = np.concatenate(cameras), np.concatenate(xy)
    both = np.stack([first, second], 1)
    points = many_view_points(projections, list(camera[both]), list(place[both]))
    fine = np.isfinite(points).all(1)
    points, of = points[fine], of[fine]
    pairs = np.bincount(of, minlength=len(cameras))
    for n in set(pairs.tolist()) - {0}:  # cells with equally many points are one median
        rows = np.flatnonzero(pairs == n)
        out[rows] = np.median(points[np.isin(of, rows)].reshape(len(rows), n, 3), axis=1)
    return out


def robust_points(located_by_animal: DataFrame, projections: list[list[list[float]]]) -> DataFrame:
    """(recording, frame, keypoint, animal, x, y, z) as triangulated(), but by the median over pairs of cameras: one wild camera of five is in 4 of 10 pairs and doesn't move it (of four, in half of them)."""
    return triangulated(located_by_animal, projections, pairwise_median)


def projected(points: DataFrame, projections: list[list[list[float]]]) -> DataFrame:
    """Points (..., x, y, z) in every camera: (..., camera, px, py). Matrices are constants of the plan."""
    cameras = []
    for c, p in enumerate(projections):
        u, v, w = (sum((F.lit(float(row[d])) * F.col(a) for d, a in enumerate("xyz")), F.lit(float(row[3]))) for row in p)
        depth = F.when(w != 0, w)
        cameras.append(F.struct(F.lit(c).cast("long").alias("camera"), (u / depth).alias("px"), (v / depth).alias("py")))
    return points.select(*[c for c in points.columns if c not in "xyz"], F.inline(F.array(*cameras)))
