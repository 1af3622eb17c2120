"""Poses: bone-length filter, egocentric alignment, bone directions, and a mixture of von Mises-Fisher directions."""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from herdframe.functions.scalars import angle
from herdframe.operators.clustering import added_up, packed
from herdframe.operators.spread import dense
from herdframe.operators.transforms import interpolate
from herdframe.sources.shared import removed, written


def bones(poses: DataFrame, parents: list[int]) -> DataFrame:
    """(pose_id, keypoint, dx, dy, dz, length): each keypoint but the root less its parent. NULL if either is missing."""
    parent = F.array(*[F.lit(p).cast("long") for p in parents])
    child = poses.withColumn("parent", parent[F.col("keypoint").cast("int")]).where("parent <> keypoint")
    above = poses.select("pose_id", F.col("keypoint").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    d = child.join(above, ["pose_id", "parent"]).select("pose_id", "keypoint", (F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy"), (F.col("z") - F.col("pz")).alias("dz"))
    return d.withColumn("length", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2))


def complete(lengths: DataFrame, n_bones: int) -> DataFrame:
    """Bones of poses that have all of them."""
    whole = lengths.groupBy("pose_id").agg(F.count("length").alias("n")).where(F.col("n") == n_bones).select("pose_id")
    return lengths.join(whole, "pose_id", "left_semi")


def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; its own inverse on their bits."""
    bits = v.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


#: Bits of a number that a round of the selection tells apart: so many counters a key and wanted rank at most.
DIGIT = 16


def exact_percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column a name in shares): exact percentiles, linear between neighbours, in bounded memory. Null and NaN don't count.

    Radix selection over the bits of the doubles, for all keys and ranks at once: a round counts
    values by key and their next DIGIT bits, with partial sums, and keeps for each wanted rank the
    run of bits that holds it. The first round counts all values, each other one those that begin like a wanted
    one. So no array grows with the rows, and a key's values lie in one task only as counters.
    """

    @F.arrow_udf("long")
    def ordered(v: pa.Array) -> pa.Array:
        return pa.array(_ordered(v.to_numpy() + 0.0))  # -0.0 is 0.0

    @F.arrow_udf("double")
    def restored(bits: pa.Array) -> pa.Array:
        return pa.array(_ordered(bits.to_numpy()).view(np.float64))

    v = F.col(value).cast("double")
    rows = written(rows.where(v.isNotNull() & ~F.isnan(v)).select(F.col(by).alias("of"), ordered(v).alias("bits")), "bits")
    place = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for k, p in enumerate(shares.values())])
    shift = 64 - DIGIT
    counts = rows.groupBy("of", F.shiftright("bits", shift).alias("cell")).agg(F.count("*").alias("c"))
    each = counts.withColumn("upto", F.sum("c").over(W.partitionBy("of").orderBy("cell"))).withColumn("n", F.sum("c").over(W.partitionBy("of")))
    each = each.select("of", "cell", "c", "upto", F.inline(place)).select("of", "cell", "c", "upto", "k", "place", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    held = each.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))).select("of", "k", "place", "rank", (F.col("rank") - F.col("upto") + F.col("c")).alias("left"), "cell")
    while shift:
        shift -= DIGIT
        inside = rows.select("of", F.shiftright("bits", shift).alias("next"), F.shiftright("bits", shift + DIGIT).alias("cell")).join(held, ["of", "cell"])
        counts = inside.groupBy("of", "k", "place", "rank", "left", "next").agg(F.count("*").alias("c"))
        counts = counts.withColumn("upto", F.sum("c").over(W.partitionBy("of", "k", "rank").orderBy("next")))
        hit = (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c"))
        held = counts.where(hit).select("of", "k", "place", "rank", (F.col("left") - F.col("upto") + F.col("c")).alias("left"), F.col("next").alias("cell"))
    found = held.withColumn("v", restored("cell")).groupBy("of", "k", "place").agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"))
    share = F.col("place") - F.floor("place")
    return found.groupBy(F.col("of").alias(by)).agg(*[F.max(F.when(F.col("k") == k, F.col("low") + (F.col("high") - F.col("low")) * share)).alias(name) for k, name in enumerate(shares)])


def bone_stats(lengths: DataFrame) -> DataFrame:
    """(keypoint, low, high): the first and last percentile of each bone's length, one row a keypoint."""
    return exact_percentiles(lengths, "keypoint", "length", {"low": 0.01, "high": 0.99})


def bone_lengths(poses: DataFrame, parents: list[int]) -> DataFrame:
    """(pose_id, lengths): the bones of each pose that has all of them, in order of keypoints, from one pass without joins."""
    k = len(parents)
    there = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), 1.0).otherwise(0.0)
    wide = dense(poses, ["pose_id"], F.col("keypoint"), k, x="x", y="y", z="z", there=there)
    whole = wide.where(F.forall("there", lambda t: t > 0))
    up = "array(" + ", ".join(map(str, parents)) + ")"
    long = F.expr(f"transform(filter(sequence(0, {k - 1}), k -> {up}[k] <> k), k -> sqrt(power(x[k] - x[{up}[k]], 2) + power(y[k] - y[{up}[k]], 2) + power(z[k] - z[{up}[k]], 2)))")
    return whole.select("pose_id", long.alias("lengths"))


def filter_poses(poses: DataFrame, parents: list[int], most_std: float) -> tuple[DataFrame, DataFrame]:
    """Poses without odd bones, and (keypoint, mean, std) of the others.

    A pose goes if it lacks a bone, if a bone is outside its percentiles, or if it then is over
    most_std deviations from the mean. Lengths are written once, a row a pose; of the percentiles a row
    a bone reaches the driver.
    """
    children = [k for k, p in enumerate(parents) if p != k]
    lengths = written(bone_lengths(poses, parents), "lengths")
    each = lengths.select(F.posexplode("lengths").alias("at", "length")).select(F.element_at(F.array(*[F.lit(k).cast("long") for k in children]), F.col("at") + 1).alias("keypoint"), "length")
    limits = {r.keypoint: (r.low, r.high) for r in bone_stats(each).collect()}
    at = lambda k: F.col("lengths")[children.index(k)]
    fine = [at(k).between(low, high) for k, (low, high) in limits.items()]
    left = lengths.where(reduce(lambda a, b: a & b, fine)) if fine else lengths.limit(0)
    sums = left.agg(*[f(at(k)).alias(f"{n}{k}") for k in children for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    sums = written(sums, "sums")
    stats = sums.select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("keypoint"), F.col(f"mean{k}").alias("mean"), F.col(f"std{k}").alias("std")) for k in children]))).where("mean is not null")
    row = sums.first()
    near = [F.abs(at(k) - F.lit(row[f"mean{k}"])) < most_std * F.lit(row[f"std{k}"]) for k in children]
    return poses.join(left.where(reduce(lambda a, b: a & b, near)).select("pose_id"), "pose_id", "left_semi"), stats


def standardize(poses: DataFrame, front: int, back: int) -> DataFrame:
    """Poses around their own centre, turned so that the way from back to front lies along the first axis."""
    w = W.partitionBy("pose_id")

    def centred(c: str) -> Column:
        return F.col(c) - F.avg(c).over(w)

    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("keypoint") == k, F.col(c))).over(w)

    rows = poses.select("pose_id", "keypoint", *[centred(c).alias(c) for c in "xyz"], angle(at(front, "x") - at(back, "x"), at(front, "y") - at(back, "y")).alias("heading"))
    c, s = F.cos("heading"), F.sin("heading")
    return rows.select("pose_id", "keypoint", (F.col("x") * c + F.col("y") * s).alias("x"), (F.col("y") * c - F.col("x") * s).alias("y"), "z")


def directions(poses: DataFrame, parents: list[int]) -> DataFrame:
    """(pose_id, keypoint, x, y, z): unit vectors to each keypoint from its parent, of poses that have all of them."""
    d = complete(bones(poses, parents), len(parents) - 1)
    return d.select("pose_id", "keypoint", *[(F.col(f"d{c}") / (F.col("length") + 1e-16)).alias(c) for c in "xyz"])


def log_norm(kappa: float, dims: int = 3) -> float:
    """log of the normaliser of a von Mises-Fisher density on the circle (dims 2) or the sphere (3)."""
    if dims == 2:
        if kappa < 50:
            return -math.log(2 * math.pi) - math.log(float(np.i0(kappa)))
        series = 1 + 1 / (8 * kappa) + 9 / (128 * kappa**2) + 225 / (3072 * kappa**3)
        return -math.log(2 * math.pi) - kappa + 0.5 * math.log(2 * math.pi * kappa) - math.log(series)
    if kappa < 1e-6:
        return -math.log(4 * math.pi)
    return math.log(kappa) - math.log(2 * math.pi) - kappa - math.log1p(-math.exp(-2 * kappa))


def jittered(units: DataFrame, size: float = 1e-3, dims: int = 3) -> DataFrame:
    """Directions with noise of up to `size` on each axis, from a hash of pose, keypoint and axis: equal directions aren't quite equal any more."""
    noise = {c: (F.pmod(F.xxhash64("pose_id", "keypoint", F.lit(c)), F.lit(1 << 30)) / float(1 << 29) - 1) * size for c in "xyz"[:dims]}
    return units.withColumns({c: F.col(c) + n for c, n in noise.items()})


def _mean_length(kappa: float, dims: int) -> float:
    """The mean resultant length of a von Mises-Fisher density."""
    if dims == 2:
        return float(_bessel_ratio(kappa))
    return kappa / 3 if kappa < 1e-4 else 1 / math.tanh(kappa) - 1 / kappa


def _bessel_ratio(kappa: float) -> float:
    """I1 / I0, by its continued fraction from the far end, or by its series for large kappa."""
    if kappa > 500:
        return 1 - 1 / (2 * kappa) - 1 / (8 * kappa**2)
    ratio = 0.0
    for k in range(60 + int(kappa), 0, -1):
        ratio = kappa / (2 * k + kappa * ratio)
    return ratio


def concentration(rbar: float, dims: int, exact: bool = False) -> float:
    """kappa for a mean resultant length: the usual approximation, or the maximum of the likelihood by bisection."""
    about = rbar * (dims - rbar**2) / (1 - rbar**2)
    if not exact or rbar <= 0:
        return about
    low, high = 0.0, max(4 * about, 1.0)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _mean_length(middle, dims) < rbar else (low, middle)
    return (low + high) / 2


def packed_directions(units: DataFrame, keypoints: list[int], dims: int = 3) -> DataFrame:
    """(n, block): directions (pose_id, keypoint, x, y, z) as blocks of poses x keypoints x dimensions, of poses that have all of these keypoints."""
    place = F.element_at(F.create_map(*[F.lit(v) for k, j in enumerate(keypoints) for v in (j, k)]), F.col("keypoint").cast("int"))
    rows = units.where(F.col("keypoint").isin(keypoints))
    wide = dense(rows, ["pose_id"], place, len(keypoints), **{c: c for c in "xyz"[:dims]}, there=F.lit(1.0)).where(F.forall("there", lambda t: t > 0))
    cells = F.expr(f"flatten(transform(sequence(0, {len(keypoints) - 1}), k -> array({', '.join(f'{c}[k]' for c in 'xyz'[:dims])})))")
    return packed(wide.select(cells.alias("v")), "v")


def movmf_sums(blocks: DataFrame, mixture: list[dict], keypoints: list[int], dims: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The E-step over packed poses: weights of states, weighted sums of directions (states, keypoints, dimensions), the sum of log-likelihoods, and how many poses.

    A block meets all states in one matrix product, and its sums are another; every task adds up its blocks to one
    row, and rows of many tasks are added up in Spark (clustering.added_up).
    """
    mu = np.array([[np.asarray(s["bones"][k][0], float) * s["bones"][k][1] for k in keypoints] for s in mixture]).reshape(len(mixture), -1)
    base = np.array([math.log(s["pi"]) + sum(log_norm(s["bones"][k][1], dims) for k in keypoints) for s in mixture])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(mu), mu.shape[1] + 1))
        more = np.zeros(2)
        for batch in batches:
            for block in batch.column(1):
                x = np.frombuffer(block.as_buffer()).reshape(-1, mu.shape[1])
                logs = x @ mu.T + base
                top = logs.max(1)
                total = top + np.log(np.exp(logs - top[:, None]).sum(1))
                r = np.exp(logs - total[:, None])
                out[:, 0] += r.sum(0)
                out[:, 1:] += r.T @ x
                more += total.sum(), len(x)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(out, more).tobytes()], pa.binary())], names=["sums"])

    sums = added_up(blocks.mapInArrow(summed, "sums binary"))
    each = sums[:-2].reshape(len(mu), -1)
    return each[:, 0], each[:, 1:].reshape(len(mu), len(keypoints), dims), float(sums[-2]), int(round(sums[-1]))


def movmf_update(sums: tuple[np.ndarray, np.ndarray, float, int], keypoints: list[int], dims: int, exact: bool = False) -> list[dict]:
    """The M-step: the mixture that these sums give."""
    n, total, _, poses = sums
    out = []
    for s in range(len(n)):
        bones = {}
        for j, k in enumerate(keypoints):
            long = float(np.sqrt((total[s, j] ** 2).sum()))
            rbar = min(long / max(float(n[s]), 1e-12), 1 - 1e-9)
            bones[k] = ([float(v) for v in total[s, j] / max(long, 1e-12)], float(concentration(rbar, dims, exact)))
        out.append({"pi": float(n[s] / max(poses, 1)), "bones": bones})
    return out


def movmf_step(units: DataFrame, mixture: list[dict], dims: int = 3) -> DataFrame:
    """One EM step of a mixture of von Mises-Fisher directions in two or three dimensions over whole poses.

    mixture: one dict a state with `pi` and, for each keypoint, `mu` (dims numbers) and `kappa`.
    Rows: (state, keypoint, pi, mu_x, mu_y, mu_z, kappa, log_likelihood), the mean log-likelihood being that before the step.
    """
    keypoints = sorted(mixture[0]["bones"])
    sums = movmf_sums(packed_directions(units, keypoints, dims), mixture, keypoints, dims)
    axes = "xyz"[:dims]
    mean = sums[2] / max(sums[3], 1)
    rows = [(s, k, state["pi"], *mu, kappa, mean) for s, state in enumerate(movmf_update(sums, keypoints, dims)) for k, (mu, kappa) in state["bones"].items()] if sums[3] else []
    return units.sparkSession.createDataFrame(rows, f"state long, keypoint long, pi double, {', '.join(f'mu_{c} double' for c in axes)}, kappa double, log_likelihood double")


#: Poses among which the first states are chosen.
SEEDS = 4096


def seeded_mixture(blocks: DataFrame, n_states: int, keypoints: list[int], dims: int, seed: int) -> list[dict]:
    """First states at poses that lie far from each other: each next one is drawn by its squared distance from those before, among SEEDS poses of the first blocks."""
    rng = np.random.default_rng(seed)
    x = [np.frombuffer(r.block).reshape(r.n, -1) for r in blocks.where("n > 0").limit(max(1, SEEDS // 64)).collect()]
    x = np.concatenate(x)[:SEEDS] if x else np.zeros((0, len(keypoints) * dims))
    if not len(x):
        x = rng.normal(size=(n_states, len(keypoints) * dims))
    chosen = []
    for _ in range(n_states):
        far = np.min([((x - c) ** 2).sum(1) for c in chosen], 0) if chosen else np.ones(len(x))
        chosen.append(x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))])
    out = []
    for c in chosen:
        v = c.reshape(len(keypoints), dims)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        out.append({"pi": 1 / n_states, "bones": {k: (v[j].tolist(), 1.0) for j, k in enumerate(keypoints)}})
    return out


def fit_movmf(units: DataFrame, n_states: int, n_iters: int, n_keypoints: int, seed: int = 0, dims: int = 3, jitter: float = 1e-3, still: float = 0.0) -> tuple[list[dict], list[float]]:
    """EM from seeded starts: the mixture and the mean log-likelihood of each step, which never falls; it stops early once a step gains less than `still`.

    Directions get their jitter first and are written once, packed; a step is one job over the blocks whose cost hardly depends on
    the number of states, and only sums reach the driver. The
    root, which has no direction, is keypoint 0 of each state: along the first axis with kappa 0.
    """
    keypoints = list(range(1, n_keypoints))
    blocks = written(packed_directions(jittered(units, jitter, dims) if jitter else units, keypoints, dims), "units")
    mixture = seeded_mixture(blocks, n_states, keypoints, dims, seed)
    history = []
    for _ in range(n_iters):
        sums = movmf_sums(blocks, mixture, keypoints, dims)
        if not sums[3]:
            break
        history.append(sums[2] / sums[3])
        mixture = movmf_update(sums, keypoints, dims, exact=True)
        for state in mixture:
            state["pi"] = max(state["pi"], 1e-12)
        if len(history) > 1 and history[-1] - history[-2] < still:
            break
    for state in mixture:
        state["bones"][0] = ([1.0] + [0.0] * (dims - 1), 0.0)
    removed(blocks)
    return mixture, history


def gimbal_params(parents: list[int], mixture: list[dict], radii: list[float] | None = None, radii_std: list[float] | None = None, outlier_variance: float = 1e6, inlier_variance: float = 10.0, motion_variance: float = 5.0, leapfrog_steps: int = 5, step_size: float = 0.5, front_back: tuple[int, int] | None = None, projections: list | None = None) -> dict:
    """The parameters that a pose model takes: isotropic covariances, a free root radius, uniform transition counts."""
    k, s = len(parents), max(1, len(mixture))

    def scaled(v: float) -> list[list[float]]:
        return [[v, 0.0], [0.0, v]]

    return {
        "parents": parents,
        "obs_outlier_covariance": scaled(outlier_variance),
        "obs_inlier_covariance": scaled(inlier_variance),
        "pos_dt_variance": [motion_variance] * k,
        "pos_radius": radii or [0.0] * k,
        "pos_radial_variance": [1e8, *[v * v for v in (radii_std or [1.0] * k)[1:]]],
        "state_transition_counts": [[1.0] * s for _ in range(s)],
        "mixture": mixture,
        "num_leapfrog_steps": leapfrog_steps,
        "hmc_step_size": step_size,
        "indices_egocentric": front_back,
        "camera_matrices": projections,
    }


def crop_centroids(detections: DataFrame, sigma: int = 10, segment: int = 10_000) -> DataFrame:
    """(recording, camera, frame, cx, cy): the median of all animals' keypoints, smoothed by a normal kernel along frames.

    Missing coordinates are interpolated along their series first. The kernel ends at 4 sigma, and
    at the ends of a recording it goes on over the frames in reverse. Frames are smoothed by segments
    that hold the frames within reach on either side, so a task is bounded by the segment. A
    frame without any coordinate counts neither for itself nor for its neighbours.
    """
    view, reach = ["recording", "camera"], 4 * sigma
    filled = interpolate(detections)
    frames = filled.groupBy(*view, "frame").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    ends = frames.groupBy(*view).agg(F.min("frame").alias("first"), (F.max("frame") - F.min("frame") + 1).alias("long"))
    rows = frames.join(ends, view)
    at, long = F.col("frame") - F.col("first"), F.col("long")
    turns = F.sequence(-F.ceil(reach / (2 * long)), F.ceil(reach / (2 * long)) + 1)
    images = F.filter(F.flatten(F.transform(turns, lambda k: F.array(2 * long * k + at, 2 * long * k - 1 - at))), lambda p: (p >= -reach) & (p < long + reach))
    inside = (at >= reach) & (at < long - reach)
    rows = rows.select(*view, "first", "long", "mx", "my", F.explode(F.when(inside, F.array(at)).otherwise(images)).alias("place"))
    last = F.floor((long - 1) / segment)
    piece = lambda shift: F.least(F.greatest(F.floor((F.col("place") + shift) / segment), F.lit(0)), last)
    rows = rows.withColumn("segment", F.explode(F.sequence(piece(-reach), piece(reach))))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2.0 * sigma * sigma))

    def smooth(table: pa.Table) -> pa.Table:
        place = table.column("place").to_numpy()
        own = (place >= 0) & (place < table.column("long")[0].as_py()) & (place // segment == table.column("segment")[0].as_py())
        low = place.min() - reach
        out = {}
        for c, m in (("cx", "mx"), ("cy", "my")):
            v = table.column(m).to_numpy().astype(float)
            there = ~np.isnan(v)
            total, weight = (np.bincount(place[there] - low, w, place.max() - low + reach + 1) for w in (v[there], None))
            total, weight = np.convolve(total, kernel, "same"), np.convolve(weight, kernel, "same")
            spot = place[own] - low
            some = np.convolve(np.bincount(place[there] - low, minlength=len(total)) > 0, np.ones(len(kernel)), "same")[spot] > 0.5
            with np.errstate(all="ignore"):
                out[c] = pa.array(total[spot] / weight[spot], pa.float64(), mask=~some)
        keys = table.filter(pa.array(own))
        frame = pa.array(place[own] + table.column("first")[0].as_py(), pa.int64())
        return pa.table({"recording": keys.column("recording"), "camera": keys.column("camera"), "frame": frame, **out})

    return rows.groupBy(*view, "segment").applyInArrow(smooth, "recording string, camera long, frame long, cx double, cy double")


def overlay_segments(detections: DataFrame, parents: list[int], width: float, height: float, keypoints: list[int] | None = None) -> DataFrame:
    """(recording, camera, frame, instance, keypoint, x, y, px, py): bones with both ends on the image, and among `keypoints` if some are chosen."""
    if keypoints is not None:
        detections = detections.where(F.col("keypoint").isin(keypoints))
    parent = F.array(*[F.lit(p).cast("long") for p in parents])
    on = detections.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).select("recording", "camera", "frame", "instance", "keypoint", "x", "y")
    child = on.withColumn("parent", parent[F.col("keypoint").cast("int")]).where("parent <> keypoint")
    above = on.select("recording", "camera", "frame", "instance", F.col("keypoint").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    return child.join(above, ["recording", "camera", "frame", "instance", "parent"]).drop("parent")


def pose_windows(poses: DataFrame, window: float = 150.0) -> DataFrame:
    """(pose_id, x_low, x_high, y_low, y_high): a window around the median of a pose."""
    half = window // 2
    m = poses.groupBy("pose_id").agg(F.median("x").alias("x"), F.median("y").alias("y"))
    return m.select("pose_id", *[(F.col(c) + sign * half).alias(f"{c}_{name}") for c in "xy" for name, sign in (("low", -1), ("high", 1))])
