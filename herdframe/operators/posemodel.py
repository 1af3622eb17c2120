"""A pose model of an animal, sampled: keypoints in the image or in space, headings, and pose states along time.

A body's keypoints are seen through cameras with outliers, hang on their parents by bones of about
one length, point in directions that a pose state prefers (in the frame of the animal's heading), and
move little from frame to frame. Pose states are a Markov chain. One step draws each of these given the others:

- positions by Hamiltonian Monte Carlo, a body and frame at a time. Given their neighbours, frames
  of equal parity don't meet, so all of them move at once. Segments of frames are tasks' groups; even
  and odd segments move in turn, each with the frame before and after it as its halo, so a
  recording may be of any length and no frame sees a neighbour that moves meanwhile.
- headings from a von Mises density, whose direction and concentration come from the bones.
- states by filtering forwards and sampling backwards. A segment is one matrix, the sum over all
  paths through it; a recording's matrices give the states at segments' ends, and segments are
  filled in between their ends.
- transitions from a Dirichlet density around counts of moves, which are sums over rows.

All noise comes from digests of (track, frame, seed), so samples don't depend on partitions and an
executor that is lost changes nothing. State is a table in the shared folder after each half step.
"""

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdframe.functions.scalars import angle, is_missing, mixture_log
from herdframe.operators.geometry import projected, robust_points
from herdframe.operators.poses import log_norm
from herdframe.operators.spread import dense
from herdframe.operators.transforms import interpolate
from herdframe.operators.tree import noise_key, uniform_noise
from herdframe.schemas import SERIES
from herdframe.sources.shared import removed, written

#: Draws of a heading before its centre stands. A frame's uniform numbers are one sequence: those of its positions, its heading, and its state.
TRIES = 16


@dataclass
class Body:
    """What is fixed: the skeleton with its priors, the states' directions, the cameras, and the sampler's steps.

    Arrays are by keypoint (K), state (S), camera (C) and dimension (D = 2 without projections, else 3).
    """

    parents: list[int]
    radius: np.ndarray
    radial_variance: np.ndarray
    motion_variance: np.ndarray
    mu: np.ndarray
    kappa: np.ndarray
    inlier: float = 10.0
    outlier: float = 1e6
    leapfrog_steps: int = 5
    step_size: float = 0.5
    front_back: tuple[int, int] = (0, 1)
    projections: np.ndarray | None = None
    transitions: np.ndarray = field(default_factory=lambda: np.ones((1, 1)))

    def __post_init__(self):
        if len(self.transitions) != len(self.mu):
            self.transitions = np.full((len(self.mu), len(self.mu)), 1 / len(self.mu))

    @classmethod
    def from_params(cls, params: dict) -> "Body":
        """From what poses.gimbal_params collects."""
        mixture, k = params["mixture"], len(params["parents"])
        dims = 2 if params["camera_matrices"] is None else 3
        mu, kappa = np.zeros((max(1, len(mixture)), k, dims)), np.zeros((max(1, len(mixture)), k))
        mu[..., 0] = 1.0
        for s, state in enumerate(mixture):
            for j, (m, c) in state["bones"].items():
                mu[s, j], kappa[s, j] = m, c
        arrays = [np.asarray(params[n], float) for n in ("pos_radius", "pos_radial_variance", "pos_dt_variance")]
        counts = np.asarray(params["state_transition_counts"], float)
        cameras = None if dims == 2 else np.asarray(params["camera_matrices"], float)
        return cls(list(params["parents"]), *arrays, mu, kappa, params["obs_inlier_covariance"][0][0], params["obs_outlier_covariance"][0][0], params["num_leapfrog_steps"], params["hmc_step_size"], params["indices_egocentric"] or (0, k - 1), cameras, counts / counts.sum(1, keepdims=True))

    @property
    def dims(self) -> int:
        return self.mu.shape[2]

    @property
    def size(self) -> int:
        """Numbers of a body's positions."""
        return len(self.parents) * self.dims

    def seen(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pixels (B, C, K, 2) of positions (B, K, D), and their derivatives (B, C, K, 2, D)."""
        if self.projections is None:
            return x[:, None], np.broadcast_to(np.eye(2), (len(x), 1, x.shape[1], 2, 2))
        at = np.einsum("cij,bkj->bcki", self.projections[:, :, :3], x) + self.projections[:, None, :, 3]
        depth = np.where(np.abs(at[..., 2:]) < 1e-9, 1e-9, at[..., 2:])
        pixel = at[..., :2] / depth
        p = self.projections[None, :, None]
        return pixel, (p[..., :2, :3] - pixel[..., None] * p[..., 2:, :3]) / depth[..., None]

    def units(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions (B, K, D) from parents, and lengths (B, K); the root has none of its own."""
        d = x - x[:, self.parents]
        long = np.sqrt((d**2).sum(2)) + 1e-12
        return d / long[..., None], long

    def turned(self, heading: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The states' directions, turned by the headings: (B, K, D)."""
        mu = self.mu[state].copy()
        c, s = np.cos(heading)[:, None], np.sin(heading)[:, None]
        mu[..., 0], mu[..., 1] = c * mu[..., 0] - s * mu[..., 1], s * mu[..., 0] + c * mu[..., 1]
        return mu

    def density(self, x: np.ndarray, near: list[np.ndarray], obs: np.ndarray, out: np.ndarray, heading: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log density (B) of positions, up to a constant, and its gradient (B, K, D).

        near: positions of neighbouring frames, NaN without one; obs (B, C, K, 2), NaN if missing; out (B, C, K). Bones
        have a normal length and a von Mises-Fisher direction, taken as they are, without the change of variables.
        """
        pixel, slope = self.seen(x)
        error = pixel - obs
        there = ~np.isnan(error).any(3)
        error = np.where(there[..., None], error, 0.0)
        square = (error**2).sum(3)
        a = np.log(1 - out) - np.log(2 * np.pi * self.inlier) - square / (2 * self.inlier)
        b = np.log(out) - np.log(2 * np.pi * self.outlier) - square / (2 * self.outlier)
        both = np.logaddexp(a, b)
        total = np.where(there, both, 0.0).sum((1, 2))
        pull = np.exp(a - both) / self.inlier + np.exp(b - both) / self.outlier
        grad = -np.einsum("bckd,bckde->bke", error * (pull * there)[..., None], slope)
        unit, long = self.units(x)
        bone = np.arange(len(self.parents)) != np.array(self.parents)
        off = (long - self.radius) * bone
        mu, kappa = self.turned(heading, state), self.kappa[state] * bone
        cos = (unit * mu).sum(2)
        total = total - (off**2 / (2 * self.radial_variance)).sum(1) + (kappa * cos).sum(1)
        along = -(off / self.radial_variance)[..., None] * unit + (kappa / long)[..., None] * (mu - cos[..., None] * unit)
        grad = grad + along * bone[:, None]
        np.subtract.at(grad, (slice(None), np.array(self.parents)), along * bone[:, None])
        for other in near:
            step = np.where(np.isnan(other), 0.0, x - other)
            total = total - (step**2 / (2 * self.motion_variance[:, None])).sum((1, 2))
            grad = grad - step / self.motion_variance[:, None]
        return total, grad

    def moved(self, x: np.ndarray, noise: np.ndarray, density: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One step of Hamiltonian Monte Carlo for each body of a batch; noise has 2 * size + 1 uniform numbers each."""
        n = self.size
        momentum = (np.sqrt(-2 * np.log(noise[:, :n])) * np.cos(2 * np.pi * noise[:, n : 2 * n])).reshape(x.shape)
        now, grad = density(x)
        start = now - (momentum**2).sum((1, 2)) / 2
        new, momentum = x, momentum + self.step_size / 2 * grad
        for k in range(self.leapfrog_steps):
            new = new + self.step_size * momentum
            then, grad = density(new)
            momentum = momentum + (self.step_size if k + 1 < self.leapfrog_steps else self.step_size / 2) * grad
        gain = then - (momentum**2).sum((1, 2)) / 2 - start
        return np.where((np.log(noise[:, 2 * n]) < gain)[:, None, None], new, x)

    def pose_logs(self, x: np.ndarray, heading: np.ndarray) -> np.ndarray:
        """log density (B, S) of the bones' directions in each state."""
        unit = self.units(x)[0]
        c, s = np.cos(heading)[:, None], np.sin(heading)[:, None]
        own = unit.copy()  # in the frame of the heading
        own[..., 0], own[..., 1] = c * unit[..., 0] + s * unit[..., 1], c * unit[..., 1] - s * unit[..., 0]
        bone = np.arange(len(self.parents)) != np.array(self.parents)
        norms = np.array([[log_norm(float(k), self.dims) for k in row] for row in self.kappa])
        return np.einsum("bkd,skd->bs", own * bone[:, None], self.mu * self.kappa[..., None]) + (norms * bone).sum(1)

    def headings(self, x: np.ndarray, state: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """Headings from their von Mises density given positions and states, by rejection from a wrapped Cauchy one; noise has 3 * TRIES numbers each."""
        unit = self.units(x)[0]
        mu = self.mu[state] * self.kappa[state][..., None] * (np.arange(len(self.parents)) != np.array(self.parents))[:, None]
        c, s = (unit[..., 0] * mu[..., 0] + unit[..., 1] * mu[..., 1]).sum(1), (unit[..., 1] * mu[..., 0] - unit[..., 0] * mu[..., 1]).sum(1)
        centre, kappa = np.arctan2(s, c), np.hypot(s, c)
        tau = 1 + np.sqrt(1 + 4 * kappa**2)
        rho = (tau - np.sqrt(2 * tau)) / np.maximum(2 * kappa, 1e-12)
        r = (1 + rho**2) / np.maximum(2 * rho, 1e-12)
        out, done = centre.copy(), np.zeros(len(x), bool)
        for k in range(TRIES):  # the chance that none is taken is under 1e-7; the centre stands then
            u, v, w = noise[:, 3 * k], noise[:, 3 * k + 1], noise[:, 3 * k + 2]
            z = np.cos(np.pi * u)
            f = np.clip((1 + r * z) / (r + z), -1, 1)
            g = kappa * (r - f)
            fine = (kappa < 1e-6) | (g * (2 - g) > v) | (np.log(np.maximum(g, 1e-300) / v) + 1 - g >= 0)
            found = np.where(kappa < 1e-6, np.pi * (2 * u - 1), centre + np.sign(w - 0.5) * np.arccos(f))
            out = np.where(fine & ~done, found, out)
            done |= fine
        return np.arctan2(np.sin(out), np.cos(out))


def _grid(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)


def _arrays(x: np.ndarray) -> pa.Array:
    x = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def _columns(t: pa.Table, *names: str) -> list[pa.Array]:
    return [t.column(n).combine_chunks() for n in names]


def bordered(rows: DataFrame, segment: int, half: int) -> DataFrame:
    """The rows of the segments of one parity with `segment` and `own`, and beside them the frames next to them as a halo."""
    at = lambda shift: F.floor((F.col("frame") + shift) / segment)
    both = rows.withColumn("segment", F.explode(F.array_distinct(F.array(at(-1), at(0), at(1)))))
    return both.where(F.pmod(F.col("segment"), F.lit(2)) == half).withColumn("own", F.col("segment") == at(0))


def positions_step(bodies: DataFrame, track: list[str], body: Body, segment: int, seed: int) -> DataFrame:
    """Bodies (track, frame, x, obs, out, heading, state) with their positions drawn anew: even segments first, then the odd ones given those."""
    cameras, k, dims = (1 if body.projections is None else len(body.projections)), len(body.parents), body.dims
    columns = bodies.columns

    def move(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        frame, own = t.column("frame").to_numpy(), t.column("own").to_numpy()
        x = _grid(*_columns(t, "x"), k, dims)
        obs, out = _grid(*_columns(t, "obs"), cameras, k, 2), _grid(*_columns(t, "out"), cameras, k)
        heading, state = t.column("heading").to_numpy(), t.column("state").to_numpy()
        noise = uniform_noise(t.column("key").to_numpy(), 2 * body.size + 1)
        joins = np.append(False, np.diff(frame) == 1)
        for parity in (0, 1):
            rows = np.flatnonzero(own & (frame % 2 == parity))
            if not len(rows):
                continue
            gap = np.full((1, k, dims), np.nan)
            before = np.where(joins[rows, None, None], np.concatenate([gap, x[:-1]])[rows], np.nan)
            after = np.where(np.append(joins[1:], False)[rows, None, None], np.concatenate([x[1:], gap])[rows], np.nan)
            at = lambda new, rows=rows, near=[before, after]: body.density(new, near, obs[rows], out[rows], heading[rows], state[rows])  # noqa: B006, E731
            x[rows] = body.moved(x[rows], noise[rows], at)
        t = t.set_column(t.schema.get_field_index("x"), "x", _arrays(x))
        return t.select(columns).filter(pa.array(own))

    first = None
    for half in (0, 1):
        keyed = bordered(bodies, segment, half).withColumn("key", noise_key([*track, "frame"], seed))
        moved = keyed.groupBy(*track, "segment").applyInArrow(move, bodies.schema)
        still = bodies.where(F.pmod(F.floor(F.col("frame") / segment), F.lit(2)) != half)
        bodies = written(moved.unionByName(still), "bodies")
        if first is not None:
            removed(first)
        first = bodies
    return bodies


def headings_step(bodies: DataFrame, track: list[str], body: Body, seed: int) -> DataFrame:
    """Bodies with headings drawn anew."""

    @F.arrow_udf("double")
    def turn(x: pa.Array, state: pa.Array, key: pa.Array) -> pa.Array:
        noise = uniform_noise(key.to_numpy(), 2 * body.size + 1 + 3 * TRIES)[:, 2 * body.size + 1 :]
        return pa.array(body.headings(_grid(x, len(body.parents), body.dims), state.to_numpy(), noise))

    return bodies.withColumn("heading", turn("x", "state", noise_key([*track, "frame"], seed)))


def scaled_product(weights: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """log of the sums over all paths through a segment: from the state before its first frame to that of its last one.

    weights: logs (frames, S). Neighbouring steps are joined two by two as plain matrix products, each with its scale taken out.
    """
    top = weights.max(1)
    steps, scale = transitions[None] * np.exp(weights - top[:, None])[:, None, :], top
    while len(steps) > 1:
        even = len(steps) // 2 * 2
        joined, logs = steps[0:even:2] @ steps[1:even:2], scale[0:even:2] + scale[1:even:2]
        most = joined.max((1, 2))
        most = np.where(most > 0, most, 1.0)
        steps = np.concatenate([joined / most[:, None, None], steps[even:]])
        scale = np.concatenate([logs + np.log(most), scale[even:]])
    with np.errstate(divide="ignore"):
        return np.log(steps[0]) + scale[0]


def _drawn(logs: np.ndarray, u: float) -> int:
    """A state with the probabilities of these logs, by one uniform number."""
    p = np.cumsum(np.exp(logs - logs.max()))
    return int(min(np.searchsorted(p, u * p[-1], side="right"), len(p) - 1))


def sampled_path(steps: np.ndarray, start: np.ndarray, noise: np.ndarray, last: int | None = None) -> np.ndarray:
    """States after each step, drawn backwards from filtered ones: logs steps[t, i, j] of going from i to j (or one matrix and a row a step), start the logs of states before; `last` is the state at the end, if it is known."""
    filtered = [start]
    for step in steps:
        both = filtered[-1][:, None] + step
        top = both.max(0)
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            filtered.append(top + np.log(np.exp(both - top).sum(0)))
    state = _drawn(filtered[-1], noise[-1]) if last is None else last
    path = [state]
    for k in range(len(steps) - 1, 0, -1):
        state = _drawn(filtered[k] + steps[k][:, state], noise[k - 1])
        path.append(state)
    return np.array(path[::-1])


def states_step(bodies: DataFrame, track: list[str], body: Body, segment: int, seed: int) -> DataFrame:
    """Bodies with pose states drawn anew as whole paths given positions, headings and transitions; a track starts in any state alike.

    A track's frames need not be without gaps: the next frame there is is the next step. What one task
    holds of a track is a matrix a segment.
    """
    moves = np.maximum(body.transitions, 1e-12)
    k, dims, columns = len(body.parents), body.dims, bodies.columns
    logs = np.log(moves)

    @F.arrow_udf("array<double>")
    def weigh(x: pa.Array, heading: pa.Array) -> pa.Array:
        return _arrays(body.pose_logs(_grid(x, k, dims), heading.to_numpy()))

    def uniforms(t: pa.Table) -> np.ndarray:
        return uniform_noise(t.column("key").to_numpy(), 2 * body.size + 2 + 3 * TRIES)[:, -1]

    rows = bodies.withColumn("segment", F.floor(F.col("frame") / segment)).withColumn("key", noise_key([*track, "frame"], seed)).withColumn("w", weigh("x", "heading"))

    def matrix(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        m = scaled_product(_grid(*_columns(t, "w"), len(moves)), moves)
        return t.select([*track, "segment"]).slice(0, 1).append_column("key", t.column("key").slice(len(t) - 1)).append_column("m", _arrays(m[None]))

    def ends(t: pa.Table) -> pa.Table:
        t = t.sort_by("segment")
        path = sampled_path(_grid(*_columns(t, "m"), len(moves), len(moves)), np.zeros(len(moves)), uniforms(t))
        # the state before a segment is the one at the end of the segment before; before the first any is alike
        return t.select([*track, "segment"]).append_column("start", pa.array(np.append(-1, path[:-1]))).append_column("stop", pa.array(path))

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame")
        w = _grid(*_columns(t, "w"), len(moves))
        start = np.zeros(len(moves))
        if (first := t.column("start")[0].as_py()) >= 0:
            start = np.where(np.arange(len(moves)) == first, 0.0, -np.inf)
        path = sampled_path(logs[None] + w[:, None, :], start, uniforms(t), t.column("stop")[0].as_py())
        return t.set_column(t.schema.get_field_index("state"), "state", pa.array(path, pa.int64())).select(columns)

    names = ", ".join(f"{c} {bodies.schema[c].dataType.simpleString()}" for c in track)
    matrices = rows.groupBy(*track, "segment").applyInArrow(matrix, f"{names}, segment long, key long, m array<double>")
    bounds = matrices.groupBy(*track).applyInArrow(ends, f"{names}, segment long, start long, stop long")
    return rows.join(bounds, [*track, "segment"]).groupBy(*track, "segment").applyInArrow(fill, bodies.schema)


def transition_counts(bodies: DataFrame, track: list[str], states: int) -> np.ndarray:
    """Moves (from, to) between neighbouring frames of all tracks: sums over rows, so only states x states numbers reach the driver."""
    here = bodies.select(*track, "frame", F.col("state").alias("b"))
    before = bodies.select(*track, (F.col("frame") + 1).alias("frame"), F.col("state").alias("a"))
    out = np.zeros((states, states))
    for r in here.join(before, [*track, "frame"]).groupBy("a", "b").agg(F.count("*").alias("n")).collect():
        out[r.a, r.b] = r.n
    return out


def transitions_step(counts: np.ndarray, prior: float, seed: int) -> np.ndarray:
    """Rows of transitions from their Dirichlet densities."""
    draws = np.random.default_rng(seed).standard_gamma(counts + prior)
    draws = np.maximum(draws, 1e-300)
    return draws / draws.sum(1, keepdims=True)


class PoseModel:
    """The pose model as a kinematics model: initialize, step and log_likelihood as herdframe.operators.kinematics wants them.

    Without projections bodies are in the image, one a camera; with them in space, one for all
    cameras, which then start from robust_points (median over pairs of cameras, filled along frames).
    Bodies and frames where a keypoint was never seen start at the body's other keypoints' mean. Detections with an outlier probability over
    most_outlier don't take part in the start. State tables that no step needs any more are removed.
    """

    def __init__(self, body: Body, segment: int = 10_000, most_outlier: float = 0.5, prior: float = 1.0, seed: int = 0):
        self.body, self.segment, self.most_outlier, self.prior, self.seed, self.steps = body, segment, most_outlier, prior, seed, 0
        self.track = ["recording", "camera", "animal"] if body.projections is None else ["recording", "animal"]
        self.bodies: DataFrame | None = None

    def _observed(self, located: DataFrame) -> DataFrame:
        """(track, frame, obs, out): detections of each body and frame as arrays."""
        k, cameras = len(self.body.parents), 1 if self.body.projections is None else len(self.body.projections)
        cell = (F.col("camera") * k if cameras > 1 else F.lit(0)) + F.col("keypoint")
        seen = ~is_missing(F.col("x"), F.col("y"))
        xy = {f"o{c}": F.when(seen, F.col(c)).otherwise(F.lit(-1e300)) for c in "xy"}
        out = dense(located, [*self.track, "frame"], cell, cameras * k, **xy, op="outlier_prob", there=F.when(seen, 1.0).otherwise(0.0))
        pair = F.expr(f"flatten(transform(sequence(0, {cameras * k - 1}), i -> if(there[i] > 0, array(ox[i], oy[i]), array(cast(null as double), cast(null as double)))))")
        clipped = F.transform("op", lambda p: F.when((p > 0) & (p < 1), p).otherwise(F.lit(0.5)))
        return out.select(*self.track, "frame", pair.alias("obs"), clipped.alias("out"))

    def _placed(self, located: DataFrame) -> DataFrame:
        """(track, frame, x): first positions of all keypoints as arrays."""
        fine = F.col("outlier_prob") <= self.most_outlier
        masked = located.withColumns({c: F.when(fine, F.col(c)) for c in "xy"})
        axes = "xyz"[: self.body.dims]
        if self.body.projections is None:
            filled = interpolate(masked, self.segment, [*self.track, "keypoint"], axes)
        else:
            frames = located.select(*self.track, "keypoint", "frame").distinct()
            points = robust_points(masked, self.body.projections.tolist())
            filled = interpolate(frames.join(points, [*self.track, "keypoint", "frame"], "left"), self.segment, [*self.track, "keypoint"], axes)
        k, keys = len(self.body.parents), [*self.track, "frame"]
        means = [F.avg(a).alias(f"m{a}") for a in axes]
        cells = [F.max(F.when(F.col("keypoint") == j, F.col(a))).alias(f"{a}{j}") for j in range(k) for a in axes]
        wide = filled.groupBy(*keys).agg(*cells, *means)
        return wide.where("mx is not null").select(*keys, F.array(*[F.coalesce(f"{a}{j}", f"m{a}") for j in range(k) for a in axes]).alias("x"))

    def initialize(self, located: DataFrame) -> "PoseModel":
        """Bodies where they are seen, headed as they lie, each in its likeliest state."""
        body, d = self.body, self.body.dims
        front, back = body.front_back

        @F.arrow_udf("long")
        def likeliest(x: pa.Array, heading: pa.Array) -> pa.Array:
            return pa.array(body.pose_logs(_grid(x, len(body.parents), d), heading.to_numpy()).argmax(1))

        def along(a: int) -> Column:
            return F.col("x")[front * d + a] - F.col("x")[back * d + a]

        located = written(located.select("recording", "camera", "frame", "keypoint", "animal", "x", "y", "outlier_prob"), "located")
        rows = self._placed(located).join(self._observed(located), [*self.track, "frame"]).withColumn("heading", angle(along(0), along(1)))
        new = copy(self)
        new.bodies = written(rows.withColumn("state", likeliest("x", "heading")).select(*self.track, "frame", "x", "obs", "out", "heading", "state"), "bodies")
        removed(located)
        return new

    def step(self, located: DataFrame) -> "PoseModel":
        """One draw of positions, headings, states and transitions, given detections by animal."""
        if self.bodies is None:
            raise ValueError("the model needs initialize() first")
        new, seed = copy(self), self.seed + self.steps + 1
        new.steps = self.steps + 1
        keys = [*self.track, "frame"]
        rows = self.bodies.drop("obs", "out").join(self._observed(located), keys).select(*self.bodies.columns)
        start = written(rows, "bodies")
        rows = positions_step(start, self.track, self.body, self.segment, seed)
        turned = written(headings_step(rows, self.track, self.body, seed), "bodies")
        new.bodies = written(states_step(turned, self.track, self.body, self.segment, seed), "bodies")
        removed(start, rows, turned)
        new.body = copy(self.body)
        if len(self.body.mu) > 1:
            new.body.transitions = transitions_step(transition_counts(new.bodies, self.track, len(self.body.mu)), self.prior, seed)
        return new

    def points(self) -> DataFrame:
        """(track, frame, keypoint, x, y and, in space, z)."""
        if self.bodies is None:
            raise ValueError("the model needs initialize() first")
        axes, d = "xyz"[: self.body.dims], self.body.dims
        each = F.expr(f"transform(sequence(0, {len(self.body.parents) - 1}), k -> struct(cast(k as long) as keypoint, {', '.join(f'x[k * {d} + {a}] as {c}' for a, c in enumerate(axes))}))")
        return self.bodies.select(*self.track, "frame", F.inline(each))

    def log_likelihood(self, detections: DataFrame) -> DataFrame:
        points = self.points()
        if self.body.projections is None:
            points = points.withColumnsRenamed({"x": "px", "y": "py"})
        else:
            points = projected(points, self.body.projections.tolist())
        both = detections.select(*SERIES, "frame", "x", "y", "outlier_prob").join(points, ["recording", "camera", "frame", "keypoint"])
        error = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
        return both.select(*SERIES, "frame", "animal", mixture_log(error, F.col("outlier_prob"), self.body.inlier, self.body.outlier).alias("logp"))

