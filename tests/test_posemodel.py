import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdframe.operators import geometry, posemodel
from herdframe.operators.poses import gimbal_params
from herdframe.operators.posemodel import Body, PoseModel
from herdframe.plans import views

RIG = np.array([views.projection(c) for c in range(5)])


def body(dims=2, states=2, seed=0, cameras=None, **more):
    rng = np.random.default_rng(seed)
    mu = rng.normal(size=(states, 4, dims))
    mu /= np.linalg.norm(mu, axis=2, keepdims=True)
    return Body([0, 0, 1, 2], np.array([0, 3.0, 4, 5]), np.array([1e8, 2.0, 2, 3]), np.array([5.0, 4, 3, 2]), mu, rng.uniform(1, 6, (states, 4)), 10.0, 1e4, front_back=(0, 3), projections=cameras, **more)


@pytest.mark.parametrize("dims", [2, 3])
def test_gradients(dims):
    rng = np.random.default_rng(1)
    b = body(dims, cameras=None if dims == 2 else RIG[:4])
    x = rng.normal(size=(6, 4, dims)) * 3 + [0, 0, 30][:dims]
    near = [x + rng.normal(size=x.shape), np.full(x.shape, np.nan)]
    obs = b.seen(x)[0] + rng.normal(size=b.seen(x)[0].shape) * 5
    obs[0, 0, 1] = np.nan
    args = near, obs, rng.uniform(0.1, 0.9, obs.shape[:3]), rng.uniform(-3, 3, 6), rng.integers(0, 2, 6)
    grad = b.density(x, *args)[1]
    for k, d in itertools.product(range(4), range(dims)):
        step = np.zeros(x.shape)
        step[:, k, d] = 1e-5
        numeric = (b.density(x + step, *args)[0] - b.density(x - step, *args)[0]) / 2e-5
        assert np.allclose(numeric, grad[:, k, d], rtol=1e-4, atol=1e-5)


def test_samples_of_a_gaussian_chain_have_its_mean_and_variance(spark):
    """Without bones' pulls and outliers, positions along frames are jointly normal, with a known covariance."""
    frames, chains, q, v = 7, 120, 4.0, 6.0
    b = Body([0], np.zeros(1), np.full(1, 1e8), np.full(1, q), np.ones((1, 1, 2)), np.zeros((1, 1)), v, 1e12, 4, 0.5, (0, 0))
    seen = [10.0, 14.0, 11.0, 9.0, 20.0, 18.0, 15.0]
    rows = [("r", 0, a, t, [seen[t], -seen[t]], [seen[t], -seen[t]], [1e-9], 0.0, 0) for a in range(chains) for t in range(frames)]
    schema = "recording string, camera long, animal long, frame long, x array<double>, obs array<double>, out array<double>, heading double, state long"
    precision = np.eye(frames) / v
    for t in range(frames - 1):
        precision[t : t + 2, t : t + 2] += np.array([[1, -1], [-1, 1]]) / q
    cov = np.linalg.inv(precision)
    mean = cov @ np.array(seen) / v
    bodies, samples, first = spark.createDataFrame(rows, schema), [], []
    for step in range(12):
        bodies = posemodel.positions_step(bodies, ["recording", "camera", "animal"], b, 3, step)
        x = np.zeros((chains, frames, 2))
        for r in bodies.collect():
            x[r.animal, r.frame] = r.x
        if step >= 4:
            samples.append(x)
        first.append(x)
    x = np.concatenate(samples)
    se = np.sqrt(cov.diagonal() / chains)  # as if a chain's samples were one
    assert (np.abs(x[..., 0].mean(0) - mean) < 4 * se).all() and (np.abs(x[..., 1].mean(0) + mean) < 4 * se).all()
    assert np.allclose(np.cov(x[..., 0].T), cov, atol=0.2 * cov.max())
    assert not (first[0] == first[1]).all()


def test_positions_do_not_depend_on_partitions_or_segments_of_one_half(spark):
    rng = np.random.default_rng(3)
    b = body()
    rows = [("r", 0, a, t, rng.normal(size=8).tolist(), rng.normal(size=8).tolist(), [0.2] * 4, 0.1, a) for a in range(2) for t in range(23) if t != 11]
    schema = "recording string, camera long, animal long, frame long, x array<double>, obs array<double>, out array<double>, heading double, state long"
    frame = spark.createDataFrame(rows, schema)
    track = ["recording", "camera", "animal"]
    draw = lambda f, seed=5: {(r.animal, r.frame): (r.x, r.state) for r in posemodel.states_step(posemodel.positions_step(f, track, b, 4, seed), track, b, 4, seed).collect()}
    one = draw(frame)
    assert one == draw(frame.repartition(7)) and len(one) == len(rows)
    assert one != draw(frame, 6)


def test_headings_follow_their_density():
    rng = np.random.default_rng(4)
    b = body(states=1)
    x = np.tile(rng.normal(size=(1, 4, 2)) * 3, (40_000, 1, 1))
    state = np.zeros(len(x), int)
    drawn = b.headings(x, state, rng.uniform(size=(len(x), 3 * posemodel.TRIES)))
    grid = np.linspace(-np.pi, np.pi, 2001)[:-1]
    logs = b.pose_logs(np.tile(x[:1], (2000, 1, 1)), grid)[:, 0]
    p = np.exp(logs - logs.max())
    p /= p.sum()
    for f in (np.cos, np.sin, lambda h: np.cos(2 * h)):
        assert abs(f(drawn).mean() - (p * f(grid)).sum()) < 0.02


def paths_by_enumeration(weights, transitions):
    states = range(len(transitions))
    out = {}
    for path in itertools.product(states, repeat=len(weights) + 1):  # the first one is before the first frame, any alike
        p = math.prod(transitions[a][b] * math.exp(w[b]) for a, b, w in zip(path, path[1:], weights, strict=False))
        out[path[1:]] = out.get(path[1:], 0) + p
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}, total


def test_segment_matrices_and_paths_by_enumeration():
    rng = np.random.default_rng(5)
    weights, moves = rng.normal(size=(5, 3)) * 2, rng.dirichlet(np.ones(3), 3)
    want, total = paths_by_enumeration(weights, moves)
    m = posemodel.scaled_product(weights, moves)
    assert np.isclose(np.exp(m).sum(), total)
    # two matrices, each summing over its frames, give what one does
    halves = [posemodel.scaled_product(w, moves) for w in (weights[:2], weights[2:])]
    assert np.allclose(np.log(np.exp(halves[0]) @ np.exp(halves[1])), m)
    seen = {}
    n = 20_000
    steps = np.log(moves)[None] + weights[:, None, :]
    for u in rng.uniform(size=(n, 5)):
        path = tuple(posemodel.sampled_path(steps, np.zeros(3), u).tolist())
        seen[path] = seen.get(path, 0) + 1
    assert sum(abs(seen.get(k, 0) / n - v) for k, v in want.items()) / 2 < 0.04
    # far apart evidence doesn't underflow
    far = np.array([[0.0, -3000.0], [-3000.0, 0.0], [0.0, -9000.0]])
    assert np.isfinite(posemodel.scaled_product(far, np.full((2, 2), 0.5))).any()


def test_states_along_time_over_segments(spark):
    """Draws for many tracks of few frames, cut into segments, have the enumerated frequencies."""
    b = body(states=2, seed=7)
    b.transitions = np.array([[0.9, 0.1], [0.3, 0.7]])
    rng = np.random.default_rng(8)
    xs = rng.normal(size=(5, 4, 2)) * 3
    tracks = 400
    rows = [("r", 0, a, t, xs[t].reshape(-1).tolist(), [0.0] * 8, [0.5] * 4, 0.3, 0) for a in range(tracks) for t in range(5)]
    schema = "recording string, camera long, animal long, frame long, x array<double>, obs array<double>, out array<double>, heading double, state long"
    found = posemodel.states_step(spark.createDataFrame(rows, schema), ["recording", "camera", "animal"], b, 2, 3)
    paths = {}
    for r in found.collect():
        paths.setdefault(r.animal, {})[r.frame] = r.state
    seen = {}
    for p in paths.values():
        key = tuple(p[t] for t in range(5))
        seen[key] = seen.get(key, 0) + 1
    want, _ = paths_by_enumeration(b.pose_logs(xs, np.full(5, 0.3)), b.transitions)
    assert sum(abs(seen.get(k, 0) / tracks - v) for k, v in want.items()) / 2 < 0.15
    counts = posemodel.transition_counts(found, ["recording", "camera", "animal"], 2)
    moves = [(p[t], p[t + 1]) for p in paths.values() for t in range(4)]
    assert counts.tolist() == [[sum(m == (a, c) for m in moves) for c in (0, 1)] for a in (0, 1)]
    drawn = np.mean([posemodel.transitions_step(counts, 1.0, s) for s in range(300)], 0)
    assert np.allclose(drawn, (counts + 1) / (counts + 1).sum(1, keepdims=True), atol=0.01)


def located(spark, cameras, frames=60, animals=2, seed=9):
    """Animals that walk in space, seen by all cameras with noise and gaps, and one wild camera."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for a in range(animals):
        centre = np.array([3.0 * a, 0, 12]) + np.cumsum(rng.normal(size=(frames, 3)) * 0.05, 0)
        for t in range(frames):
            for k in range(4):
                p = centre[t] + [0.5 * k, 0.1 * (-1) ** k, 0]
                truth[a, t, k] = p
                for c in range(cameras):
                    u = RIG[c] @ np.append(p, 1)
                    x, y = u[:2] / u[2] + rng.normal(size=2) * 0.3
                    wild = c == 3 and t % 5 == 0
                    gone = not wild and t % 5 and rng.random() < 0.1
                    rows.append(("r", c, t, k, a, None if gone else float(x + 400 * wild), None if gone else float(y - 300 * wild), 0.3 if wild else 0.02, a))
    frame = spark.createDataFrame(rows, "recording string, camera long, frame long, keypoint long, instance long, x double, y double, outlier_prob double, animal long")
    return frame, truth


def test_one_wild_camera_of_five_does_not_move_a_point(spark):
    frame, truth = located(spark, 5)
    good = geometry.robust_points(frame, RIG.tolist()).collect()
    plain = geometry.triangulated(frame, RIG.tolist()).collect()
    far = lambda rows: max(np.linalg.norm(np.array([r.x, r.y, r.z]) - truth[r.animal, r.frame, r.keypoint]) for r in rows if r.frame % 5 == 0)
    assert far(plain) > 3
    errors = [np.linalg.norm(np.array([r.x, r.y, r.z]) - truth[r.animal, r.frame, r.keypoint]) for r in good]
    assert np.median(errors) < 0.3 and np.mean(np.array(errors) > 2) < 0.05


@pytest.mark.parametrize("dims", [2, 3])
def test_a_model_step_and_its_likelihood(spark, dims):
    frame, truth = located(spark, 3)
    mixture = [{"pi": 0.5, "bones": {k: (([1.0, 0.0, 0.0] if s == 0 else [0.0, 1.0, 0.0])[:dims], 3.0) for k in (1, 2, 3)}} for s in (0, 1)]
    radii = [0.0, 0.54, 0.54, 0.54] if dims == 3 else [0.0, 13.0, 13.0, 13.0]
    params = gimbal_params([0, 0, 1, 2], mixture, radii, [0.2] * 4 if dims == 3 else [5.0] * 4, motion_variance=0.01 if dims == 3 else 5.0, step_size=0.02 if dims == 3 else 0.5, front_back=(3, 0), projections=RIG[:3].tolist() if dims == 3 else None)
    model = PoseModel(Body.from_params(params), segment=16).initialize(frame)
    start = model.log_likelihood(frame).agg(F.sum("logp")).first()[0]
    for _ in range(2):
        model = model.step(frame)
    rows = model.log_likelihood(frame)
    assert rows.agg(F.sum("logp")).first()[0] > start - 0.2 * abs(start)
    own, other = (rows.where(c).agg(F.avg("logp")).first()[0] for c in ("animal = instance and outlier_prob < 0.1 and x is not null", "animal <> instance and outlier_prob < 0.1 and x is not null"))
    assert own > other + 3
    points = model.points().collect()
    assert len(points) == len(truth) * (1 if dims == 3 else 3)
    if dims == 3:
        assert np.median([np.linalg.norm(np.array([r.x, r.y, r.z]) - truth[r.animal, r.frame, r.keypoint]) for r in points]) < 0.5
    assert np.allclose(model.body.transitions.sum(1), 1) and model.body.transitions.shape == (2, 2)
