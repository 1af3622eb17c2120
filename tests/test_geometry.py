import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from herdframe.functions.scalars import angle, jensen_shannon, log_sigmoid, mixture_log, rotation_matrix
from herdframe.operators import geometry, grouping, transforms, tree
from herdframe.operators.kinematics import SpaceWalk
from herdframe.plans import views
from tests import plain

RIG = [views.projection(c) for c in range(3)]


def seen(point, camera):
    u = np.array(RIG[camera]) @ np.append(point, 1)
    return u[:2] / u[2]


def test_points_that_both_cameras_see_have_no_error():
    rng = np.random.default_rng(0)
    points = np.c_[rng.normal(size=(50, 2)), rng.uniform(3, 9, 50)]
    a, b = np.array([seen(p, 1) for p in points]), np.array([seen(p, 0) for p in points])
    p1, p2 = np.array([RIG[1]] * 50), np.array([RIG[0]] * 50)
    assert geometry.two_view_errors(p1, p2, a, b).max() < 1e-6
    noisy = geometry.two_view_errors(p1, p2, a + [0, 3.0], b)
    assert np.allclose(noisy, 1.5, atol=0.05)  # the closed form of a rectified rig


def test_errors_by_eigenvectors():
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 80, (40, 2)), rng.uniform(0, 80, (40, 2))
    got = geometry.two_view_errors(np.array([RIG[2]] * 40), np.array([RIG[0]] * 40), x, y)
    for k in range(40):
        p, q = np.array(RIG[2]), np.array(RIG[0])
        m = np.stack([x[k, 0] * p[2] - p[0], x[k, 1] * p[2] - p[1], y[k, 0] * q[2] - q[0], y[k, 1] * q[2] - q[1]])
        point = np.linalg.eigh(m.T @ m)[1][:, 0]
        e = [np.linalg.norm((c @ point)[:2] / (c @ point)[2] - v) for c, v in ((p, x[k]), (q, y[k]))]
        assert np.isclose(got[k], np.mean(e), rtol=1e-4)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=3, max_size=3), st.lists(st.floats(0, 1), min_size=3, max_size=3))
def test_divergence_is_symmetric_and_bounded(spark, p, q):
    d = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    r = d.select(jensen_shannon(F.col("p"), F.col("q")).alias("a"), jensen_shannon(F.col("q"), F.col("p")).alias("b"), jensen_shannon(F.col("p"), F.col("p")).alias("same")).first()
    assert abs(r.a - r.b) < 1e-12 and -1e-12 <= r.a <= math.log(2) + 1e-12 and abs(r.same) < 1e-12


def test_scalars(spark):
    d = spark.createDataFrame([(0.0, 1.0), (-1.0, 0.0), (1.0, 0.0), (0.0, 0.0)], "x double, y double")
    got = [r[0] for r in d.select(angle(F.col("x"), F.col("y"))).collect()]
    assert np.allclose(got, [math.pi / 2, -math.pi, 0, 0])
    r = d.select(rotation_matrix(F.lit(math.pi / 2)).alias("m"), log_sigmoid(F.lit(-800.0)).alias("low"), log_sigmoid(F.lit(0.0)).alias("half")).first()
    assert np.allclose(r.m, [[0, -1, 0], [1, 0, 0], [0, 0, 1]]) and r.low == -800 and np.isclose(r.half, -math.log(2))
    e = spark.createDataFrame([(3.0, 0.1), (None, 0.1)], "e double, o double").select(mixture_log(F.col("e"), F.col("o")).alias("l")).collect()
    want = math.log(0.9 * math.exp(-9 / 20) / (20 * math.pi) + 0.1 * math.exp(-9 / 2e6) / (2e6 * math.pi))
    assert np.isclose(e[0].l, want) and e[1].l == 0


def test_undistortion_inverts_distortion(spark):
    lens = views.intrinsics(1)
    rng = np.random.default_rng(2)
    u, v = rng.uniform(-0.3, 0.3, (2, 30))
    r = u * u + v * v
    scale = 1 + lens["k1"] * r + lens["k2"] * r * r
    x = u * scale + 2 * lens["p1"] * u * v + lens["p2"] * (r + 2 * u * u)
    y = v * scale + lens["p1"] * (r + 2 * v * v) + 2 * lens["p2"] * u * v
    rows = [("r", 1, k, 0, 0, float(a * 300 + 245), float(b * 300 + 50), 1.0) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    d = spark.createDataFrame([*rows, ("r", 1, 99, 0, 0, None, None, 0.0)], "recording string, camera long, frame long, keypoint long, instance long, x double, y double, confidence double")
    got = {r.frame: (r.x, r.y) for r in transforms.undistort(d, views.intrinsics, [0, 1, 2], steps=20).collect()}
    assert got.pop(99) == (None, None)
    assert np.allclose([got[k] for k in range(30)], np.c_[u * 300 + 245, v * 300 + 50], atol=1e-6)


def adjacency(n, links):
    a = np.zeros((1, n, n), bool)
    for i, j in links:
        a[0, i, j] = a[0, j, i] = True
    return a


def test_groups():
    cams = np.array([0, 0, 1, 1, 2, 2])
    one = np.ones(6)

    def groups(cameras, links, scores, n, split=True):
        return grouping.group_labels(adjacency(6, links), cameras[None], scores[None], n, split)[0].tolist()

    assert grouping.component_labels(adjacency(4, [(3, 1)]))[0].tolist() == [[-1, 0, -1, 0]]
    assert groups(cams, [(0, 2), (1, 3)], one, 2) == [0, 1, 0, 1, -1, -1]
    # more components than animals: the best scores stay, in ascending order of score
    scores = np.array([0.1, 0.9, 0.1, 0.9, 0.5, 0.5])
    nodes = np.array([0, 1, 1, 2, 0, 2])
    assert groups(nodes, [(0, 2), (1, 3), (4, 5)], scores, 2) == [-1, 1, -1, 1, 0, 0]
    # one component that repeats cameras is split in two
    links = [(0, 2), (0, 4), (2, 4), (1, 3), (1, 5), (3, 5), (4, 5)]
    assert groups(cams, links, one, 2) == [0, 1, 0, 1, 0, 1]
    assert groups(cams, links, one, 2, split=False) == [-1] * 6
    assert groups(cams, [], one, 2) == [-1] * 6


def test_stacked_graphs_against_one_at_a_time():
    rng = np.random.default_rng(5)
    for cameras, n in ((3, 2), (4, 3), (2, 1), (5, 2)):
        many, nodes = 200, cameras * n
        camera = np.repeat(np.arange(cameras), n)
        links = [[(i, j) for i in range(nodes) for j in range(i) if camera[i] != camera[j] and rng.random() < p] for p in rng.choice([0.05, 0.15, 0.3, 0.6], many)]
        scores = rng.choice([0.1, 0.2, 0.3, 0.7], (many, nodes))
        stack = np.concatenate([adjacency(nodes, x) for x in links])
        for split in (True, False):
            got = grouping.group_labels(stack, np.tile(camera, (many, 1)), scores, n, split)
            want = [plain.cell_groups(camera, np.tile(np.arange(n), cameras), x, s, n, split) for x, s in zip(links, scores, strict=True)]
            assert (got == np.array(want)).all()
        for a, x in zip(grouping.component_labels(stack)[0], links, strict=True):
            assert [np.flatnonzero(a == k).tolist() for k in range(a.max() + 1)] == [c for c in plain.connected(nodes, x) if len(c) > 1]


def test_kmeans():
    rng = np.random.default_rng(0)
    points = np.r_[rng.normal(size=(20, 2)), rng.normal(size=(20, 2)) + 20]
    labels, centroids, inertia = (x[0] for x in grouping.kmeans(points[None], 2))
    assert len(set(labels[:20])) == len(set(labels[20:])) == 1 and labels[0] != labels[-1]
    assert np.isclose(inertia, sum(((points[labels == k] - points[labels == k].mean(0)) ** 2).sum() for k in (0, 1)))
    assert np.isclose(inertia, plain.kmeans(points, 2)[2])
    assert grouping.kmeans(points[None, :1], 3)[0].tolist() == [[0]]


def test_repeated_rows_count_once(spark):
    d = spark.createDataFrame([("r", c, 0, 0, 0, 1.0 - 150 * c / 4, 2.0, 0.9, 0.1) for c in (0, 1, 1)], "recording string, camera long, frame long, keypoint long, instance long, x double, y double, confidence double, outlier_prob double")
    ids = spark.createDataFrame([("r", c, 0, 0, 0, a, w) for c in (0, 1, 1) for a, w in ((0, -0.1), (1, -2.0), (1, -2.5))], "recording string, camera long, frame long, keypoint long, instance long, animal long, logp double")
    aff = spark.createDataFrame([], "recording string, camera long, frame long, keypoint long, instance long, parent_instance long, logp double")
    found = geometry.pair_scores(d, ids, 2, None).collect()
    assert len(found) == 1 and found[0].divergence < 1e-9
    views_of = tree.views(ids, aff, 2, [0]).collect()
    assert sorted((r.camera, list(r.ll)) for r in views_of) == [(c, [-0.1, -2.0, 0.0, 0.0]) for c in (0, 1)]


def test_one_camera_has_no_groups(spark):
    d = spark.createDataFrame([("r", 0, 0, 0, i, 1.0, 2.0, 0.9, 0.1) for i in range(2)], "recording string, camera long, frame long, keypoint long, instance long, x double, y double, confidence double, outlier_prob double")
    ids = spark.createDataFrame([("r", 0, 0, 0, i, a, -0.7) for i in range(2) for a in range(2)], "recording string, camera long, frame long, keypoint long, instance long, animal long, logp double")
    aff = spark.createDataFrame([], "recording string, camera long, frame long, keypoint long, instance long, parent_instance long, logp double")
    assert grouping.initial_assignments(d, aff, ids, 2, [0, 0], RIG).count() == 0


def kernels(df):
    """How many times the plan runs a Python kernel."""
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_a_filter_on_errors_runs_the_kernel_once(spark):
    pairs = spark.createDataFrame([(1, 0, 1.0, 1.0, 2.0, 1.0), (2, 1, None, 1.0, 2.0, 1.0)], "cam1 long, cam2 long, x1 double, y1 double, x2 double, y2 double")
    error = geometry.triangulation_error(RIG)("cam1", "cam2", "x1", "y1", "x2", "y2")
    found = geometry.edges(pairs.select("cam1", error.alias("error"), F.lit(0.0).alias("divergence")), most_error=1e9)
    assert kernels(found) == 1 and [r.cam1 for r in found.collect()] == [1]


def test_points_in_space(spark):
    rng = np.random.default_rng(4)
    points = {(t, a): np.append(rng.normal(size=2), rng.uniform(4, 8)) for t in range(6) for a in (0, 1)}
    rows = [("r", c, t, 0, a, *map(float, seen(p, c)), a) for (t, a), p in points.items() for c in range(3) if (t, c) != (5, 2)]
    rows += [("r", 0, 9, 0, 0, 1.0, 1.0, 0), ("r", 1, 8, 0, 0, None, None, 0)]
    d = spark.createDataFrame(rows, "recording string, camera long, frame long, keypoint long, instance long, x double, y double, animal long")
    got = {(r.frame, r.animal): (r.x, r.y, r.z) for r in geometry.triangulated(d, RIG).collect()}
    assert got.keys() == points.keys() and all(np.allclose(got[k], points[k]) for k in points)
    assert kernels(geometry.triangulated(d, RIG)) == 1
    again = geometry.projected(geometry.triangulated(d, RIG), RIG).collect()
    assert len(again) == 36 and all(np.allclose((r.px, r.py), seen(points[r.frame, r.animal], r.camera)) for r in again)
    model = SpaceWalk(RIG, reach=0).initialize(d)
    scored = model.log_likelihood(d.where("frame < 5").drop("animal").withColumn("outlier_prob", F.lit(0.01))).collect()
    best = max((r for r in scored if (r.frame, r.camera, r.instance) == (0, 0, 1)), key=lambda r: r.logp)
    assert best.animal == 1
