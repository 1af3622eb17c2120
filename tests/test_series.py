import time

import numpy as np
from pyspark.sql import functions as F

from herdframe.operators import clustering, poses, transforms
from herdframe.operators.kinematics import BoneWalk, IdentitySampler, RandomWalk
from herdframe.plans import queries
from herdframe.plans.queries import MIXTURE
from herdframe.sources.shared import written
from herdframe.streaming.frames import best_identities

SCHEMA = "recording string, camera long, frame long, keypoint long, instance long, x double, y double, confidence double"


def series(rng, n, instance):
    x = [None if rng.random() < 0.4 else float(rng.normal()) for _ in range(n)]
    return [("r", 0, t, 0, instance, v, None if v is None else -v, 1.0) for t, v in enumerate(x)]


def test_interpolation_over_segments(spark):
    rng = np.random.default_rng(0)
    rows = [r for i in range(3) for r in series(rng, 50, i)] + [("r", 0, t, 0, 9, None, None, 0.0) for t in range(5)]
    rows += [("r", 0, 7, 0, 8, 1.0, 2.0, 1.0)]
    d = spark.createDataFrame(rows, SCHEMA)
    for segment in (4, 1000):
        got = {(r.instance, r.frame): (r.x, r.y) for r in transforms.interpolate(d, segment).collect()}
        assert len(got) == len(rows)
        for i in range(3):
            own = [r for r in rows if r[4] == i]
            t = [r[2] for r in own if r[5] is not None]
            want = np.interp(range(50), t, [r[5] for r in own if r[5] is not None])
            assert np.allclose([got[i, k][0] for k in range(50)], want) and np.allclose([got[i, k][1] for k in range(50)], -want)
        assert got[9, 0] == (None, None) and got[8, 7] == (1.0, 2.0)
    again = transforms.interpolate(transforms.interpolate(d), 4)
    assert again.exceptAll(transforms.interpolate(d)).count() == 0
    assert transforms.interpolate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_top_detections_and_nan(spark):
    rows = [("r", 0, 0, 0, i, 1.0, 1.0, c) for i, c in enumerate([0.5, 0.9, 0.5, float("nan"), None])]
    got = transforms.top_detections(spark.createDataFrame(rows, SCHEMA), 3, ["recording", "camera", "frame", "keypoint"]).collect()
    assert {(r.slot, r.instance) for r in got} == {(0, 1), (1, 2), (2, 0)}
    probs = transforms.with_outlier_probs(spark.createDataFrame([("r", 0, 0, 0, 0, float("nan"), 1.0, 0.9), ("r", 0, 0, 0, 1, 1.0, 1.0, 2.0)], SCHEMA)).collect()
    assert [r.outlier_prob for r in probs] == [1 - 1e-5, 1e-5]


def test_log_probabilities_add_up(spark):
    sf = "/root/testdata/sf0.001"
    total = queries._affinity(spark, sf).groupBy("recording", "frame", "camera", "keypoint", "instance").agg(F.sum(F.exp("logp")).alias("s"))
    assert total.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def plain_step(units, mixture):
    logs = []
    for pose in units:
        row = []
        for s in mixture:
            v = np.log(s["pi"])
            for k, u in pose.items():
                mu, kappa = s["bones"][k]
                v += np.log(kappa / (4 * np.pi * np.sinh(kappa))) + kappa * np.dot(mu, u)
            row.append(v)
        logs.append(row)
    logs = np.array(logs)
    total = np.log(np.exp(logs).sum(1))
    return np.exp(logs - total[:, None]), total


def test_movmf_step(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 3, 3)) + [2, 0, 0]
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    d = spark.createDataFrame([(p, k + 1, *map(float, v[p, k])) for p in range(40) for k in range(3)], "pose_id long, keypoint long, x double, y double, z double")
    r, total = plain_step([{k + 1: v[p, k] for k in range(3)} for p in range(40)], MIXTURE)
    for row in poses.movmf_step(d, MIXTURE).collect():
        s = (r[:, row.state, None] * v[:, row.keypoint - 1]).sum(0)
        rbar = np.linalg.norm(s) / r[:, row.state].sum()
        assert np.allclose([row.mu_x, row.mu_y, row.mu_z], s / np.linalg.norm(s))
        assert np.isclose(row.pi, r[:, row.state].mean()) and np.isclose(row.kappa, rbar * (3 - rbar**2) / (1 - rbar**2)) and np.isclose(row.log_likelihood, total.mean())
    mixture, history = poses.fit_movmf(d, 2, 4, 4)
    assert len(mixture) == 2 and history[-1] > history[0]
    assert all(m["bones"][0] == ([1.0, 0.0, 0.0], 0.0) for m in mixture)
    params = poses.gimbal_params([0, 0, 1, 2], mixture, radii_std=[0.0, 1.0, 2.0, 3.0])
    assert params["pos_radial_variance"] == [1e8, 1.0, 4.0, 9.0] and params["obs_inlier_covariance"][0][0] == 10.0


def test_movmf_in_the_plane(spark):
    rng = np.random.default_rng(4)
    angle = np.where(np.arange(300)[:, None] < 120, rng.vonmises(0.5, 8, (300, 2)), rng.vonmises(-2.0, 20, (300, 2)))
    d = spark.createDataFrame([(p, k + 1, float(np.cos(angle[p, k])), float(np.sin(angle[p, k]))) for p in range(300) for k in range(2)], "pose_id long, keypoint long, x double, y double")
    mixture, history = poses.fit_movmf(d, 2, 12, 3, dims=2)
    assert history[-1] > history[0] and all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    one, two = sorted(mixture, key=lambda m: m["pi"])
    assert abs(one["pi"] - 0.4) < 0.02 and 5 < one["bones"][1][1] < 12 and 14 < two["bones"][2][1] < 28
    assert np.allclose(one["bones"][1][0], (np.cos(0.5), np.sin(0.5)), atol=0.1) and one["bones"][0] == ([1.0, 0.0], 0.0)
    t = np.linspace(0, 2 * np.pi, 20_001)[:-1]
    for kappa in (0.0, 1.0, 49.9, 50.1, 400.0):
        assert np.isclose((np.exp(poses.log_norm(kappa, 2) + kappa * np.cos(t))).mean() * 2 * np.pi, 1, rtol=1e-5)
    assert np.isclose(poses.log_norm(49.9999, 2), poses.log_norm(50.0001, 2), atol=1e-3)


def test_mixture_of_many_states_never_loses_likelihood_and_costs_no_more(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 3, 3))
    v = centres[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 3, 3)) * 0.2
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    d = spark.createDataFrame([(p, k + 1, *map(float, v[p, k])) for p in range(3000) for k in range(3)], "pose_id long, keypoint long, x double, y double, z double")
    units = poses.packed_directions(d, [1, 2, 3]).cache()
    units.count()
    took = {}
    for n in (2, 50):
        mixture = poses.seeded_mixture(units, n, [1, 2, 3], 3, 1)
        poses.movmf_sums(units, mixture, [1, 2, 3], 3)
        began = time.time()
        for _ in range(5):
            poses.movmf_sums(units, mixture, [1, 2, 3], 3)
        took[n] = time.time() - began
    assert took[50] < 2 * took[2] + 0.5
    mixture, history = poses.fit_movmf(d, 50, 8, 4)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:])) and abs(sum(m["pi"] for m in mixture) - 1) < 1e-6
    _, six = poses.fit_movmf(d, 6, 60, 4, still=1e-6)
    assert len(six) < 60 and six[-1] > poses.fit_movmf(d, 1, 3, 4)[1][-1] + 1
    for dims in (2, 3):
        for kappa in (0.01, 1.0, 30.0, 2000.0):
            assert np.isclose(poses.concentration(poses._mean_length(kappa, dims), dims, exact=True), kappa, rtol=1e-4)


def test_pose_filter_and_alignment(spark):
    rng = np.random.default_rng(2)
    rows = [(p, k, float(k + rng.normal() * 0.01), float(rng.normal() * 0.01), 0.0) for p in range(300) for k in range(4)]
    rows += [(300, k, float(50 * k), 0.0, 0.0) for k in range(4)] + [(301, k, None if k == 2 else float(k), 0.0, 0.0) for k in range(4)]
    d = spark.createDataFrame(rows, "pose_id long, keypoint long, x double, y double, z double")
    kept, stats = poses.filter_poses(d, [0, 0, 1, 2], 3.0)
    ids = {r.pose_id for r in kept.select("pose_id").distinct().collect()}
    assert 300 not in ids and 301 not in ids and len(ids) > 250
    assert all(abs(r["mean"] - 1) < 0.01 for r in stats.collect())
    turned = poses.standardize(d.where("pose_id < 5"), 0, 3).where("keypoint in (0, 3)").orderBy("pose_id", "keypoint").collect()
    for front, back in zip(turned[::2], turned[1::2], strict=True):
        assert front.x > back.x and abs(front.y - back.y) < 1e-9


def test_gibbs(spark):
    sf = "/root/testdata/sf0.001"
    make = lambda: IdentitySampler(RandomWalk(), queries._outliers(spark, sf), queries._affinity(spark, sf), queries._identity(spark, sf), 2, [0, 0, 1, 2], written, seed=3).initialize()
    one, two = make(), make()
    a, b = one.step(), two.step()
    assert a == b and a < 0
    assert one.assignments.exceptAll(two.assignments).count() == 0
    counts = one.assignments.groupBy("recording", "frame", "camera", "keypoint").agg(F.countDistinct("instance").alias("n")).where("n <> 2")
    assert counts.count() == 0
    assert isinstance(two.step(), float)


def test_stream_agrees_with_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = queries._identity(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame")))
    last = rows.agg(F.max("frame")).first()[0]
    closing = rows.where(F.col("frame") == last).withColumn("ts", F.col("ts") + F.expr("interval 1 hour")).withColumn("frame", F.col("frame") + 1000)
    rows.write.parquet(f"{tmp_path}/in")
    closing.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = best_identities(stream, 2).writeStream.format("memory").queryName("best").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("best").where("frame < 1000").select("recording", "frame", "camera", "keypoint", "p")
    want = queries.permutation_choice(spark, sf).select("recording", "frame", "camera", "keypoint", "p")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_crop_centroids_against_plain_arrays(spark):
    """Interpolated, the median of all keypoints, and a normal kernel over the frames, mirrored at the ends; long and short recordings."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for recording, long, first in (("a", 130, 7), ("b", 3, 0), ("c", 1, 5), ("d", 41, 100)):
        x = rng.normal(size=(4, long)).cumsum(1)
        x[rng.random(x.shape) < 0.2] = np.nan
        x[:, rng.integers(long)] = 3.0
        for s in range(4):
            rows += [(recording, 0, first + t, s // 2, s % 2, *((None, None) if np.isnan(v) else (float(v), float(2 * v))), 0.9) for t, v in enumerate(x[s])]
            ok = ~np.isnan(x[s])
            x[s] = np.interp(np.arange(long), np.flatnonzero(ok), x[s][ok])
        middle = np.median(x, 0)
        for t in range(long):
            places = np.arange(t - 8, t + 9) % (2 * long)
            w = np.exp(-((np.arange(-8, 9) / 2) ** 2) / 2)
            want[recording, first + t] = (w * middle[np.where(places < long, places, 2 * long - 1 - places)]).sum() / w.sum()
    d = spark.createDataFrame(rows, "recording string, camera long, frame long, keypoint long, instance long, x double, y double, confidence double")
    for segment in (10_000, 20):
        found = {(r.recording, r.frame): (r.cx, r.cy) for r in poses.crop_centroids(d, sigma=2, segment=segment).collect()}
        assert found.keys() == want.keys()
        assert all(np.allclose(found[k], (want[k], 2 * want[k])) for k in want)
    nothing = d.where("recording = 'b'").withColumns({c: F.lit(None).cast("double") for c in "xy"})
    assert [tuple(r) for r in poses.crop_centroids(nothing).select("cx", "cy").distinct().collect()] == [(None, None)]
    assert poses.crop_centroids(d.limit(0)).count() == 0


def test_exact_percentiles(spark):
    rng = np.random.default_rng(10)
    rows = [(k, float(v)) for k, n in enumerate((1, 2, 3, 50, 101, 3000)) for v in rng.choice([rng.normal(), 1.5, 2.5], n) + rng.integers(0, 3, n) * rng.normal(size=n)] + [(9, None), (9, 4.0), (9, float("nan"))]
    # all magnitudes and both signs, and values that differ in their last bit only
    rows += [(10, float(v)) for v in rng.choice([-1.0, 1.0], 400) * 10.0 ** rng.uniform(-300, 300, 400)] + [(11, 0.0), (11, -0.0), (11, 5e-324), (11, -5e-324), (11, float("inf")), (12, 1.0), (12, 1.0 + 2**-52), (12, 1.0 + 2**-51)]
    d = spark.createDataFrame(rows, "k int, v double")
    found = {r.k: (r.low, r.middle, r.high) for r in poses.exact_percentiles(d, "k", "v", {"low": 0.01, "middle": 0.5, "high": 0.99}).collect()}
    for k in found:
        v = [x for i, x in rows if i == k and x is not None and x == x]
        want = np.percentile(v, [1, 50, 99]) if k != 11 else (None, 0.0, float("inf"))
        assert all(w is None or g == w or np.isclose(g, w, rtol=1e-12) for g, w in zip(found[k], want, strict=True)), k
    assert len(found) == 10 and found[12][1] == 1.0 + 2**-52
    assert poses.exact_percentiles(d.limit(0), "k", "v", {"low": 0.01}).count() == 0


def test_percentiles_hold_no_values_of_a_key(spark):
    plan = poses.exact_percentiles(spark.range(1000).selectExpr("1 as k", "cast(id as double) as v"), "k", "v", {"low": 0.01})._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan


def test_kmeans_rows(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(40, 3)) + 12 * c for c in range(3)])
    d = spark.createDataFrame([*[(k, [float(v) for v in p]) for k, p in enumerate(x)], (500, None)], "id long, v array<double>")
    found = {r.id: r.cluster for r in clustering.kmeans_rows(d, "id", "v", 3).collect()}
    assert len(found) == 120 and [len({found[k] for k in range(40 * c, 40 * c + 40)}) for c in range(3)] == [1, 1, 1] and len(set(found.values())) == 3
    few = clustering.kmeans_rows(d.where("id < 2"), "id", "v", 5).collect()
    assert len({r.cluster for r in few}) == 2
    assert clustering.kmeans_rows(d.limit(0), "id", "v", 5).count() == 0


def test_sampler_resumes_from_a_written_step(spark):
    d, aff, ids = (f(spark, "/root/testdata/sf0.001") for f in (queries._outliers, queries._affinity, queries._identity))

    def sampler():
        return IdentitySampler(RandomWalk(), d, aff, ids, queries.N, queries.PARENTS, written, seed=3)

    one = sampler().initialize()
    history = one.run(3)
    assert len(history) == 3 and one.history == history
    two = sampler().initialize()
    two.run(2)
    again = sampler().restore(two.assignments, two.history)
    again.step()
    assert np.allclose(again.history, history)
    assert again.assignments.exceptAll(one.assignments).isEmpty()
    assert len(one.run(5, still=1.0)) == 4


def test_bones_place_what_is_not_seen(spark):
    """A rigid body that turns and moves: a keypoint that is hidden for a while is near where its bone puts it."""
    rows = []
    for t in range(200):
        a, x, y = 0.02 * t, 50 + 0.5 * t, 80 - 0.2 * t
        for k, (u, v) in enumerate(((0.0, 0.0), (20.0, 0.0), (10.0, 15.0))):
            hidden = k == 2 and 90 <= t < 110
            place = None if hidden else (x + u * np.cos(a) - v * np.sin(a), y + u * np.sin(a) + v * np.cos(a))
            rows.append(("r", 0, t, k, 0, *((None, None) if hidden else map(float, place)), 0))
    located = spark.createDataFrame(rows, "recording string, camera long, frame long, keypoint long, instance long, x double, y double, animal long")
    model = BoneWalk([0, 0, 0], (1, 0), reach=2).initialize(located)
    track = {(r.frame, r.keypoint): (r.tx, r.ty) for r in model.track.collect()}
    assert len(track) == 600
    for t in (95, 100, 105):
        a, x, y = 0.02 * t, 50 + 0.5 * t, 80 - 0.2 * t
        assert np.allclose(track[t, 2], (x + 10 * np.cos(a) - 15 * np.sin(a), y + 10 * np.sin(a) + 15 * np.cos(a)), atol=1.0)
    scored = model.log_likelihood(located.where("frame = 20").drop("animal").withColumn("outlier_prob", F.lit(0.01))).collect()
    assert len(scored) == 3 and all(r.logp > -8 for r in scored)
    plain = RandomWalk(reach=2).initialize(located)
    assert {(r.frame, r.keypoint) for r in plain.track.where("tx is null").collect()} == {(t, 2) for t in range(92, 108)}
