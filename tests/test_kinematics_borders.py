from herdframe.operators.kinematics import RandomWalk


def test_windows_reach_over_segment_borders(spark):
    rows = [("r", 0, f, 0, 0, float(f * f), float(-f)) for f in range(40)]
    located = spark.createDataFrame(rows, "recording string, camera int, frame long, keypoint int, animal int, x double, y double")
    found = {r.frame: r.tx for r in RandomWalk(reach=5, segment=10).step(located).track.collect()}
    for f in range(40):
        near = [g * g for g in range(max(0, f - 5), min(40, f + 6))]
        assert abs(found[f] - sum(near) / len(near)) < 1e-9
    assert RandomWalk(reach=5, segment=10).step(located).track.count() == 40
