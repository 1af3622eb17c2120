import os

from herdframe.sources import hdf5
from herdframe.sources.hdf5 import File

KEY = "recording string, camera long, frame long, keypoint long, instance long"


def test_a_file_is_as_long_as_what_it_holds(spark, tmp_path):
    """Recordings late in a long count of frames, repeated weights, and weights of what isn't there."""
    late = 10**5
    seen = [(f"rec{r}", c, late + 100 * r + f, 1, 1, float(f), None if f == 2 else 1.0, 0.5) for r in range(4) for c in range(2) for f in (0, 2, 5)]
    weights = [(*d[:5], j, w) for d in seen for j, w in ((0, -2.0), (0, -1.0), (1, None))]
    lost = [("rec0", 0, late + 1, 1, 1, 0, 7.0), ("rec0", 0, 3, 1, 1, 0, 7.0), ("rec9", 0, late, 1, 1, 0, 7.0)]
    detections = spark.createDataFrame(seen, f"{KEY}, x double, y double, confidence double")
    affinities, identities = (spark.createDataFrame(weights + lost, f"{KEY}, {other} long, weight double") for other in ("parent_instance", "animal"))
    files = hdf5.write_hdf5(detections, affinities, identities, str(tmp_path), 2, 2)
    assert files.count() == 8
    for r in files.collect():
        with File(r.path) as f:
            assert f.dataset("coordinates").shape == (2, 6, 2, 2) and f.dataset("coordinates").first == late + 100 * int(r.recording[3:])
        assert os.path.getsize(r.path) < 10_000
    found = hdf5.read_hdf5(files)
    assert found[0].rdd.getNumPartitions() == 1  # short files share a task
    assert found[0].count() == 8 * 6 * 2 * 2
    columns = ["recording", "camera", "frame", "keypoint", "instance", "x", "y", "confidence"]
    assert {tuple(r) for r in found[0].where("x is not null").select(columns).collect()} == set(seen)
    for got, other in zip(found[1:], ("parent_instance", "animal"), strict=True):
        assert {tuple(r) for r in got.where("weight <> 0").select(*columns[:5], other, "weight").collect()} == {(*d[:5], 0, -1.0) for d in seen}
