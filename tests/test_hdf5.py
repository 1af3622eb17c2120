import numpy as np
import pytest
from pyspark.sql import functions as F

from herdframe.plans import views
from herdframe.sources import hdf5
from herdframe.sources.hdf5 import File, Hdf5Error

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("h5"))
    tables = [f(spark, SF) for f in (views.detections, views.affinities, views.identities)]
    return folder, tables, hdf5.write_hdf5(*tables, folder, views.N, views.K)


def test_what_is_written_is_read_in_several_partitions(spark, written):
    folder, tables, files = written
    found = hdf5.read_hdf5(files, frames=10)
    assert found[0].rdd.getNumPartitions() >= files.count() * 3
    key = ["recording", "camera", "frame", "keypoint", "instance"]
    for got, want, names in zip(found, tables, ([], ["parent_instance"], ["animal"]), strict=True):
        columns = [*key, *names, *(["x", "y", "confidence"] if not names else ["weight"])]
        assert want.select(columns).exceptAll(got.select(columns)).isEmpty()
    # frames and keypoints that no row says anything of are there, and missing
    more = found[0].join(tables[0], key, "left_anti")
    assert more.where("x is not null or y is not null").isEmpty()
    assert not [p for p in __import__("os").listdir(folder) if p.startswith(".") and p.endswith(".h5")]


def test_the_layout_of_a_file(written):
    """The fixed structures are where the format says: signature, sizes, tree, heap and symbols in order of names."""
    path = written[2].first().path
    raw = open(path, "rb").read()
    assert raw[:8] == b"\x89HDF\r\n\x1a\n" and raw[13] == raw[14] == 8 and int.from_bytes(raw[40:48], "little") == len(raw)
    with File(path) as f:
        assert sorted(f.datasets) == ["affinities", "confidences", "coordinates", "identities"]
        n, t, k = f.dataset("confidences").shape
        assert f.dataset("coordinates").shape == (n, t, k, 2) and f.dataset("coordinates").dtype == "<f8"
        whole = f.values("coordinates")
        assert np.array_equal(f.frames("coordinates", 1, 3, 8), whole[:, 3:8], equal_nan=True)
        assert np.array_equal(f.frames("identities", 2, 0, t), f.values("identities"))
    assert raw.count(b"TREE") == raw.count(b"HEAP") == raw.count(b"SNOD") == 1


def test_damaged_files_are_named(spark, written, tmp_path):
    path = written[2].first().path
    raw = open(path, "rb").read()
    for cut, what in ((len(raw) - 100, "cut off"), (50, "cut off"), (0, "cut off")):
        (tmp_path / "a.h5").write_bytes(raw[:cut])
        with pytest.raises(Hdf5Error, match=what):
            File(str(tmp_path / "a.h5"))
    (tmp_path / "b.h5").write_bytes(b"not a file of this kind" * 9)
    with pytest.raises(Hdf5Error, match="not an HDF5 file"):
        File(str(tmp_path / "b.h5"))
    rows = spark.createDataFrame([("r", 0, str(tmp_path / "a.h5"))], "recording string, camera long, path string")
    with pytest.raises(Exception, match="cut off"):
        hdf5.read_hdf5(rows)[0].count()


def test_a_failed_job_leaves_no_file(spark, written, tmp_path):
    bad = written[1][0].withColumn("keypoint", F.lit(99).cast("long"))
    with pytest.raises(Exception, match="out of bounds|index"):
        hdf5.write_hdf5(bad, written[1][1], written[1][2], str(tmp_path / "out"), views.N, views.K)
    assert not [p for p in (tmp_path / "out").glob("*.h5")]


def test_calibration(spark, tmp_path):
    rows = [(c, f"camera {c}", np.eye(3).tolist(), [1.0 * c, 0.0, 0.0], [[300.0, 0.0, 245.0], [0.0, 300.0, 50.0], [0.0, 0.0, 1.0]], [0.1, 0.0, 0.0, 0.0, 0.2 * c]) for c in range(3)]
    cameras = spark.createDataFrame(rows, "camera long, name string, rotation array<array<double>>, translation array<double>, intrinsic array<array<double>>, dist_coefs array<double>")
    hdf5.write_calibration_hdf5(cameras, str(tmp_path / "c.h5"))
    found = hdf5.read_calibration_hdf5(spark, str(tmp_path / "c.h5")).orderBy("camera").collect()
    assert [tuple(r)[:6] for r in found] == rows
    assert found[2].projection == [[300.0, 0.0, 245.0, 600.0], [0.0, 300.0, 50.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
