import json
import pickle

import numpy as np
import pytest

from herdframe.operators import poses
from herdframe.sources import config, detections, sinks

PARTS = ["tail", "nose", "neck"]
TREE = config.node_hierarchy(PARTS, [["nose", "neck"], ["neck", "tail"]], "nose")


def test_hierarchy_and_rules():
    assert (TREE.names, TREE.order, TREE.parents) == (["nose", "neck", "tail"], [1, 2, 0], [0, 0, 1])
    with pytest.raises(ValueError, match="cycle"):
        config.node_hierarchy(PARTS, [["nose", "neck"], ["neck", "tail"], ["tail", "nose"]], "nose")
    with pytest.raises(ValueError, match="doesn't reach"):
        config.node_hierarchy(PARTS, [["nose", "neck"]], "nose")
    with pytest.raises(ValueError, match="not body parts"):
        config.node_hierarchy(PARTS, [["nose", "ear"]], "nose")
    bad = {"bodyparts": PARTS, "skeleton": [["nose", "ear"]], "root_node": "eye", "root_edge": ["nose", "tail"]}
    assert len(config.config_errors(bad)) == 3


def test_project(tmp_path):
    project = str(tmp_path / "p")
    dlc = tmp_path / "dlc.yaml"
    dlc.write_text(json.dumps({"multianimalproject": True, "identity": True, "project_path": "/x", "individuals": ["a", "b"], "multianimalbodyparts": PARTS, "skeleton": [["nose", "neck"], ["neck", "tail"]]}))
    assert config.setup_project(project, deeplabcut_config=str(dlc), root_node="nose", root_edge=["neck", "nose"], nonsense=1)
    assert not config.setup_project(project)
    loaded = config.load_config(project)
    assert loaded["parents"] == [0, 0, 1] and loaded["node_order"] == [1, 2, 0] and loaded["indices_egocentric"] == [0, 1] and "nonsense" not in loaded
    config.update_config(project, num_iters=7)
    assert config.load_config(project)["num_iters"] == 7 and config.load_config(project)["video_dir"] == "/x/videos"
    config.update_config(project, root_node="ear")
    with pytest.raises(ValueError, match="root_node"):
        config.load_config(project)
    assert config.config_errors(config.defaults()) == []


def dlc_file(path):
    rng = np.random.default_rng(0)
    frames = {}
    for t in range(2):
        conf = [np.array([[0.2], [0.9], [0.5]]), np.array([[0.8], [0.7]]), np.zeros((0, 1))]
        frames[f"frame{t:03d}"] = {
            "confidence": conf,
            "coordinates": [[rng.normal(size=(len(c), 2)) for c in conf]],
            "identity": [rng.random((len(c), 3)) for c in conf],
            "costs": {0: {"m1": np.arange(6.0).reshape(3, 2)}, 1: {"m1": np.zeros((2, 0))}, 2: {"m1": np.ones((3, 0))}},
        }
    data = {"metadata": {"nframes": 2, "all_joints_names": PARTS, "PAFgraph": [[0, 1], [1, 2], [0, 2]], "PAFinds": [0, 1, 2]}, **frames}
    path.write_bytes(pickle.dumps(data))
    return data


def test_deeplabcut(spark, tmp_path):
    data = dlc_file(tmp_path / "cam0_full.pickle")
    # the tree nose-tail so that the edge 0-1 of the file is in it
    tree = config.node_hierarchy(PARTS, [["nose", "tail"], ["tail", "neck"]], "nose")
    rec = spark.createDataFrame([("r", 0, str(tmp_path / "cam0_full.pickle"))], "recording string, camera long, path string")
    det, aff, ids = detections.read_deeplabcut(spark, rec, PARTS, tree.order, tree.parents, 2, ["a", "b", "c"], ["c", "a"])
    d = {(r.frame, r.keypoint, r.instance): r for r in det.collect()}
    assert len(d) == 2 * 4
    tail = tree.names.index("tail")
    assert d[0, tail, 0].confidence == 0.9 and d[0, tail, 1].confidence == 0.5
    assert d[1, tail, 0].x == data["frame001"]["coordinates"][0][0][1][0]
    a = {(r.frame, r.keypoint, r.instance, r.parent_instance): r.weight for r in aff.collect()}
    m1 = data["frame000"]["costs"][0]["m1"]
    # tail is nose's child: rows of the file are tails, peak 1 then 2
    assert a[0, tail, 0, 0] == m1[1, 0] and a[0, tail, 1, 1] == m1[2, 1] and len(a) == 2 * 4
    i = {(r.frame, r.keypoint, r.instance, r.animal): r.weight for r in ids.collect()}
    assert i[0, tail, 0, 0] == data["frame000"]["identity"][0][1][2] and i[0, tail, 0, 1] == data["frame000"]["identity"][0][1][0]
    assert detections.missing_edges(spark, [[0, 1]], tree.order, tree.parents) == [(0, 2)]
    with pytest.raises(ValueError, match="body parts"):
        list(detections.deeplabcut_rows(pickle.dumps(data), "r", 0, ["x"]))


def test_files_of_one_name_in_several_folders(spark, tmp_path):
    rows = []
    for k, folder in enumerate(("a", "b with space")):
        (tmp_path / folder).mkdir()
        data = dlc_file(tmp_path / folder / "cam0_full.pickle")
        data["frame000"]["coordinates"][0][0][1][0] = 100.0 + k
        (tmp_path / folder / "cam0_full.pickle").write_bytes(pickle.dumps(data))
        rows.append((folder, 0, ("file://" if k == 0 else "") + str(tmp_path / folder / "cam0_full.pickle")))
    tree = config.node_hierarchy(PARTS, [["nose", "tail"], ["tail", "neck"]], "nose")
    rec = spark.createDataFrame(rows, "recording string, camera long, path string")
    det, _, _ = detections.read_deeplabcut(spark, rec, PARTS, tree.order, tree.parents, 2)
    tail = tree.names.index("tail")
    found = {(r.recording, r.frame, r.keypoint, r.instance): r.x for r in det.collect()}
    assert len(found) == 2 * 2 * 4
    assert found["a", 0, tail, 0] == 100.0 and found["b with space", 0, tail, 0] == 101.0
    for rows in detections.read_deeplabcut(spark, rec.where("camera > 5"), PARTS, tree.order, tree.parents, 2):
        assert rows.count() == 0


def test_pickles_can_not_run_code():
    with pytest.raises(pickle.UnpicklingError):
        detections.restricted_load(pickle.dumps(print))


def test_sleap(spark):
    peaks = [("r", 0, 0, p, c, float(p), 0.0, v) for p, (c, v) in enumerate([(1, 0.9), (1, 0.5), (0, 0.8), (0, 0.3), (0, 0.7), (2, None)])]
    edges = [("r", 0, 0, 0, 0, 2, 0.1), ("r", 0, 0, 1, 2, 0, 0.6), ("r", 0, 0, 2, 1, 4, 0.4), ("r", 0, 0, 3, -1, 4, 0.9)]
    p = spark.createDataFrame(peaks, "recording string, camera long, frame long, peak long, channel long, x double, y double, value double")
    e = spark.createDataFrame(edges, "recording string, camera long, frame long, edge long, peak_a long, peak_b long, score double")
    tree = config.node_hierarchy(PARTS, [["nose", "tail"], ["tail", "neck"]], "nose")
    det, aff = detections.sleap_tables(p, e, tree.order, tree.parents, 2)
    tail = tree.names.index("tail")
    assert {(r.keypoint, r.instance, r.x) for r in det.collect()} == {(0, 0, 0.0), (0, 1, 1.0), (tail, 0, 2.0), (tail, 1, 4.0)}
    assert {(r.keypoint, r.instance, r.parent_instance): r.weight for r in aff.collect()} == {(tail, 0, 0): 0.6, (tail, 0, 1): 0.0, (tail, 1, 0): 0.0, (tail, 1, 1): 0.4}


def test_matched_frames_and_synchronisation(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n0,1\n2,1\n")
    m = detections.read_matched_frames(spark, str(tmp_path / "m.csv"), ["a", "b"])
    rows = sorted((r.sync_idx, r.camera, r.frame) for r in m.collect())
    assert rows == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 1)]
    d = spark.createDataFrame([("r", c, t, 0, 0, float(t), float(c), 1.0) for c in (0, 1) for t in range(3)], detections.DETECTIONS.replace("camera long, frame long", "camera long, frame long"))
    got = sorted((r.camera, r.frame, r.x) for r in detections.multicamera(spark, d, m).collect())
    assert got == [(0, 0, 0.0), (0, 1, 2.0), (1, 0, 1.0), (1, 1, 1.0)]
    assert detections.multicamera(spark, d).count() == 6
    with pytest.raises(ValueError, match="unequal"):
        detections.multicamera(spark, d.where("camera = 0 or frame < 2"))
    (tmp_path / "one.csv").write_text("a\n5\n")
    assert [tuple(r) for r in detections.read_matched_frames(spark, str(tmp_path / "one.csv"), ["a"]).collect()] == [(0, 0, 5)]


def test_calibration(spark, tmp_path):
    eye = [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]
    rig = [{"name": "a", "rotation": eye, "translation": [1, 2, 3], "intrinsic": [[2, 0, 5], [0, 2, 6], [0, 0, 1]], "dist_coefs": [0, 0, 0, 0, 0]}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rig)))
    r = detections.read_calibration(spark, str(tmp_path / "c.json")).first()
    assert r.camera == 0 and r.projection == [[2, 0, 5, 17], [0, 2, 6, 22], [0, 0, 1, 3]]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    d = spark.createDataFrame([("r", c, t, 0, 0, 1.0, None, 0.5) for c in (0, 1) for t in range(3)], detections.DETECTIONS)
    sinks.write_detections(d.where("camera = 0"), path)
    sinks.write_detections(d.withColumn("x", d.x + 1), path)
    rows = detections.read_detections(spark, path).collect()
    assert len(rows) == 6 and {(r.camera, r.x) for r in rows} == {(0, 1.0), (1, 2.0)}
    sinks.write_detections(d.where("camera = 0").withColumn("x", d.x + 9), path, overwrite=True)
    assert {(r.camera, r.x) for r in detections.read_detections(spark, path).collect()} == {(0, 10.0), (1, 2.0)}


def test_pictures(spark):
    box = sinks.crop_boxes(spark.createDataFrame([(5.0, 50.0)], "cx double, cy double"), 100, 100, 40).first()
    assert (box.x0, box.x1, box.y0, box.y1) == (0, 25, 30, 70) and box.pad_left == 7
    frames = spark.createDataFrame([("r", 0, 0, bytes(300)), ("r", 0, 1, bytes(300))], "recording string, camera long, frame long, image binary")
    lines = spark.createDataFrame([("r", 0, 0, 1, 1.0, 1.0, 4.0, 1.0)], "recording string, camera long, frame long, instance long, x double, y double, px double, py double")
    got = {r.frame: np.frombuffer(bytes(r.image), np.uint8).reshape(10, 10, 3) for r in sinks.overlay(frames, lines, 10, 10).collect()}
    assert got[0][1, 1:5].tolist() == [[255, 0, 0]] * 4 and got[0].sum() == 4 * 255 and got[1].sum() == 0


def test_overlay_options(spark):
    frames = spark.createDataFrame([("r", 0, t, bytes([100] * 1200)) for t in (0, 1)], "recording string, camera long, frame long, image binary")
    rows = [("r", 0, 0, k, a, float(5 + 8 * k), float(5 + 8 * a), 1.0) for k in range(2) for a in range(2)] + [("r", 0, 0, 2, 0, 25.0, 5.0, 1.0), ("r", 0, 0, 2, 1, None, None, 0.0)]
    d = spark.createDataFrame(rows, "recording string, camera long, frame long, keypoint long, instance long, x double, y double, confidence double")
    bones = poses.overlay_segments(d, [0, 0, 1], 20, 20)
    assert poses.overlay_segments(d, [0, 0, 1], 20, 20, keypoints=[0, 2]).count() == 0 and bones.count() == 2
    maps = [((200, 0, 0), (0, 200, 0)), ((0, 0, 200), (0, 0, 200))]
    drawn = sinks.overlay(frames, bones, 20, 20, points=d, keypoints=2, colours=maps, line_width=3, node_size=1, opacity=0.5)
    got = {r.frame: np.frombuffer(bytes(r.image), np.uint8).reshape(20, 20, 3) for r in drawn.collect()}
    assert (got[1] == 100).all()
    image = got[0]
    assert image[5, 5].tolist() == [150, 50, 50] and image[5, 13].tolist() == [50, 150, 50]  # the ends of the first animal's colours
    assert image[5, 9].tolist() == [50, 150, 50] and image[4, 9].tolist() == image[6, 9].tolist() == [50, 150, 50]  # a wide bone in its keypoint's colour
    assert image[13, 9].tolist() == [50, 50, 150] and (image[9] == 100).all() and image[4, 4].tolist() != image[5, 4].tolist()


def test_crop(spark):
    image = np.arange(300, dtype=np.uint16).astype(np.uint8).reshape(10, 10, 3)
    frames = spark.createDataFrame([("r", 0, 0, image.tobytes())], "recording string, camera long, frame long, image binary")
    boxes = sinks.crop_boxes(spark.createDataFrame([("r", 0, 0, 5.0, 1.0)], "recording string, camera long, frame long, cx double, cy double"), 10, 10, 4)
    got = np.frombuffer(bytes(sinks.cropped(frames, boxes, 10, 10, 4).first().image), np.uint8).reshape(4, 4, 3)
    assert (got[:3] == image[0:3, 3:7]).all() and got[3].sum() == 0


def test_conversion(spark, tmp_path):
    dlc_file(tmp_path / "cam0_full.pickle")
    tree = config.node_hierarchy(PARTS, [["nose", "tail"], ["tail", "neck"]], "nose")
    rec = spark.createDataFrame([("r", 0, str(tmp_path / "cam0_full.pickle"))], "recording string, camera long, path string")
    for _ in range(2):  # the second time nothing is added
        sinks.convert_deeplabcut(rec, str(tmp_path / "out"), PARTS, tree.order, tree.parents, 2)
    assert [spark.read.parquet(f"{tmp_path}/out/{t}").count() for t in ("detections", "affinities", "identities")] == [8, 8, 16]


def test_inference(spark):
    frames = spark.createDataFrame([("r", 0, t, bytes([t])) for t in range(5)], "recording string, camera long, frame long, image binary")
    found = detections.infer_peaks(frames, lambda images: [[(0, float(i[0]), 1.0, 0.5)] for i in images], batch_size=2).collect()
    assert sorted((r.frame, r.peak, r.channel, r.x) for r in found) == [(t, 0, 0, float(t)) for t in range(5)]
