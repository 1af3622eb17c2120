"""Streams with state: what they give equals the batch operators', however rows are cut, and after a restart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdframe.operators import transforms, tree
from herdframe.streaming import ordered

SCHEMA = "recording string, camera long, keypoint long, instance long, frame long, x double, y double, ts timestamp"


def stamped(frame):
    return f"2024-01-01 00:{frame // 60:02d}:{frame % 60:02d}"


def series(seed=1, frames=120):
    rng = random.Random(seed)
    rows = []
    for k in range(3):
        for f in range(frames):
            gone = rng.random() < 0.3 or (k == 1 and f < 7) or (k == 2 and f > 110)
            rows.append(("r", 0, k, 0, f, None if gone else rng.uniform(0, 9), None if gone else float(f), stamped(f)))
    return rows


def run(spark, build, rows, schema, folder, parts):
    """Feeds the rows in parts, each in its own order, with a restart between every two of them; the rows of all keys that end."""
    out, source = f"{folder}/out", f"{folder}/in"
    late = spark.createDataFrame([], schema).schema
    for k, part in enumerate(parts):
        d = spark.createDataFrame(part, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
        d.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(late).parquet(source)
        q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        if k == 0:
            first = spark.read.parquet(out).count() if q.lastProgress else 0
    return spark.read.parquet(out), first


def cut(rows, n, seed):
    """Parts by time whose rows are shuffled, and some of each come a part later."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[-1])
    size = -(-len(rows) // n)
    parts = [rows[k : k + size] for k in range(0, len(rows), size)]
    for k in range(n - 1):
        moved = [r for r in parts[k] if r[-1] >= parts[k][-1][-1][:-2] + "50" and rng.random() < 0.3]
        parts[k + 1] = moved + parts[k + 1]
        parts[k] = [r for r in parts[k] if r not in moved]
    for p in parts:
        rng.shuffle(p)
    return parts


CLOSING = [("z", 9, 0, 0, f, 1.0, 1.0, t) for f, t in ((0, "2024-01-01 03:00:00"), (1, "2024-01-01 09:00:00"), (2, "2024-01-01 15:00:00"))]


def test_interpolation_with_a_bounded_delay(spark, tmp_path):
    rows = series()
    batch = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string"))
    want = {(r.keypoint, r.frame): (r.x, r.y) for r in transforms.interpolate(batch).collect()}
    parts = [*cut(rows, 3, 5), CLOSING[:1], CLOSING[1:2], CLOSING[2:]]
    found, _ = run(spark, lambda s: ordered.interpolate_stream(s, late="15 seconds"), rows, SCHEMA, str(tmp_path), parts)
    got = {(r.keypoint, r.frame): (r.x, r.y) for r in found.where("recording = 'r'").collect()}
    assert got.keys() == want.keys() and found.where("recording = 'r'").count() == len(want)
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_long_gaps_are_not_waited_for():
    step = ordered.Filling(most=3)
    memory = step.begin()
    out = []
    for f in range(12):
        out += step.take(memory, [f, *((float(f), 0.0) if f in (1, 8, 9) else (None, None))])
        assert len(memory["open"]) <= 3
    out += step.end(memory)
    assert [o[0] for o in out] == list(range(12))
    held = dict((o[0], o[1]) for o in out)
    assert held[0] == 1.0 and held[2] == 1.0 and held[4] == 1.0 and held[1] == 1.0 and held[8] == 8.0 and held[11] == 9.0
    assert 1.0 < held[5] < held[6] < held[7] < 8.0


@pytest.mark.parametrize("lag", [4, 1000])
def test_smoothing_with_a_fixed_lag(spark, tmp_path, lag):
    rng = np.random.default_rng(7)
    frames, n = 90, 2
    rows = [("r", 0, f, [float(v) for v in rng.normal(size=2) * 2], None if f == 0 else [float(v) for v in rng.uniform(0, 40, 4)], stamped(f)) for f in range(frames)]
    steps = tree.step_scores(np.array([r[3] for r in rows]), np.array([r[4] or [0.0] * 4 for r in rows]), n, 10.0)
    want = tree.viterbi(steps, np.zeros(2))[1:]
    schema = "recording string, camera long, frame long, score array<double>, moves array<double>, ts timestamp"
    closing = [("z", 9, k, [0.0, 0.0], None, t) for k, t in enumerate(("2024-01-01 03:00:00", "2024-01-01 09:00:00", "2024-01-01 15:00:00"))]
    parts = [rows[:40], rows[:39:-1], closing[:1], closing[1:2], closing[2:]]
    found, _ = run(spark, lambda s: ordered.smooth_stream(s, n, lag=lag), rows, schema, str(tmp_path), parts)
    got = {r.frame: r.p for r in found.where("recording = 'r'").collect()}
    assert sorted(got) == list(range(frames))
    agree = np.mean([got[f] == want[f] for f in range(frames)])
    assert agree == 1.0 if lag > frames else agree > 0.9


def test_state_stays_small():
    step = ordered.Smoothing(2, 10.0, 5)
    memory = step.begin()
    rng = np.random.default_rng(1)
    out = []
    for f in range(500):
        out += step.take(memory, [f, rng.normal(size=2).tolist(), None])
        assert len(memory["frames"]) <= 5 and len(memory["back"]) <= 5
    assert [o[0] for o in [*out, *step.end(memory)]] == list(range(500))
