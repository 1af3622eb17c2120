import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from herdframe.operators import geometry
from herdframe.plans import views

RIG = np.array([views.projection(c) for c in range(3)])


@pytest.fixture(scope="module")
def odd_frames(spark, tmp_path_factory):
    """Frames of which some have two points that fit nearly alike."""
    folder = str(tmp_path_factory.mktemp("odd"))
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    events.where(F.expr("event_id div 24 between 1600 and 1660")).write.parquet(f"{folder}/events.parquet")
    return folder


def unlike(spark, folder, name):
    """Rows that the query or its SQL has and the other hasn't."""
    found = __spark_entry__.queries()[name](spark, folder)
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(found.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert len(want) > 400
    return set(map(tuple, found.collect())) ^ set(want)


def test_tracks_in_space_are_those_of_sql(spark, odd_frames):
    assert not unlike(spark, odd_frames, "space_loglik")


def test_points_are_the_best_fit_where_one_is_best():
    rng = np.random.default_rng(3)
    cameras = [np.array(c) for c in ([0, 1], [0, 1, 2], [1], [], [2, 0])] * 20
    points = np.c_[rng.normal(size=(100, 2)), rng.uniform(3, 9, 100)]
    xy = [np.array([(RIG[c] @ [*p, 1])[:2] / p[2] for c in cs]).reshape(-1, 2) + rng.normal(size=(len(cs), 2)) for cs, p in zip(cameras, points, strict=True)]
    got, want = geometry.rectified_points(RIG, cameras, xy), geometry.many_view_points(RIG, cameras, xy)
    assert np.isnan(got).all(1).tolist() == [len(c) < 2 for c in cameras]
    assert np.allclose(got, want, rtol=1e-6, equal_nan=True)
    assert geometry.rectified_points(RIG, [], []).shape == (0, 3)


def test_other_rigs_are_refused():
    turned = RIG.copy()
    turned[1, 0, 1] = 5.0
    with pytest.raises(ValueError, match="side by side"):
        geometry.rectified_points(turned, [np.array([0, 1])], [np.zeros((2, 2))])


def test_points_in_space_are_those_of_sql(spark, odd_frames):
    assert not unlike(spark, odd_frames, "triangulated_points")
