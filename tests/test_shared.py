import os

import pytest

from herdframe.sources.shared import removed, scratch, written


class Session:
    """A session's settings."""

    def __init__(self, **values):
        self.values = values
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def test_a_cluster_must_name_the_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Session(**{"spark.master": "spark://host:7077"}), "x")
    assert scratch(Session(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://a/b/"}), "x").startswith("hdfs://a/b/x-")
    local = Session(**{"spark.master": "local[2]"})
    assert os.path.dirname(scratch(local, "x")) == os.path.dirname(scratch(local, "y")) == local.get("spark.checkpoint.dir")


def test_removed_tables_leave_no_files(spark):
    kept, gone = written(spark.range(5), "kept"), written(spark.range(7), "gone")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    names = {os.path.dirname(f).removeprefix("file://") for f in gone.inputFiles()}
    assert len(names) == 1 and all(os.path.isdir(n) and n.startswith(folder) for n in names)
    removed(gone, spark.range(3))
    assert not any(os.path.isdir(n) for n in names) and kept.count() == 5
