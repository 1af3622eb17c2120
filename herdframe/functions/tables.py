"""Operators as table functions, to be called from SQL once register() has been called."""

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from herdframe.operators.assignment import unranked
from herdframe.operators.permutations import MOST, all_permutations
from herdframe.operators.tree import VIEWS, TreeModel

_KEYS = ["recording", "frame", "camera"]


def _table(argument: AnalyzeArgument, columns: list[str]) -> T.StructType:
    if not argument.isTable:
        raise ValueError("the first argument must be a TABLE")
    if missing := [c for c in columns if c not in argument.dataType.names]:
        raise ValueError(f"the table has no columns {missing}")
    return argument.dataType


class DecodeTree:
    """decode_tree(TABLE(views), parents, n): (recording, frame, camera, keypoint, animal, instance, log_likelihood) of views as tree.views makes them.

    Views are decoded in batches as they come, so the table needs no partitioning.
    """

    def __init__(self):
        self.held, self.parents, self.n = [], [], 0

    @staticmethod
    def analyze(views: AnalyzeArgument, parents: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        own = _table(views, [*_KEYS, "ll", "affinity"])
        keys = [T.StructField(c, own[c].dataType) for c in _KEYS]
        rest = [T.StructField(c, T.LongType()) for c in ("keypoint", "animal", "instance")]
        return AnalyzeResult(T.StructType([*keys, *rest, T.StructField("log_likelihood", T.DoubleType())]))

    def eval(self, views: Row, parents: list[int], n: int):  # noqa: ANN201
        self.parents, self.n = list(parents), n
        self.held.append(views)
        if len(self.held) >= VIEWS:
            yield from self._decoded()

    def terminate(self):  # noqa: ANN201
        if self.held:
            yield from self._decoded()

    def _decoded(self):  # noqa: ANN202
        rows, self.held = self.held, []
        shape = (len(rows), len(self.parents), self.n, self.n)
        model = TreeModel(*(np.array([r[c] for r in rows], float).reshape(shape) for c in ("ll", "affinity")), self.parents)
        chosen = model.decode()
        numbers = model.numbers(chosen)
        perms = np.array(all_permutations(self.n))[numbers] if self.n <= MOST else unranked(numbers, self.n)
        for row, found, total in zip(rows, perms.tolist(), model.log_likelihood(chosen).tolist(), strict=True):
            for k, instances in enumerate(found):
                for animal, instance in enumerate(instances):
                    yield *(row[c] for c in _KEYS), k, animal, instance, total


class PairCameras:
    """pair_cameras(TABLE(detections)): (recording, frame, keypoint, cam1, inst1, x1, y1, cam2, inst2, x2, y2) with cam1 > cam2, of detections that have a place.

    The function itself asks for its table by cell, in order of cameras; equal detections count once.
    """

    def __init__(self):
        self.cell, self.held = None, []

    @staticmethod
    def analyze(detections: AnalyzeArgument) -> AnalyzeResult:
        cell = ["recording", "frame", "keypoint"]
        own = _table(detections, [*cell, "camera", "instance", "x", "y"])
        fields = [T.StructField(c, own[c].dataType) for c in cell]
        fields += [T.StructField(f"{n}{k}", own[c].dataType) for k in (1, 2) for n, c in (("cam", "camera"), ("inst", "instance"), ("x", "x"), ("y", "y"))]
        return AnalyzeResult(T.StructType(fields), partitionBy=[PartitioningColumn(c) for c in cell], orderBy=[OrderingColumn(c) for c in ("camera", "instance", "x", "y")])

    def eval(self, detections: Row):  # noqa: ANN201
        self.cell = detections["recording"], detections["frame"], detections["keypoint"]
        own = detections["camera"], detections["instance"], detections["x"], detections["y"]
        if own[2] is None or own[3] is None or own in self.held:
            return
        for other in self.held:
            if other[0] < own[0]:
                yield *self.cell, *own, *other
        self.held.append(own)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: decode_tree and pair_cameras."""
    spark.udtf.register("decode_tree", udtf(DecodeTree))
    spark.udtf.register("pair_cameras", udtf(PairCameras))
