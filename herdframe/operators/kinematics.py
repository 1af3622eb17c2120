"""Kinematics models, which score where an animal's keypoints may be, and Gibbs sampling of identities with them."""

from collections.abc import Callable
from copy import copy
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from herdframe.functions.scalars import angle, mixture_log
from herdframe.operators import geometry, tree
from herdframe.schemas import SERIES, VIEW
from herdframe.sources.shared import removed


class Kinematics(Protocol):
    """A model of one or all animals. located: detections with `animal`; detections: all instances with outlier_prob."""

    def initialize(self, located: DataFrame) -> "Kinematics": ...

    def step(self, located: DataFrame) -> "Kinematics": ...

    def log_likelihood(self, detections: DataFrame) -> DataFrame:
        """(recording, camera, frame, keypoint, instance, animal, logp)."""
        ...


def _bordered(rows: DataFrame, segment: int, reach: int) -> DataFrame:
    """Each row in all segments whose frames it is within reach of; `own` in that of its frame."""
    at = lambda shift: F.floor((F.col("frame") + shift) / segment)
    return rows.withColumn("segment", F.explode(F.sequence(at(-reach), at(reach)))).withColumn("own", F.col("segment") == at(0))


class RandomWalk:
    """Keypoints stay near their mean over the `reach` frames around: a Gaussian random walk, one 2-D track a camera.

    The likelihood is a mixture of an inlier and an outlier normal. Tracks are windows over frames
    within one segment, so their tasks are bounded by it.
    """

    def __init__(self, reach: int = 5, inlier_variance: float = 10.0, outlier_variance: float = 1e6, segment: int = 10_000):
        self.reach, self.inlier, self.outlier, self.segment = reach, inlier_variance, outlier_variance, segment
        self.track: DataFrame | None = None

    def initialize(self, located: DataFrame) -> "RandomWalk":
        return self.step(located)

    def step(self, located: DataFrame) -> "RandomWalk":
        new = copy(self)
        new.track = self._means(located).drop("seen")
        return new

    def _means(self, located: DataFrame) -> DataFrame:
        """(recording, camera, frame, keypoint, animal, tx, ty, seen): means of the frames around and how many of them have the keypoint."""
        by = W.partitionBy("recording", "camera", "keypoint", "animal", "segment").orderBy("frame").rangeBetween(-self.reach, self.reach)
        rows = _bordered(located, self.segment, self.reach)
        means = [F.avg("x").over(by).alias("tx"), F.avg("y").over(by).alias("ty"), F.count("x").over(by).alias("seen")]
        return rows.select("recording", "camera", "frame", "keypoint", "animal", "own", *means).where("own").drop("own")

    def log_likelihood(self, detections: DataFrame) -> DataFrame:
        if self.track is None:
            raise ValueError("the model needs initialize() first")
        both = detections.join(self.track, ["recording", "camera", "frame", "keypoint"])
        error = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
        return both.select(*SERIES, "frame", "animal", mixture_log(error, F.col("outlier_prob"), self.inlier, self.outlier).alias("logp"))


class BoneWalk(RandomWalk):
    """A random walk whose keypoints also hang on their parents in the skeleton.

    Each bone has a mean vector and a variance in the frame of the animal's heading, from all
    frames with both ends (a row a bone, broadcast). A keypoint's place is the mean of its track and of
    its parent's track plus the bone turned by the heading, weighted by their precisions, so a
    keypoint that isn't seen for a while is where its bone puts it. front_back are the
    keypoints that give the heading.
    """

    def __init__(self, parents: list[int], front_back: tuple[int, int], reach: int = 5, inlier_variance: float = 10.0, outlier_variance: float = 1e6, segment: int = 10_000):
        super().__init__(reach, inlier_variance, outlier_variance, segment)
        self.parents, self.front_back = parents, front_back

    def step(self, located: DataFrame) -> "BoneWalk":
        new, body = copy(self), ["recording", "camera", "frame", "animal"]
        means = self._means(located)
        front, back = self.front_back

        def at(k: int, c: str) -> Column:
            return F.max(F.when(F.col("keypoint") == k, F.col(c)))

        turn = means.groupBy(*body).agg(angle(at(front, "tx") - at(back, "tx"), at(front, "ty") - at(back, "ty")).alias("heading"))
        parent = F.array(*[F.lit(p).cast("long") for p in self.parents])[F.col("keypoint").cast("int")]
        above = means.select(*body, F.col("keypoint").alias("parent"), F.col("tx").alias("px"), F.col("ty").alias("py"))
        rows = means.withColumn("parent", parent).join(above, [*body, "parent"], "left").join(turn, body)
        c, s = F.cos("heading"), F.sin("heading")
        dx, dy = F.col("tx") - F.col("px"), F.col("ty") - F.col("py")
        bones = rows.where("parent <> keypoint").groupBy("keypoint").agg(*[f(v).alias(n) for v, k in ((c * dx + s * dy, "u"), (c * dy - s * dx, "v")) for f, n in ((F.avg, f"b{k}"), (F.var_pop, f"s{k}"))])
        rows = rows.join(F.broadcast(bones), "keypoint", "left")
        weight = F.when((F.col("parent") != F.col("keypoint")) & F.col("heading").isNotNull() & F.col("px").isNotNull(), 1 / ((F.col("su") + F.col("sv")) / 2 + self.inlier)).otherwise(0.0)
        own = F.col("seen") / self.inlier
        hung = {"tx": F.col("px") + c * F.col("bu") - s * F.col("bv"), "ty": F.col("py") + s * F.col("bu") + c * F.col("bv")}
        places = [((own * F.coalesce(t, F.lit(0.0)) + F.when(weight > 0, weight * x).otherwise(0.0)) / F.when(own + weight > 0, own + weight)).alias(t) for t, x in hung.items()]
        new.track = rows.select("recording", "camera", "frame", "keypoint", "animal", *places)
        return new


class SpaceWalk:
    """Keypoints in space: triangulated (by `solved`) from all cameras, near their mean over the `reach` frames around, seen again in each camera."""

    def __init__(self, projections: list[list[list[float]]], reach: int = 5, inlier_variance: float = 10.0, outlier_variance: float = 1e6, segment: int = 10_000, solved: Callable[..., np.ndarray] = geometry.many_view_points):
        self.projections, self.reach, self.inlier, self.outlier, self.segment, self.solved = projections, reach, inlier_variance, outlier_variance, segment, solved
        self.points: DataFrame | None = None

    def initialize(self, located: DataFrame) -> "SpaceWalk":
        return self.step(located)

    def step(self, located: DataFrame) -> "SpaceWalk":
        by = W.partitionBy("recording", "keypoint", "animal", "segment").orderBy("frame").rangeBetween(-self.reach, self.reach)
        new = copy(self)
        points = _bordered(geometry.triangulated(located, self.projections, self.solved), self.segment, self.reach)
        new.points = points.select("recording", "frame", "keypoint", "animal", "own", *[F.avg(c).over(by).alias(c) for c in "xyz"]).where("own").drop("own")
        return new

    def log_likelihood(self, detections: DataFrame) -> DataFrame:
        if self.points is None:
            raise ValueError("the model needs initialize() first")
        both = detections.join(geometry.projected(self.points, self.projections), ["recording", "camera", "frame", "keypoint"])
        error = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
        return both.select(*SERIES, "frame", "animal", mixture_log(error, F.col("outlier_prob"), self.inlier, self.outlier).alias("logp"))


class IdentitySampler:
    """Gibbs sampling: identities given tracks by a sample down the tree, then tracks given identities.

    What sweeps read again is written once, and state is a table in the shared folder after each step, so lineage stays short and an executor
    may go at any time. Samples depend on the seed, the step and the view, not on partitions.
    """

    def __init__(self, model: Kinematics, detections: DataFrame, affinity: DataFrame, identity: DataFrame, n: int, parents: list[int], write, seed: int = 0):  # noqa: ANN001
        self.model, self.detections, self.affinity, self.identity = model, detections, affinity, identity
        self.n, self.parents, self.write, self.seed = n, parents, write, seed
        self.history: list[float] = []
        self.edges: DataFrame | None = None
        self.last: DataFrame | None = None

    def _located(self, assignments: DataFrame) -> DataFrame:
        return self.detections.join(assignments, [*VIEW, "keypoint", "instance"])

    def _ready(self) -> None:
        """Writes what each sweep reads again: detections, identities, and affinities as arrays."""
        if self.edges is None:
            self.detections, self.identity = self.write(self.detections, "detections"), self.write(self.identity, "identity")
            self.edges = self.write(tree.edge_arrays(self.affinity, self.n, self.parents), "edges")

    def initialize(self) -> "IdentitySampler":
        """The most likely identities without a kinematics model."""
        self._ready()
        found = tree.decode(tree.views(self.identity, self.edges, self.n, self.parents), self.n, self.parents)
        self.last = self.write(found, "sample")
        self.assignments = tree.assignments(self.last, self.n)
        self.model = self.model.initialize(self._located(self.assignments))
        return self

    def step(self) -> float:
        """One sweep; the log-likelihood of the sampled identities. The tables of the sweep before are removed, as nothing here reads them any more."""
        keys = [*SERIES, "frame", "animal"]
        motion = self.model.log_likelihood(self.detections).withColumnRenamed("logp", "motion")
        joint = self.identity.join(motion, keys, "left").withColumn("logp", F.col("logp") + F.coalesce("motion", F.lit(0.0)))
        found = tree.decode(tree.views(joint, self.edges, self.n, self.parents), self.n, self.parents, seed=self.seed + len(self.history) + 1)
        found, before, model = self.write(found, "sample"), self.last, self.model
        self.last, self.assignments = found, tree.assignments(found, self.n)
        self.model = model.step(self._located(self.assignments))
        if before is not None:
            removed(before)
        if (held := getattr(model, "bodies", None)) is not None:
            removed(held)
        self.history.append(found.agg(F.sum("log_likelihood")).first()[0] or 0.0)
        return self.history[-1]

    def run(self, most: int, still: float = 0.0) -> list[float]:
        """Up to `most` sweeps, until the log-likelihood changes by less than that share of itself; the history of it."""
        for _ in range(most):
            self.step()
            if len(self.history) > 1 and abs(self.history[-1] - self.history[-2]) < still * abs(self.history[-1]):
                break
        return list(self.history)

    def restore(self, assignments: DataFrame, history: list[float]) -> "IdentitySampler":
        """Goes on from the written assignments of a step and the history up to it, with the same samples as without a break."""
        self._ready()
        self.assignments, self.last, self.history = assignments, None, list(history)
        self.model = self.model.initialize(self._located(assignments))
        return self
