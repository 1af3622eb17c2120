"""Groups of detections across cameras, and their assembly into animals along the skeleton.

A (recording, frame, keypoint) has at most cameras x instances detections, so its graph is
small and bounded; cells are spread over the cluster, and a task works out the graphs of a
whole batch of cells at once, as stacked matrices.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdframe.operators.spread import spread
from herdframe.schemas import CELL

#: Cells whose matrices a task holds at once.
STACK = 4096


class Graphs:
    """The graphs of a batch of cells: nodes in order of (camera, instance), adjacency by cell, node and node."""

    def __init__(self, links: pa.Array, nodes: pa.Array):
        self.at = nodes.offsets.to_numpy().astype(np.int64)
        self.at -= self.at[0]
        many, flat = np.diff(self.at), nodes.flatten()
        self.cell = np.repeat(np.arange(len(nodes)), many)
        self.place = np.arange(len(self.cell)) - self.at[self.cell]
        size = int(many.max(initial=1))
        camera, instance = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        self.mask = np.arange(size) < many[:, None]
        self.camera = np.full(self.mask.shape, -1)
        self.camera[self.mask] = camera
        ends = links.flatten()
        of = np.repeat(np.arange(len(links)), np.diff(links.offsets.to_numpy().astype(np.int64)))
        values = [ends.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
        names = [np.unique(np.concatenate(x)) for x in ((camera, values[0], values[2]), (instance, values[1], values[3]))]

        def code(cell: np.ndarray, camera: np.ndarray, instance: np.ndarray) -> np.ndarray:
            return (cell * len(names[0]) + np.searchsorted(names[0], camera)) * len(names[1]) + np.searchsorted(names[1], instance)

        own = code(self.cell, camera, instance)
        a, b = (self.place[np.searchsorted(own, code(of, *values[k : k + 2]))] if len(of) else of for k in (0, 2))
        self.adjacent = np.zeros((len(nodes), size, size), bool)
        self.adjacent[of, a, b] = self.adjacent[of, b, a] = True
        self.scores = np.zeros(self.mask.shape)
        if flat.type.num_fields > 2:
            self.scores[self.mask] = 1 - flat.field(2).to_numpy(zero_copy_only=False)

    def listed(self, labels: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.at, pa.int32()), pa.array(labels[self.mask], pa.int64()))


def reached(adjacent: np.ndarray) -> np.ndarray:
    """Which nodes each node reaches, itself included: the matrix squared until paths of any length are in."""
    reach = adjacent | np.eye(adjacent.shape[1], dtype=bool)
    for _ in range(max(1, int(np.ceil(np.log2(max(2, adjacent.shape[1])))))):
        reach = reach.astype(np.float32) @ reach.astype(np.float32) > 0
    return reach


def component_labels(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the components of more than one node, by lowest node (-1: none); which nodes are lowest; what nodes reach."""
    reach = reached(adjacent)
    root = reach.argmax(2)
    large = reach.sum(2) > 1
    lowest = large & (root == np.arange(adjacent.shape[1]))
    number = np.cumsum(lowest, 1) - 1
    return np.where(large, np.take_along_axis(number, root, 1), -1), lowest, reach


def repeats(labels: np.ndarray, camera: np.ndarray) -> np.ndarray:
    """Nodes whose group holds their group's camera more than once, anywhere in the group."""
    same = (labels[:, :, None] == labels[:, None, :]) & (labels >= 0)[:, :, None]
    twice = (same & (camera[:, :, None] == camera[:, None, :])).sum(2) > 1
    return (same & twice[:, None, :]).any(2)


def group_labels(adjacent: np.ndarray, camera: np.ndarray, scores: np.ndarray, n: int, split: bool = True) -> np.ndarray:
    """A group number for each node of each cell (-1: none).

    Of more than n components those with the highest sums of scores stay, numbered ascending by
    them. A lone component that repeats a camera is split into n clusters; a group that still
    repeats one is left out.
    """
    labels, lowest, reach = component_labels(adjacent)
    many = lowest.sum(1)
    over = np.flatnonzero(many > n)
    if len(over):
        total = np.round(np.einsum("bij,bj->bi", reach[over].astype(float), scores[over]), 9)
        order = np.argsort(np.where(lowest[over], -total, np.inf), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        rank = np.take_along_axis(rank, reach[over].argmax(2), 1)
        labels[over] = np.where((labels[over] >= 0) & (rank < n), n - 1 - rank, -1)
    if split:
        bad = repeats(labels, camera)
        lone = np.flatnonzero((np.minimum(many, n) == 1) & bad.any(1))
        size = (labels[lone] >= 0).sum(1)
        for m in np.unique(size).tolist():
            cells = lone[size == m]
            nodes = np.argsort(labels[cells] < 0, axis=1, kind="stable")[:, :m]
            found = spectral(adjacent[cells[:, None, None], nodes[:, :, None], nodes[:, None, :]].astype(float), n)
            alone = (found[:, :, None] == found[:, None, :]).sum(2) < 2
            # numbers go to the clusters of more than one node
            used = np.stack([((found == g) & ~alone).any(1) for g in range(n)], 1)
            number = np.cumsum(used, 1) - 1
            labels[cells[:, None], nodes] = np.where(alone, -1, np.take_along_axis(number, found, 1))
    return np.where(repeats(labels, camera), -1, labels)


def kmeans(points: np.ndarray, k: int, seed: int = 0, max_iters: int = 100, n_init: int = 10, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lloyd's algorithm for stacked sets of points (sets, points, dimensions), the best of n_init starts each.

    Labels, centroids and inertia of each set. Ties go to the lowest cluster; an empty one is at 0.
    """
    sets, m, _ = points.shape
    k, rng = min(k, m), np.random.default_rng(seed)
    order = rng.permuted(np.tile(np.arange(m), (n_init, 1)), axis=1)[:, :k]
    centroids, last, live = points[:, order], np.full((sets, n_init), np.inf), np.ones((sets, n_init), bool)
    for _ in range(max_iters):  # those that stand still are left alone
        d = ((points[:, None, :, None] - centroids[:, :, None]) ** 2).sum(-1)
        labels = np.argmin(d, 3)
        inertia = np.take_along_axis(d, labels[..., None], 3).sum((2, 3))
        live &= np.abs(last - inertia) >= tol
        if not live.any():
            break
        member = (labels[..., None] == np.arange(k)).astype(float)
        counts = member.sum(2)[..., None]
        means = np.where(counts > 0, np.einsum("brmk,bmd->brkd", member, points) / np.maximum(counts, 1), 0.0)
        centroids = np.where(live[:, :, None, None], means, centroids)
        last = inertia
    best, each = np.argmin(inertia, 1), np.arange(sets)
    return labels[each, best], centroids[each, best], inertia[each, best]


def spectral(adjacency: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Clusters of stacked graphs by k-means on the rows of their smallest Laplacian eigenvectors; labels in order of first node."""
    _, vectors = np.linalg.eigh(adjacency.sum(2)[:, :, None] * np.eye(adjacency.shape[1]) - adjacency)
    rows = vectors[:, :, :k]
    top = np.take_along_axis(rows, np.abs(rows).argmax(1)[:, None, :], 1)
    rows = rows * np.where(top < 0, -1, 1)
    rows = rows / np.maximum(np.linalg.norm(rows, axis=2, keepdims=True), 1e-12)
    labels = kmeans(rows, k, seed)[0]
    is_of = labels[:, None, :] == np.arange(k)[None, :, None]
    first = np.where(is_of.any(2), is_of.argmax(2), labels.shape[1])
    rank = np.argsort(np.argsort(first, axis=1, kind="stable"), axis=1, kind="stable")
    return np.take_along_axis(rank, labels, 1)


def _labelled(edges: DataFrame, nodes: DataFrame, label, name: str) -> DataFrame:  # noqa: ANN001
    """(recording, frame, keypoint, camera, instance, name) of the nodes that label(graphs) gives a number from 0 on. Only cells with an edge do any work."""
    links = edges.groupBy(*CELL).agg(F.collect_set(F.struct("cam1", "inst1", "cam2", "inst2")).alias("links"))
    columns = [c for c in nodes.columns if c not in CELL]
    gathered = spread(nodes, CELL).groupBy(*CELL).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("nodes"))

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for links, rows in batches:
            parts = [(links.slice(k, STACK), rows.slice(k, STACK)) for k in range(0, max(1, len(rows)), STACK)]
            yield pa.concat_arrays([g.listed(label(g)) for g in (Graphs(*p) for p in parts)])

    cells = links.join(gathered, CELL)
    cells = cells.select(*CELL, F.inline(F.arrays_zip("nodes", run("links", "nodes").alias("labels"))))
    return cells.select(*CELL, "nodes.camera", "nodes.instance", F.col("labels").alias(name)).where(F.col(name) >= 0)


def cell_components(edges: DataFrame, detections: DataFrame) -> DataFrame:
    """(recording, frame, keypoint, camera, instance, component): detections with an edge and their component's number, by lowest node."""
    return _labelled(edges, detections.select(*CELL, "camera", "instance"), lambda g: component_labels(g.adjacent)[0], "component")


def group_across_cameras(edges: DataFrame, detections: DataFrame, n: int, split: bool = True) -> DataFrame:
    """(recording, frame, keypoint, camera, instance, group_id) of all detections in groups.

    edges come from geometry.edges, detections carry outlier_prob.
    """
    nodes = detections.select(*CELL, "camera", "instance", "outlier_prob")
    return _labelled(edges, nodes, lambda g: group_labels(g.adjacent, g.camera, g.scores, n, split), "group_id")


def group_affinities(groups: DataFrame, affinities: DataFrame, parents: list[int], value: str = "logp") -> DataFrame:
    """(recording, frame, keypoint, child_group, parent_group, affinity): sums over cameras and instances."""
    parent = F.array(*[F.lit(p).cast("long") for p in parents])
    child = groups.select(*CELL, "camera", "instance", F.col("group_id").alias("child_group"))
    above = groups.select("recording", "frame", F.col("keypoint").alias("parent"), "camera", F.col("instance").alias("parent_instance"), F.col("group_id").alias("parent_group"))
    scored = child.join(affinities.withColumnRenamed(value, "w"), [*CELL, "camera", "instance"]).withColumn("parent", parent[F.col("keypoint").cast("int")]).where("parent <> keypoint")
    joined = scored.join(above, ["recording", "frame", "parent", "camera", "parent_instance"])
    return joined.groupBy(*CELL, "child_group", "parent_group").agg(F.sum("w").alias("affinity"))


def group_identities(groups: DataFrame, identities: DataFrame, value: str = "logp") -> DataFrame:
    """(recording, frame, keypoint, group_id, animal, identity): sums of log-probabilities over cameras."""
    return groups.join(identities, [*CELL, "camera", "instance"]).groupBy(*CELL, "group_id", "animal").agg(F.sum(value).alias("identity"))


def assemble(groups: DataFrame, affinities: DataFrame, identities: DataFrame, n: int, parents: list[int]) -> DataFrame:
    """(recording, frame, keypoint, camera, instance, group_id, animal): groups become animals by the tree decoder."""
    from herdframe.operators import tree

    def as_view(d: DataFrame) -> DataFrame:
        return d.withColumn("camera", F.lit(0).cast("long"))

    edges = as_view(group_affinities(groups, affinities, parents)).select("recording", "frame", "camera", "keypoint", F.col("child_group").alias("instance"), F.col("parent_group").alias("parent_instance"), F.col("affinity").alias("logp"))
    own = as_view(group_identities(groups, identities)).select("recording", "frame", "camera", "keypoint", F.col("group_id").alias("instance"), "animal", F.col("identity").alias("logp"))
    decoded = tree.decode(tree.views(own, edges, n, parents), n, parents)
    found = tree.assignments(decoded, n).select(*CELL, "animal", F.col("instance").alias("group_id"))
    return groups.join(found, [*CELL, "group_id"], "left")


def initial_assignments(detections: DataFrame, affinity: DataFrame, identity: DataFrame, n: int, parents: list[int], projections: list[list[list[float]]] | None, most_outlier: float = 0.2, most_error: float = 15.0, most_divergence: float = 0.1, split: bool = True) -> DataFrame:
    """The flagship: from detections with outlier_prob and log-probabilities to animals.

    Groups are read four times from here on, so they are written once.
    """
    from herdframe.operators.geometry import edges, pair_scores
    from herdframe.sources.shared import written

    pairs = pair_scores(detections, identity, n, projections, most_outlier)
    groups = written(group_across_cameras(edges(pairs, most_error, most_divergence), detections, n, split), "groups")
    return assemble(groups, affinity, identity, n, parents)
