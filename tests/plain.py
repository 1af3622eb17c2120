"""Plain versions of the graph kernels, one cell at a time."""

import numpy as np


def connected(n: int, links: list[tuple[int, int]]) -> list[list[int]]:
    """Components in the order of their lowest node, each ascending."""
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for k in range(n):
        out.setdefault(find(k), []).append(k)
    return list(out.values())


def kmeans(points: np.ndarray, k: int, seed: int = 0, max_iters: int = 100, n_init: int = 10, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Lloyd's algorithm, the best of n_init starts: labels, centroids, inertia. Ties go to the lowest cluster; an empty one is at 0."""
    k, rng = min(k, len(points)), np.random.default_rng(seed)
    order = rng.permuted(np.tile(np.arange(len(points)), (n_init, 1)), axis=1)[:, :k]
    centroids, last, live = points[order], np.full(n_init, np.inf), np.ones(n_init, bool)
    for _ in range(max_iters):  # all starts at once; those that stand still are left alone
        d = ((points[None, :, None] - centroids[:, None]) ** 2).sum(-1)
        labels = np.argmin(d, 2)
        inertia = np.take_along_axis(d, labels[..., None], 2).sum((1, 2))
        member = (labels[..., None] == np.arange(k)).astype(float)
        counts = member.sum(1)[..., None]
        means = np.where(counts > 0, np.einsum("rnk,nd->rkd", member, points) / np.maximum(counts, 1), 0.0)
        centroids = np.where(live[:, None, None], means, centroids)
        live &= np.abs(last - inertia) >= tol
        if not live.any():
            break
        last = inertia
    best = int(np.argmin(inertia))
    return labels[best], centroids[best], float(inertia[best])


def spectral(adjacency: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Clusters of a graph by k-means on the rows of its smallest Laplacian eigenvectors; labels in order of first node."""
    _, vectors = np.linalg.eigh(np.diag(adjacency.sum(1)) - adjacency)
    rows = vectors[:, :k]
    rows = rows * np.where(rows[np.abs(rows).argmax(0), np.arange(rows.shape[1])] < 0, -1, 1)
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    labels = kmeans(rows, k, seed)[0]
    order = {label: i for i, label in enumerate(dict.fromkeys(labels.tolist()))}
    return np.array([order[label] for label in labels.tolist()])


def filtered_components(n_nodes: int, links: list[tuple[int, int]], scores: np.ndarray, n: int) -> list[list[int]]:
    """Components of more than one node; of more than n those with the highest sums of scores, ascending by them."""
    found = [c for c in connected(n_nodes, links) if len(c) > 1]
    if len(found) <= n:
        return found
    total = [round(float(scores[c].sum()), 9) for c in found]
    best = sorted(range(len(found)), key=lambda i: (-total[i], i))[:n]
    return [found[i] for i in sorted(best, key=lambda i: (total[i], -i))]


def cell_groups(cameras: np.ndarray, instances: np.ndarray, links: list[tuple[int, int]], scores: np.ndarray, n: int, split: bool = True) -> np.ndarray:
    """A group number for each node (-1: none). A lone component that repeats a camera is split into n clusters."""
    groups = filtered_components(len(cameras), links, scores, n)

    def repeats(nodes: list[int]) -> bool:
        return len(set(cameras[nodes].tolist())) < len(nodes)

    if split and len(groups) == 1 and repeats(groups[0]):
        nodes = groups[0]
        place = {k: i for i, k in enumerate(nodes)}
        a = np.zeros((len(nodes), len(nodes)))
        for i, j in links:
            if i in place and j in place:
                a[place[i], place[j]] = a[place[j], place[i]] = 1
        labels = spectral(a, n)
        groups = [[nodes[i] for i in np.flatnonzero(labels == g)] for g in range(labels.max() + 1)]
        groups = [g for g in groups if len(g) > 1]
    out = np.full(len(cameras), -1)
    for label, nodes in enumerate(groups):
        if not repeats(nodes):
            out[nodes] = label
    return out
