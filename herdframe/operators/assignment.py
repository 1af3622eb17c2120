"""Assignments of any number of animals: batched linear assignment, ranks of permutations, and candidates near the best.

N animals have N! permutations, which stop being a table at five or so. The best permutation of a cell is
a linear assignment, solved for whole batches of cells by shortest augmenting paths, N * N vectorised
steps of N numbers a cell. Where a whole set of permutations is wanted (messages along a tree), the
MOST_CANDIDATES best ones near the optimum stand for all: the best one, then what swaps of two, and of three, of its animals
give. Up to five animals that is every permutation.
"""

from collections.abc import Iterator
from itertools import permutations as every
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdframe.operators.spread import dense

#: Permutations that stand for all of a cell: all of up to five animals.
MOST_CANDIDATES = 120


def assigned(scores: np.ndarray) -> np.ndarray:
    """The instance of each animal (B, N) under the permutation with the highest sum of scores (B, N instances, N animals)."""
    b, n = len(scores), scores.shape[-1]
    cost = -scores.transpose(0, 2, 1)  # rows are animals
    batch = np.arange(b)
    u, v = np.zeros((b, n + 1)), np.zeros((b, n + 1))
    owner = np.full((b, n + 1), -1)  # the row of each column; the last column is where a search starts
    way = np.zeros((b, n + 1), np.int64)
    for row in range(n):
        owner[:, n] = row
        at = np.full(b, n)
        least, done = np.full((b, n + 1), np.inf), np.zeros((b, n + 1), bool)
        live = np.ones(b, bool)
        while live.any():
            k = batch[live]
            done[k, at[k]] = True
            i = owner[k, at[k]]
            reduced = cost[k, i] - u[k, i][:, None] - v[k, :n]
            better = ~done[k, :n] & (reduced < least[k, :n])
            least[k, :n] = np.where(better, reduced, least[k, :n])
            way[k, :n] = np.where(better, at[k][:, None], way[k, :n])
            open_ = np.where(done[k, :n], np.inf, least[k, :n])
            to = open_.argmin(1)
            delta = open_[np.arange(len(k)), to]
            # rows of columns that are done, and those columns, move along
            for c in range(n + 1):
                move = done[k, c]
                if move.any():
                    u[k[move], owner[k[move], c]] += delta[move]
                    v[k[move], c] -= delta[move]
            least[k, :n] = np.where(done[k, :n], least[k, :n], least[k, :n] - delta[:, None])
            at[k] = to
            live[k] = owner[k, to] >= 0
        while (at != n).any():
            k = batch[at != n]
            back = way[k, at[k]]
            owner[k, at[k]] = owner[k, back]
            at[k] = back
    out = np.empty((b, n), np.int64)
    np.put_along_axis(out, owner[:, :n], np.broadcast_to(np.arange(n), (b, n)), 1)
    return out


def ranks(perms: np.ndarray) -> np.ndarray:
    """The place of each permutation (..., N) in lexicographic order."""
    n = perms.shape[-1]
    out = np.zeros(perms.shape[:-1], np.int64)
    for k in range(n):
        out = out * (n - k) + (perms[..., k + 1 :] < perms[..., k : k + 1]).sum(-1)
    return out


def unranked(rank: np.ndarray, n: int) -> np.ndarray:
    """The permutations (..., N) with these places."""
    digits, left = [], rank.copy()
    for k in range(n):
        f = factorial(n - 1 - k)
        digits.append(left // f)
        left = left % f
    out = np.zeros((*rank.shape, n), np.int64)
    for k in range(n - 1, -1, -1):
        out[..., k] = digits[k]
        later = out[..., k + 1 :]
        later += later >= digits[k][..., None]
    return out


def unrank(n: int):  # noqa: ANN201
    """Column function: the permutation with a number, as an array of instances by animal."""

    @F.arrow_udf("array<bigint>")
    def run(rank: pa.Array) -> pa.Array:
        found = unranked(rank.to_numpy(), n)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * n, pa.int32()), pa.array(found.reshape(-1)))

    return run


def moves(n: int) -> np.ndarray:
    """Rearrangements (M, N) of a permutation's places, nearest first: none, swaps of two, turns of three, then the others in order; at most MOST_CANDIDATES."""
    seen, out = set(), []

    def add(p: list[int]) -> None:
        if tuple(p) not in seen and len(out) < MOST_CANDIDATES:
            seen.add(tuple(p))
            out.append(p)

    start = list(range(n))
    add(start)
    for size in (2, 3):
        for places in every(range(n), size):
            p = start.copy()
            for a, b in zip(places, places[1:] + places[:1], strict=True):
                p[a] = b
            add(p)
    if factorial(n) <= MOST_CANDIDATES:
        for q in every(range(n)):
            add(list(q))
    return np.array(out)


def near(best: np.ndarray) -> np.ndarray:
    """(B, M, N): the candidates around the best permutations (B, N), in lexicographic order of a cell's own."""
    n = best.shape[1]
    found = best[:, moves(n)]
    order = np.argsort(ranks(found), axis=1, kind="stable")
    return np.take_along_axis(found, order[..., None], 1)


def best_assignment(scores: DataFrame, by: list[str], n: int, value: str = "logp") -> DataFrame:
    """(by, animal, instance, score): for rows (by, instance, animal, value) the permutation with the highest sum, for any number of animals; cells without a row count 0."""

    @F.arrow_udf("score double, instances array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for cells in batches:
            s = cells.flatten().to_numpy().reshape(-1, n, n)
            found = assigned(s)
            total = np.take_along_axis(s, found[:, None, :], 1)[:, 0].sum(1) if len(s) else np.zeros(0)
            at = pa.array(np.arange(len(s) + 1) * n, pa.int32())
            yield pa.StructArray.from_arrays([pa.array(total), pa.ListArray.from_arrays(at, pa.array(found.reshape(-1)))], ["score", "instances"])

    # every cell's scores are made up to the same size, and sums of scores don't depend on what is added to all
    wide = dense(scores.groupBy(*by, "instance", "animal").agg(F.max(value).alias("v")), by, F.col("instance") * n + F.col("animal"), n * n, cells="v")
    out = wide.select(*by, run("cells").alias("out"))
    return out.select(*by, "out.score", F.posexplode("out.instances").alias("animal", "instance")).select(*by, F.col("animal").cast("long").alias("animal"), "instance", "score")
