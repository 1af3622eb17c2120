"""Identity decoding over the skeleton tree, for every (recording, frame, camera) on its own.

One aggregation a table brings a view's scores into a fixed-length array; a vectorised kernel
then works on a batch of views at once, whatever the number of keypoints or animals. With up to
MOST animals a keypoint's states are all permutations; beyond that they are those near the best one
given its parent's best one (herdframe.operators.assignment), and sums over states are sums over these. Choices are
numbers of permutations in lexicographic order either way. Nothing depends on neighbouring frames, so views are spread freely.

Messages go up once a keypoint (children have larger numbers than their parents); choices go
down from the root, which has no parent to agree with.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdframe.operators import assignment
from herdframe.operators.permutations import MOST, all_permutations
from herdframe.operators.spread import dense
from herdframe.schemas import VIEW
from herdframe.sources.shared import written


#: Views whose tables of states a task holds at once.
VIEWS = 512


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class TreeModel:
    """Potentials of a batch of views: ll is (views, K, N, N) by instance and animal, affinity (views, K, N, N) by instance and parent's instance."""

    def __init__(self, ll: np.ndarray, affinity: np.ndarray, parents: list[int]):
        n, self.parents = ll.shape[-1], parents
        if n <= MOST:
            perms = np.array(all_permutations(n))
            self.perms = None
            own = ll[:, :, perms, np.arange(n)].sum(-1)
            clique = affinity[:, :, perms[:, None, :], perms[None, :, :]].sum(-1)
        else:
            self.perms = self._candidates(ll, affinity)
            own = np.take_along_axis(ll[:, :, None], self.perms[:, :, :, None], 3)[:, :, :, 0].sum(-1)
            clique = self._cliques(affinity)
        self.log_norm = _lse(own, 2)
        self.marginal = own - self.log_norm[..., None]
        self.row = clique - _lse(clique, 3)[..., None]
        self.col = clique - _lse(clique, 2)[:, :, None, :]
        self.sub = self.marginal.copy()
        for k in range(len(parents) - 1, 0, -1):
            self.sub[:, parents[k]] += _lse(self.col[:, k] + self.sub[:, k, :, None], 1)

    def _candidates(self, ll: np.ndarray, affinity: np.ndarray) -> np.ndarray:
        """(views, K, states, N): down the tree, permutations near the best one given the parent's best one."""
        each, best, out = np.arange(len(ll))[:, None], [], []
        for k, p in enumerate(self.parents):
            score = ll[:, k] if k == p else ll[:, k] + affinity[each[:, :, None], k, np.arange(ll.shape[-1])[None, :, None], best[p][:, None, :]]
            best.append(assignment.assigned(score))
            out.append(assignment.near(best[k]))
        return np.stack(out, 1)

    def _cliques(self, affinity: np.ndarray) -> np.ndarray:
        """(views, K, states, states of the parent): sums over animals of the affinity of instances."""
        b, k, m, n = self.perms.shape
        out, each = np.zeros((b, k, m, m)), np.arange(b)[:, None, None]
        for j, p in enumerate(self.parents):
            if j != p:
                for a in range(n):
                    out[:, j] += affinity[each, j, self.perms[:, j, :, None, a], self.perms[:, p, None, :, a]]
        return out

    def numbers(self, chosen: np.ndarray) -> np.ndarray:
        """The permutations' numbers of chosen states (views, K)."""
        if self.perms is None:
            return chosen
        return assignment.ranks(np.take_along_axis(self.perms, chosen[:, :, None, None], 2)[:, :, 0])

    def scores(self, k: int, chosen: np.ndarray) -> np.ndarray:
        if k == 0:
            return self.sub[:, 0]
        return self.sub[:, k] + self.row[np.arange(len(chosen)), k, :, chosen[:, self.parents[k]]]

    def decode(self) -> np.ndarray:
        """The best permutation of each keypoint given its parent's; of equals (to nine decimals) the lowest number."""
        out = np.zeros(self.sub.shape[:2], np.int64)
        for k in range(len(self.parents)):
            out[:, k] = np.argmax(np.round(self.scores(k, out), 9), 1)
        return out

    def sample(self, uniform: np.ndarray) -> np.ndarray:
        """A sample down the tree by the Gumbel trick; uniform is (views, K, permutations) in (0, 1)."""
        out = np.zeros(self.sub.shape[:2], np.int64)
        noise = -np.log(-np.log(uniform))
        for k in range(len(self.parents)):
            out[:, k] = np.argmax(self.scores(k, out) + noise[:, k], 1)
        return out

    def log_likelihood(self, chosen: np.ndarray) -> np.ndarray:
        views, keypoints = np.arange(len(chosen))[:, None], np.arange(len(self.parents))[None, :]
        total = self.log_norm.sum(1) + self.marginal[views, keypoints, chosen].sum(1) - np.log(self.sub.shape[2])
        inner = keypoints[:, 1:]
        return total + self.row[views, inner, chosen[:, 1:], chosen[:, np.array(self.parents[1:], int)]].sum(1)


def edge_arrays(affinity: DataFrame, n: int, parents: list[int], value: str = "logp") -> DataFrame:
    """(recording, frame, camera, affinity): a view's affinities as an array."""
    k = len(parents)
    return dense(affinity, VIEW, (F.col("keypoint") * n + F.col("instance")) * n + F.col("parent_instance"), k * n * n, affinity=value)


def views(identity: DataFrame, affinity: DataFrame, n: int, parents: list[int], value: str = "logp") -> DataFrame:
    """(recording, frame, camera, ll, affinity): the inputs of a view's tree as arrays. Of repeated rows the largest value counts; affinity may be edge_arrays() of it."""
    k = len(parents)
    ll = dense(identity, VIEW, (F.col("keypoint") * n + F.col("instance")) * n + F.col("animal"), k * n * n, ll=value)
    edges = affinity if "affinity" in affinity.columns else edge_arrays(affinity, n, parents, value)
    zeros = F.array_repeat(F.lit(0.0), k * n * n)
    return ll.join(edges, VIEW, "left").withColumn("affinity", F.coalesce("affinity", zeros))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


#: Multiplier and modulus of the minimal standard generator.
LEHMER, PRIME = 48271, 2**31 - 1


def uniform_noise(keys: np.ndarray, count: int) -> np.ndarray:
    """`count` numbers in (0, 1) for each key: a multiplicative sequence that starts at the key."""
    powers = np.array([pow(LEHMER, k + 1, PRIME) for k in range(count)], np.int64)
    return (keys.astype(np.int64) % (PRIME - 1) + 1)[:, None] * powers % PRIME / PRIME


def noise_key(names: list[str], seed: int) -> Column:
    """A number for each value of these columns and seed, the same whatever the partitions: 48 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *names, F.lit(seed)).cast("binary")), 1, 12), 16, 10).cast("long")


def view_key(seed: int) -> Column:
    return noise_key(VIEW, seed)


def decode(inputs: DataFrame, n: int, parents: list[int], seed: int | None = None) -> DataFrame:
    """(recording, frame, camera, choice array<long>, log_likelihood): the best choice, or with a seed a sample."""

    @F.arrow_udf("choice array<bigint>, log_likelihood double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        size = len(parents) * n * n
        for ll, affinity, key in batches:
            found, total = [np.zeros((0, len(parents)), np.int64)], [np.zeros(0)]
            for k in range(0, len(ll), VIEWS):
                model = TreeModel(*(_numbers(c.slice(k, VIEWS)).reshape(-1, size).reshape(-1, len(parents), n, n) for c in (ll, affinity)), parents)
                if seed is None:
                    chosen = model.decode()
                else:
                    count = model.sub.shape[1] * model.sub.shape[2]
                    chosen = model.sample(uniform_noise(key.slice(k, VIEWS).to_numpy(), count).reshape(model.sub.shape))
                found.append(model.numbers(chosen))
                total.append(model.log_likelihood(chosen))
            at = pa.array(np.arange(len(ll) + 1) * len(parents), pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(np.concatenate(found).reshape(-1))), pa.array(np.concatenate(total))], ["choice", "log_likelihood"])

    out = inputs.withColumn("out", run("ll", "affinity", F.lit(0).cast("long") if seed is None else view_key(seed)))
    return out.select(*VIEW, "out.choice", "out.log_likelihood")


def assignments(decoded: DataFrame, n: int) -> DataFrame:
    """(recording, frame, camera, keypoint, animal, instance) of decoded views."""
    # outer, as the filter that Spark infers for a plain one would run the kernel a second time; no choice is empty
    long = decoded.select(*VIEW, F.posexplode_outer("choice").alias("keypoint", "p"))
    if n <= MOST:
        perms = F.array(*[F.array(*[F.lit(i).cast("long") for i in p]) for p in all_permutations(n)])
        instances = perms[F.col("p").cast("int")]
    else:
        instances = assignment.unrank(n)("p")
    long = long.select(*VIEW, F.col("keypoint").cast("long").alias("keypoint"), F.posexplode(instances).alias("animal", "instance"))
    return long.withColumn("animal", F.col("animal").cast("long"))


def viterbi(scores: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Max-product decoding: scores[t, i, j] of going from i to j; one state more than steps, of equals the first."""
    trellis, back = start.astype(float), []
    for step in scores:
        total = trellis[:, None] + step
        back.append(np.argmax(total, 0))
        trellis = total.max(0)
    state = [int(np.argmax(trellis))]
    for pointer in reversed(back):
        state.append(int(pointer[state[-1]]))
    return np.array(state[::-1])


def step_scores(score: np.ndarray, moves: np.ndarray, n: int, eta: float) -> np.ndarray:
    """Scores (frames, from, to) of entering frames with scores (frames, permutations), given squared moves (frames, N * N)."""
    perms = np.array(all_permutations(n))
    cost = -moves.reshape(-1, n, n)[:, perms[None, :, :], perms[:, None, :]].sum(3) / eta
    move = np.exp(cost - cost.max(2, keepdims=True)) + 1e-6
    return np.log(move / move.sum(2, keepdims=True)) + score[:, None, :]


def _steps(table: pa.Table, n: int, eta: float) -> np.ndarray:
    """The same of a table in order of frames."""
    return step_scores(*(_numbers(table.column(c).combine_chunks()) for c in ("score", "moves")), n, eta)


#: Numbers in the products of one round.
CELLS = 1 << 22


def _best_ways(steps: np.ndarray) -> np.ndarray:
    """The best sum of steps from each state to each: neighbouring steps are joined two by two until one is left."""
    s = steps.shape[1]
    while len(steps) > 1:
        even = len(steps) // 2 * 2
        a, b = steps[0:even:2], steps[1:even:2]
        each = max(1, CELLS // s**3)
        joined = [(a[k : k + each, :, :, None] + b[k : k + each, None]).max(2) for k in range(0, len(a), each)]
        steps = np.concatenate([*joined, steps[even:]])
    return steps[0]


def smoothing_frames(located: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """(recording, camera, frame, score, moves): what smoothing needs of each frame; moves are squared, from an animal (row) to each of the frame before, zeros without one."""
    view = ["recording", "camera", "frame"]
    a = located.select(*view, "keypoint", "animal", "x", "y")
    b = located.select("recording", "camera", (F.col("frame") + 1).alias("frame"), "keypoint", F.col("animal").alias("was"), F.col("x").alias("px"), F.col("y").alias("py"))
    moves = a.join(b, [*view, "keypoint"]).groupBy(*view, "animal", "was")
    moves = moves.agg(F.sum((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2).alias("d"))
    own = scores.groupBy(*view).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "score"))), lambda s: s["score"]).alias("score"))
    squares = dense(moves, view, F.col("animal") * n + F.col("was"), n * n, moves="d")
    still = F.coalesce("moves", F.array_repeat(F.lit(0.0), n * n)).alias("moves")
    return own.join(squares, view, "left").select(*view, "score", still)


def smooth_permutations(located: DataFrame, scores: DataFrame, n: int, eta: float = 10.0, segment: int = 10_000) -> DataFrame:
    """Temporal continuity: the best sequence of permutations of each (recording, camera), frame by frame.

    located: (recording, camera, frame, keypoint, animal, x, y), decoded frames; scores:
    (recording, camera, frame, p, score) of relabelling a frame's animals. Going from p to q
    costs the squared moves of all animals over eta; frames without a frame before them are free.

    A sequence may have any length: each segment of frames becomes one matrix, the best score
    from any state before it to any state at its end; a sequence's matrices, one a segment, give
    the states at the ends; and each segment is decoded between its two ends. The result is the
    best sequence as a whole. Frames' scores are written once, as both passes read them.
    """
    states = len(all_permutations(n))
    view = ["recording", "camera", "frame"]
    rows = written(smoothing_frames(located, scores, n).withColumn("segment", F.expr(f"frame div {segment}")), "frames")

    def matrix(table: pa.Table) -> pa.Table:
        best = _best_ways(_steps(table.sort_by("frame"), n, eta))
        return table.select(["recording", "camera", "segment"]).slice(0, 1).append_column("m", pa.array([best.reshape(-1).tolist()], pa.list_(pa.float64())))

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        m = np.array(table.column("m").to_pylist()).reshape(-1, states, states)
        path = viterbi(m, np.zeros(states))
        out = table.select(["recording", "camera", "segment"])
        return out.append_column("start", pa.array(path[:-1], pa.int64())).append_column("stop", pa.array(path[1:], pa.int64()))

    def decode_segment(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        steps = _steps(table, n, eta)
        start = np.full(states, -np.inf)
        start[table.column("start")[0].as_py()] = 0
        last = np.full((states, states), -np.inf)
        stop = table.column("stop")[0].as_py()
        last[stop, stop] = 0
        path = viterbi(np.concatenate([steps, last[None]]), start)[1:-1]
        return table.select(view).append_column("p", pa.array(path, pa.int64()))

    matrices = rows.groupBy("recording", "camera", "segment").applyInArrow(matrix, "recording string, camera long, segment long, m array<double>")
    bounds = matrices.groupBy("recording", "camera").applyInArrow(ends, "recording string, camera long, segment long, start long, stop long")
    bounded = rows.join(bounds, ["recording", "camera", "segment"])
    return bounded.groupBy("recording", "camera", "segment").applyInArrow(decode_segment, "recording string, camera long, frame long, p long")
