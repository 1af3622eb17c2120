from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from herdframe.operators import permutations, tree


def plain(ll, affinity, parents):
    """Potentials by loops over one view."""
    n, perms = ll.shape[-1], permutations.all_permutations(ll.shape[-1])
    own = np.array([[sum(ll[k, p[a], a] for a in range(n)) for p in perms] for k in range(len(parents))])
    clique = np.array([[[sum(affinity[k, c[a], q[a]] for a in range(n)) for q in perms] for c in perms] for k in range(len(parents))])
    lse = lambda x, axis: np.log(np.exp(x).sum(axis, keepdims=True))
    return own - lse(own, 1), clique - lse(clique, 2), clique - lse(clique, 1)


def test_messages_are_sums_over_all_subtrees():
    rng = np.random.default_rng(0)
    parents = [0, 0, 1, 1, 0]
    ll, affinity = rng.normal(size=(1, 5, 3, 3)), rng.normal(size=(1, 5, 3, 3))
    model = tree.TreeModel(ll, affinity, parents)
    own, _, col = plain(ll[0], affinity[0], parents)
    for root in range(6):
        total = 0.0
        for rest in product(range(6), repeat=4):
            s = (root, *rest)
            total += np.exp(sum(own[k, s[k]] for k in range(5)) + sum(col[k, s[k], s[parents[k]]] for k in range(1, 5)))
        assert np.isclose(model.sub[0, 0, root], np.log(total))


def test_choice_is_greedy_from_the_root_and_the_likelihood_adds_up():
    rng = np.random.default_rng(1)
    parents = [0, 0, 1]
    ll, affinity = rng.normal(size=(4, 3, 3, 3)), rng.normal(size=(4, 3, 3, 3))
    model = tree.TreeModel(ll, affinity, parents)
    choice = model.decode()
    for v in range(4):
        own, row, _ = plain(ll[v], affinity[v], parents)
        for k in range(3):
            score = model.sub[v, k] + (row[k, :, choice[v, parents[k]]] if k else 0)
            assert choice[v, k] == np.argmax(score)
        want = model.log_norm[v].sum() + sum(own[k, choice[v, k]] for k in range(3)) + sum(row[k, choice[v, k], choice[v, parents[k]]] for k in (1, 2)) - np.log(6)
        assert np.isclose(model.log_likelihood(choice)[v], want)


def test_direction_of_a_three_cycle(spark):
    """Instance i surely is animal (i + 1) % 3: animal a takes instance (a + 2) % 3, not its inverse."""
    rows = [("r", 0, 0, k, i, a, 0.0 if a == (i + 1) % 3 else -9.0) for k in range(2) for i in range(3) for a in range(3)]
    identity = spark.createDataFrame(rows, "recording string, camera long, frame long, keypoint long, instance long, animal long, logp double")
    affinity = spark.createDataFrame([], "recording string, camera long, frame long, keypoint long, instance long, parent_instance long, logp double")
    found = tree.assignments(tree.decode(tree.views(identity, affinity, 3, [0, 0]), 3, [0, 0]), 3).collect()
    assert {(r.keypoint, r.animal, r.instance) for r in found} == {(k, a, (a + 2) % 3) for k in range(2) for a in range(3)}


def test_ties_take_the_lowest_permutation():
    model = tree.TreeModel(np.zeros((1, 2, 3, 3)), np.zeros((1, 2, 3, 3)), [0, 0])
    assert model.decode().tolist() == [[0, 0]]


def test_samples_follow_the_marginals():
    rng = np.random.default_rng(2)
    ll, affinity = rng.normal(size=(1, 2, 2, 2)), rng.normal(size=(1, 2, 2, 2))
    many = 20_000
    model = tree.TreeModel(np.repeat(ll, many, 0), np.repeat(affinity, many, 0), [0, 0])
    noise = tree.uniform_noise(rng.integers(0, 2**48, many), 4).reshape(many, 2, 2)
    assert 0 < noise.min() and noise.max() < 1
    chosen = model.sample(noise)
    root = np.exp(model.sub[0, 0])
    child = np.exp(model.sub[0, 1][:, None] + model.row[0, 1])
    joint = (root / root.sum())[:, None] * (child / child.sum(0)).T
    got = np.array([[(chosen[:, 0] == a).__and__(chosen[:, 1] == b).mean() for b in (0, 1)] for a in (0, 1)])
    assert np.abs(got - joint).max() < 0.015


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(3)
    scores, start = rng.normal(size=(4, 3, 3)), rng.normal(size=3)
    best = max(product(range(3), repeat=5), key=lambda s: start[s[0]] + sum(scores[t, s[t], s[t + 1]] for t in range(4)))
    assert tree.viterbi(scores, start).tolist() == list(best)
    assert tree.viterbi(np.zeros((0, 3, 3)), start).tolist() == [int(np.argmax(start))]


@settings(max_examples=20, deadline=None)
@given(st.permutations(range(3)), st.integers(0, 1000))
def test_relabelled_instances_give_relabelled_animals(perm, seed):
    rng = np.random.default_rng(seed)
    ll, affinity = rng.normal(size=(1, 3, 3, 3)), rng.normal(size=(1, 3, 3, 3))
    perms = permutations.all_permutations(3)
    one = [perms[p] for p in tree.TreeModel(ll, affinity, [0, 0, 1]).decode()[0]]
    moved = np.argsort(perm)
    two = [perms[p] for p in tree.TreeModel(ll[:, :, moved], affinity[:, :, moved][:, :, :, moved], [0, 0, 1]).decode()[0]]
    assert [[int(moved[i]) for i in p] for p in two] == [list(p) for p in one]


def test_assignments_run_the_kernel_once(spark):
    rows = spark.createDataFrame([("r", t, 0, [1.0, 0.0, 0.0, 1.0] * 2, [0.0] * 8) for t in range(3)], "recording string, frame long, camera long, ll array<double>, affinity array<double>")
    found = tree.assignments(tree.decode(rows, 2, [0, 0]), 2)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert sorted((r.frame, r.keypoint, r.animal, r.instance) for r in found.collect()) == [(t, k, a, a) for t in range(3) for k in (0, 1) for a in (0, 1)]


def test_permutation_tables(spark):
    perms = permutations.all_permutations(3)
    assert perms == sorted(perms) and permutations.permutation_index([2, 0, 1]) == 4
    for r in permutations.permutation_products(spark, 3).collect():
        assert perms[r.product] == tuple(perms[r.i][perms[r.j][k]] for k in range(3))
    one = spark.createDataFrame([(1, 3)], "frame long, p long")
    two = spark.createDataFrame([(1, 3)], "frame long, p long")
    assert perms[permutations.compose(one, two, ["frame"], 3).first().p] == tuple(perms[3][perms[3][k]] for k in range(3))


def test_smoothing_over_segments_is_the_best_sequence(spark):
    rng = np.random.default_rng(6)
    n, frames, eta = 2, 6, 3.0
    xy = rng.normal(size=(frames, n, 2)) * 2
    score = rng.normal(size=(frames, 2))
    located = spark.createDataFrame([("r", 0, t, 0, a, *map(float, xy[t, a])) for t in range(frames) for a in range(n)], "recording string, camera long, frame long, keypoint long, animal long, x double, y double")
    scores = spark.createDataFrame([("r", 0, t, p, float(score[t, p])) for t in range(frames) for p in range(2)], "recording string, camera long, frame long, p long, score double")
    perms = permutations.all_permutations(n)

    def move(t, p, q):
        cost = [-sum(((xy[t, perms[w][k]] - xy[t - 1, perms[p][k]]) ** 2).sum() for k in range(n)) / eta for w in range(2)]
        odds = np.exp(np.array(cost) - max(cost)) + 1e-6
        return np.log(odds / odds.sum())[q]

    best = max(product(range(2), repeat=frames), key=lambda s: sum(score[t, s[t]] for t in range(frames)) + sum(move(t, s[t - 1], s[t]) for t in range(1, frames)))
    for segment in (2, 4, 100):
        found = {r.frame: r.p for r in tree.smooth_permutations(located, scores, n, eta, segment).collect()}
        assert [found[t] for t in range(frames)] == list(best)
