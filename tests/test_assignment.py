from itertools import permutations as every

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdframe.operators import assignment, permutations, tree


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7])
def test_best_permutations_equal_enumeration(n):
    rng = np.random.default_rng(n)
    scores = rng.normal(size=(80, n, n)) * 10.0 ** rng.integers(-2, 3, (80, 1, 1))
    scores[:10] = np.round(scores[:10])
    perms = np.array(list(every(range(n))))
    best = scores[:, perms, np.arange(n)].sum(-1).max(1)
    found = assignment.assigned(scores)
    assert (np.sort(found, 1) == np.arange(n)).all()
    assert np.allclose(scores[np.arange(80)[:, None], found, np.arange(n)].sum(1), best)
    assert (assignment.ranks(perms) == np.arange(len(perms))).all()
    assert (assignment.unranked(np.arange(len(perms)), n) == perms).all()


def test_candidates_are_all_permutations_of_up_to_five_and_the_nearest_beyond():
    for n in (1, 2, 3, 4, 5):
        assert assignment.near(np.arange(n)[::-1][None])[0].tolist() == [list(p) for p in every(range(n))]
    rows = assignment.moves(10)
    assert len(rows) == assignment.MOST_CANDIDATES and (np.sort(rows, 1) == np.arange(10)).all()
    assert all(((r != np.arange(10)).sum() == 2) for r in rows[1:46])
    assert len({tuple(r) for r in rows.tolist()}) == len(rows)


def test_the_tree_over_candidates_is_the_tree_over_all(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (2, 3, 5):
        ll, affinity = rng.normal(size=(4, 3, n, n)), rng.normal(size=(4, 3, n, n))
        one = tree.TreeModel(ll, affinity, [0, 0, 1])
        with monkeypatch.context() as m:
            m.setattr(tree, "MOST", 1)
            two = tree.TreeModel(ll, affinity, [0, 0, 1])
        a, b = one.decode(), two.decode()
        assert (a == two.numbers(b)).all()
        assert np.allclose(one.log_likelihood(a), two.log_likelihood(b))
        noise = rng.uniform(size=one.sub.shape)
        assert (one.sample(noise) == two.numbers(two.sample(noise))).all()


def test_ten_animals(spark):
    """Clear scores give the animals back whatever their number, also by way of rows; weights are by place, not by N!."""
    n, rng = 10, np.random.default_rng(4)
    truth = {(f, k): rng.permutation(n) for f in range(6) for k in range(3)}
    parents = [0, 0, 1]
    identity, affinity = [], []
    for (f, k), p in truth.items():
        for a in range(n):
            for i in range(n):
                identity.append(("r", f, 0, k, i, a, float(4.0 * (p[a] == i) * (k == 0) + rng.normal() * 0.3)))
        if k:
            for a in range(n):
                for j in range(n):
                    affinity.append(("r", f, 0, k, int(p[a]), int(truth[f, parents[k]][j]), float(6.0 * (a == j) + rng.normal() * 0.3)))
    own = spark.createDataFrame(identity, "recording string, frame long, camera long, keypoint long, instance long, animal long, logp double")
    edges = spark.createDataFrame(affinity, "recording string, frame long, camera long, keypoint long, instance long, parent_instance long, logp double")
    decoded = tree.decode(tree.views(own, edges, n, parents), n, parents)
    for r in tree.assignments(decoded, n).collect():
        assert truth[r.frame, r.keypoint][r.animal] == r.instance
    best = assignment.best_assignment(own.where("keypoint = 0"), ["recording", "frame"], n).collect()
    assert len(best) == 60 and all(truth[r.frame, 0][r.animal] == r.instance for r in best)
    numbers = decoded.select("recording", "frame", F.col("choice")[0].alias("p"))
    product = permutations.compose(numbers, numbers, ["recording", "frame"], n).collect()
    for r in product:
        p = truth[r.frame, 0]
        assert assignment.unranked(np.array([r.p]), n)[0].tolist() == p[p].tolist()


def test_empty_cells_and_missing_rows(spark):
    d = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 1, 3.0), (2, 0, 0, None)], "cell int, instance long, animal long, logp double")
    found = {(r.cell, r.animal): (r.instance, r.score) for r in assignment.best_assignment(d, ["cell"], 2).collect()}
    assert found[1, 1] == (1, 3.0) and found[1, 0] == (0, 3.0) and {found[2, 0][0], found[2, 1][0]} == {0, 1}
    assert assignment.best_assignment(d.limit(0), ["cell"], 2).count() == 0
