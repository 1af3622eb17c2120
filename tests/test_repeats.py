"""Repeated rows of a cell count once, the largest weight, in whatever reads them."""

from pyspark.sql import functions as F

from herdframe.operators import assignment, grouping, permutations, transforms, tree
from herdframe.plans import views

SF = "/root/testdata/sf0.001"


def same(a, b):
    columns = sorted(a.columns)
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


def test_repeated_weights_change_nothing(spark):
    identities, affinities = views.identities(spark, SF), views.affinities(spark, SF)
    more = lambda d: d.union(d).union(d.withColumn("weight", F.col("weight") / 3)).union(d.withColumn("weight", F.lit(None).cast("double")))
    own, edges = transforms.identity_logprobs(identities).drop("weight"), transforms.affinity_logprobs(affinities).drop("weight")
    own2, edges2 = transforms.identity_logprobs(more(identities)).drop("weight"), transforms.affinity_logprobs(more(affinities)).drop("weight")
    assert same(own, own2) and same(edges, edges2)
    by, n = ["recording", "frame", "camera", "keypoint"], views.N
    groups = own.select("recording", "frame", "keypoint", "camera", "instance").distinct().withColumn("group_id", F.col("instance"))
    for f in (
        lambda i, a: permutations.best_permutation(permutations.permutation_scores(i, by, n), by).drop("score"),
        lambda i, a: permutations.clique_affinity(a, n).select(*by, "child_p", "parent_p", F.round("logp", 9).alias("logp")),
        lambda i, a: assignment.best_assignment(i, by, n).drop("score"),
        lambda i, a: tree.assignments(tree.decode(tree.views(i, a, n, views.PARENTS), n, views.PARENTS), n),
        lambda i, a: grouping.group_identities(groups, i).withColumn("identity", F.round("identity", 9)),
        lambda i, a: grouping.group_affinities(groups, a, views.PARENTS).withColumn("affinity", F.round("affinity", 9)),
    ):
        assert same(f(own, edges), f(own2, edges2))


def test_long_arrays_are_laid_out_as_short_ones(spark, monkeypatch):
    from herdframe.operators import spread

    rows = spark.createDataFrame([("a", 0, 1.5), ("a", 0, -2.0), ("a", 3, -4.0), ("b", 1, None), ("b", 2, 7.0)], "k string, p int, v double")
    want = sorted(tuple(r) for r in spread.dense(rows, ["k"], F.col("p"), 4, v="v", w=F.col("v") * 2).collect())
    assert want == [("a", [1.5, 0.0, 0.0, -4.0], [3.0, 0.0, 0.0, -8.0]), ("b", [0.0, 0.0, 7.0, 0.0], [0.0, 0.0, 14.0, 0.0])]
    monkeypatch.setattr(spread, "WIDE", 1)
    assert sorted(tuple(r) for r in spread.dense(rows, ["k"], F.col("p"), 4, v="v", w=F.col("v") * 2).collect()) == want
    assert spread.dense(rows.limit(0), ["k"], F.col("p"), 4, v="v").count() == 0


def test_no_sort_stands_inside_a_lambda(spark):
    held = tree.views(transforms.identity_logprobs(views.identities(spark, SF)), transforms.affinity_logprobs(views.affinities(spark, SF)), views.N, views.PARENTS)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "collect_list" not in plan
