import pytest

from herdframe.functions import tables
from herdframe.operators import skeletons
from herdframe.sources.config import node_hierarchy


def frames(spark, projects):
    parts = [(p, k) for p, (n, _, _) in projects.items() for k in range(n)]
    edges = [(p, i, a, b) for p, (_, es, _) in projects.items() for i, (a, b) in enumerate(es)]
    roots = [(p, r) for p, (_, _, r) in projects.items()]
    return spark.createDataFrame(parts, "project long, part long"), spark.createDataFrame(edges, "project long, place long, a long, b long"), spark.createDataFrame(roots, "project long, root long")


def test_rules_and_preorder(spark):
    projects = {
        1: (5, [(0, 3), (3, 1), (0, 2), (2, 4)], 0),
        2: (5, [(0, 3), (3, 1), (0, 2), (2, 4)], 4),
        3: (3, [(0, 1), (1, 2), (2, 0)], 0),
        4: (4, [(0, 1), (2, 3)], 0),
        5: (3, [(0, 1), (1, 0), (1, 2)], 0),
        6: (2, [(0, 7)], 0),
        7: (1, [], 0),
        8: (2, [(0, 0), (0, 1)], 0),
        9: (2, [(0, 1)], 5),
        10: (6, [(0, 1), (2, 3), (3, 4), (4, 2)], 0),
    }
    data = frames(spark, projects)
    found = {r.project: r for r in skeletons.checked(*data).collect()}
    assert {p for p, r in found.items() if r.valid} == {1, 2, 7}
    assert found[3].cycle and found[8].cycle and not found[10].cycle and found[10].n_reached == 2
    assert found[4].n_reached == 2 and found[5].repeated and found[6].unknown and found[9].unknown
    order = {}
    for r in skeletons.preorder(*data).collect():
        order.setdefault(r.project, {})[r.keypoint] = (r.part, r.parent)
    assert set(order) == {1, 2, 7}
    for p, got in order.items():
        n, edges, root = projects[p]
        names = [str(k) for k in range(n)]
        want = node_hierarchy(names, [[str(a), str(b)] for a, b in edges], str(root))
        assert [got[k] for k in range(n)] == list(zip(want.order, want.parents, strict=True))


def test_table_functions_name_what_is_missing(spark):
    tables.register(spark)
    with pytest.raises(Exception, match="no columns"):
        spark.sql("SELECT * FROM pair_cameras(TABLE(SELECT 1 AS recording))").collect()
    with pytest.raises(Exception, match="must be a TABLE"):
        spark.sql("SELECT * FROM decode_tree(1, array(0), 2)").collect()
