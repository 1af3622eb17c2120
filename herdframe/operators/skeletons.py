"""The rules of skeletons for many projects at once, and trees in preorder.

A project's parts and edges are few, so a project is one row and its reach is worked out in that
row; the preorder of all valid trees comes from one recursive query, a round a depth.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdframe.sources.shared import written


def undirected(edges: DataFrame) -> DataFrame:
    """(project, place, a, b): each edge once, a < b, at its first place; loops stay."""
    rows = edges.select("project", "place", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return rows.groupBy("project", "a", "b").agg(F.min("place").alias("place"))


def checked(parts: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(project, n_parts, n_edges, n_reached, repeated, unknown, cycle, valid) for parts (project, part), edges (project, place, a, b) and roots (project, root).

    repeated: an edge occurs twice, in either direction; unknown: edges or the root name parts that aren't there; cycle: the
    root's component has one; valid: a tree over all parts. A project without edges is valid if it has one part.
    """
    held = parts.groupBy("project").agg(F.collect_set("part").alias("parts"))
    listed = edges.groupBy("project").agg(F.count("*").alias("listed"))
    own = undirected(edges).groupBy("project").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    rows = held.join(own, "project", "left").join(listed, "project", "left").join(roots, "project")
    none = F.array().cast(own.schema["edges"].dataType)
    rows = rows.withColumns({"edges": F.coalesce("edges", none), "listed": F.coalesce("listed", F.lit(0))})
    ends = F.array_distinct(F.flatten(F.array(F.transform("edges", lambda e: e["a"]), F.transform("edges", lambda e: e["b"]), F.array("root"))))
    rows = rows.withColumn("unknown", F.size(F.array_except(ends, "parts")) > 0)
    touched = "flatten(transform(filter(edges, e -> array_contains(r, e.a) or array_contains(r, e.b)), e -> array(e.a, e.b)))"
    reach = F.expr(f"aggregate(sequence(1, size(parts)), array(root), (r, i) -> array_distinct(concat(r, {touched})))")
    rows = rows.withColumn("reach", F.array_intersect(reach, "parts"))
    inside = F.size(F.filter("edges", lambda e: F.array_contains(F.col("reach"), e["a"])))
    out = rows.select(
        "project",
        F.size("parts").cast("long").alias("n_parts"),
        F.size("edges").cast("long").alias("n_edges"),
        F.size("reach").cast("long").alias("n_reached"),
        (F.col("listed") > F.size("edges")).alias("repeated"),
        "unknown",
        (inside >= F.size("reach")).alias("cycle"),
    )
    return out.withColumn("valid", ~F.col("repeated") & ~F.col("unknown") & ~F.col("cycle") & (F.col("n_reached") == F.col("n_parts")))


def preorder(parts: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(project, keypoint, part, parent): the parts of each valid project in preorder from 0 on, neighbours in order of their edges, and the parent's keypoint (the root's own)."""
    # each round of the recursion reads these again, so they are written once
    start = written(roots.join(checked(parts, edges, roots).where("valid").select("project"), "project").select("project", "root"), "roots")
    kept = undirected(edges).join(start.select("project"), "project")
    both = written(kept.select("project", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))).alias("e"), "place").select("project", "e.*", "place"), "edges")
    walked = parts.sparkSession.sql(
        """WITH RECURSIVE walk (project, part, above, path) AS (
             SELECT project, root, root, array(-1L) FROM {start}
             UNION ALL
             SELECT w.project, e.next, w.part, w.path || array(e.place) FROM walk w JOIN {both} e ON e.project = w.project AND e.node = w.part AND e.next <> w.above)
           SELECT project, part, above, row_number() OVER (PARTITION BY project ORDER BY path) - 1 AS keypoint FROM walk""",
        start=start,
        both=both,
    )
    walked = written(walked.withColumn("keypoint", F.col("keypoint").cast("long")), "walked")
    above = walked.select("project", F.col("part").alias("above"), F.col("keypoint").alias("parent"))
    return walked.join(above, ["project", "above"]).select("project", "keypoint", "part", "parent")
