"""Connected components of a graph of links, as Spark jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdframe.llm.common import removed, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node that can be reached, for every node of a link.

    Each round takes over the smallest label among neighbours and then the label's own label, so
    a chain of n nodes takes about log n rounds. Labels are summed up by node with partial sums
    and joins can be split, so a node may have any share of the links. Each round ends in the
    shared folder, and the round before it is deleted. No links give no rows.
    """
    one, other = F.col(a).alias("node"), F.col(b).alias("next")
    both = links.select(one, other).union(links.select(other.alias("node"), one.alias("next"))).where("node <> next").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("node").agg(F.min(F.least("node", "next")).alias("component")), "labels")
    while True:
        near = both.join(labels, "node").groupBy(F.col("next").alias("node")).agg(F.min("component").alias("near"))
        taken = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        last, labels = labels, written(taken.join(up, "component").select("node", "old", F.least("component", "up").alias("component")), "labels")
        removed(last)
        if labels.where("old <> component").isEmpty():
            removed(both)
            return labels.drop("old")
