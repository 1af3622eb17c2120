"""A Merkle manifest of a dataset: a tree a source, a tree over the sources, and proofs of single rows.

A row's leaf is the hash of its columns, each as `-` if null, else its UTF-8 byte count, `:` and
its value. Neighbouring nodes become one in runs of RUN (the last run may have fewer, even
one) until one is left. Leaves of a source ascend by id, subroots by source (null first, bytewise).

Checkpoint and recompute: only every STEP-th level is stored, as aligned subtrees, a row of at
most RUN ** STEP neighbouring nodes each, in the shared folder. Building a tree reads each stored level once and
makes the next one. Proofs go down again: the nodes between two stored levels are made anew
for each subtree on its own, give its nodes their siblings, and are dropped. What a subtree's
own proof is reaches its nodes by one join a stored level, on (tree, subtree), so no key holds
more than RUN ** STEP rows however large a source is.

A path is the siblings level by level: left ones, a point, right ones; levels are joined by commas.

Places of leaves come from a range partitioning by (tree, id, leaf, row): a source of any share lies in
many partitions, and partitions' counts a tree are summed up before them. Rows of one
id are leaves of their own, by leaf; a null id comes first and is never tampered with. An empty table has no rows and no root.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdframe.llm.common import partitions, written

#: Nodes that become one, levels from one stored level to the next, nodes of a stored subtree.
RUN, STEP = 3, 3
SPAN = RUN**STEP


def digest(*fields: Column) -> Column:
    """The leaf of a row: the hash of its fields in this order."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climbed(nodes: list[str], size: int) -> list[list[str]]:
    """The levels of a stored subtree from its nodes up, at most STEP more; size is the number of nodes in the tree's whole level."""
    levels = [nodes]
    while len(levels) <= STEP and size > 1:
        nodes = [_hash("".join(nodes[k : k + RUN])) for k in range(0, len(nodes), RUN)]
        size = -(-size // RUN)
        levels.append(nodes)
    return levels


def siblings(levels: list[list[str]]) -> list[str]:
    """The path of each node of the lowest level up to the subtree's top."""
    out = []
    for k in range(len(levels[0])):
        path = []
        for nodes in levels[:-1]:
            first = k - k % RUN
            path.append("".join(nodes[first:k]) + "." + "".join(nodes[k + 1 : first + RUN]))
            k //= RUN
        out.append(",".join(path))
    return out


@F.arrow_udf(T.StringType())
def _top(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for nodes, sizes in batches:
        yield pa.array([climbed(x, s)[-1][0] for x, s in zip(nodes.to_pylist(), sizes.to_pylist(), strict=True)], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _paths(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for nodes, sizes in batches:
        yield pa.array([siblings(climbed(x, s)) for x, s in zip(nodes.to_pylist(), sizes.to_pylist(), strict=True)], pa.list_(pa.string()))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `pos`, their place in their `tree` by the order from 0 on, and `size`, the tree's number of rows; both go through written tables."""
    keys = ["tree", *order, "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop("row").withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("at", 33))
    each = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("many").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = written(each.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("many").over(tree).alias("size")), "places")
    return dealt.join(each, ["tree", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "size")


def stored(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels (tree, node, size, nodes, top) of leaves (tree, pos, size, h, ...), lowest first: a row an aligned subtree. A tree's last one has size <= SPAN."""
    bands, level = [], leaves
    while True:
        fields = [c for c in level.columns if c not in ("tree", "size")]
        subtrees = level.groupBy("tree", "size", F.expr(f"pos div {SPAN}").alias("node")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("nodes"))
        bands.append(written(subtrees.withColumn("top", _top(F.col("nodes.h"), "size")), "level"))
        level = bands[-1].where(F.col("size") > SPAN).select(F.col("node").alias("pos"), "tree", F.ceil(F.col("size") / SPAN).alias("size"), F.col("top").alias("h"))
        if level.isEmpty():
            return bands


def roots(bands: list[DataFrame]) -> DataFrame:
    """(tree, root)."""
    tops = [b.where(F.col("size") <= SPAN).select("tree", F.col("top").alias("root")) for b in bands]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def proofs(bands: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The leaves' fields with `path` and the columns of outer (tree, path, ...): a tree's own path and what else its leaves take over."""
    held = [c for c in outer.columns if c not in ("tree", "path")]
    inner = None
    for band in reversed(bands):
        rows = band.where(F.col("size") <= SPAN).join(outer, "tree")
        if inner is not None:
            rows = rows.unionByName(band.where(F.col("size") > SPAN).join(inner, ["tree", "node"]))
        each = rows.withColumn("own", _paths(F.col("nodes.h"), "size")).select("tree", "path", *held, F.inline(F.arrays_zip("nodes", "own")))
        path = F.concat_ws(",", F.nullif("own", F.lit("")), F.nullif("path", F.lit("")))
        each = each.select("tree", path.alias("path"), *held, "nodes.*")
        inner = each.select("tree", "path", *held, F.col("pos").alias("node"))
    return each


def proof_digest(path: Column | str) -> Column:
    """The hash of all siblings of a path in a row."""
    return F.sha2(F.translate(path, ",.", ""), 256)


def folded(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and a path give."""
    levels = F.filter(F.split(path, ","), lambda s: s != "")
    return F.aggregate(levels, F.col(leaf) if isinstance(leaf, str) else leaf, lambda h, s: F.sha2(F.concat(F.substring_index(s, ".", 1), h, F.substring_index(s, ".", -1)), 256))


def manifest(rows: DataFrame, source: str, doc_id: str, leaf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows: doc_id, leaf, the columns to keep, subroot and root of the row's source and of the dataset, and path, its proof from leaf to root.

    rows are read once; their leaves are written before they are ordered.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))  # null before all, bytewise otherwise
    leaves = rows.select(named.alias("tree"), F.col(doc_id).alias("doc_id"), F.col(leaf).alias("h"), *keep)
    bands = stored(placed(written(leaves, "digests"), ["doc_id", "h"]))
    subroots = roots(bands)
    tops = stored(placed(written(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("h")), "subroots"), ["source"]))
    top = roots(tops).select("tree", F.lit("").alias("path"), "root")
    outer = proofs(tops, top).select(F.col("source").alias("tree"), "path", F.col("h").alias("subroot"), "root")
    found = proofs(bands, written(outer, "sources"))
    return found.select("doc_id", F.col("h").alias("leaf"), *keep, "subroot", "root", "path")
