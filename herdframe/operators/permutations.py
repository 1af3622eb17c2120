"""Permutations of instances, and scores over them.

A permutation is rows (p, animal, instance): animal a takes instance perm[a]. Both directions
stay explicit, so nothing depends on whether a permutation equals its inverse.
"""

from itertools import permutations as every

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from herdframe.functions.scalars import log_normalized

#: Beyond this many animals the tables of pairs of permutations are too large; herdframe.operators.assignment does without.
MOST = 5


def all_permutations(n: int) -> list[tuple[int, ...]]:
    """In lexicographic order."""
    if not 1 <= n <= MOST:
        raise ValueError(f"between 1 and {MOST} animals")
    return list(every(range(n)))


def permutation_table(spark: SparkSession, n: int) -> DataFrame:
    """n * n! rows, which any join may broadcast."""
    rows = [(p, a, i) for p, perm in enumerate(all_permutations(n)) for a, i in enumerate(perm)]
    return spark.createDataFrame(rows, "p long, animal long, instance long")


def permutation_index(perm: list[int]) -> int:
    return all_permutations(len(perm)).index(tuple(perm))


def permutation_products(spark: SparkSession, n: int) -> DataFrame:
    """(i, j, product): the number of perm_i[perm_j[.]]."""
    perms = all_permutations(n)
    number = {p: k for k, p in enumerate(perms)}
    rows = [(i, j, number[tuple(a[b[k]] for k in range(n))]) for i, a in enumerate(perms) for j, b in enumerate(perms)]
    return spark.createDataFrame(rows, "i long, j long, product long")


def permutation_scores(scores: DataFrame, by: list[str], n: int, value: str = "logp") -> DataFrame:
    """(by, p, score): for rows (by, instance, animal, value) the sum along each permutation, from one aggregation."""
    cell = {(i, a): F.sum(F.when((F.col("instance") == i) & (F.col("animal") == a), F.col(value))) for i in range(n) for a in range(n)}
    wide = scores.groupBy(*by).agg(*[F.coalesce(c, F.lit(0.0)).alias(f"s{i}_{a}") for (i, a), c in cell.items()])
    sums = [F.struct(F.lit(p).cast("long").alias("p"), sum((F.col(f"s{i}_{a}") for a, i in enumerate(perm)), F.lit(0.0)).alias("score")) for p, perm in enumerate(all_permutations(n))]
    return wide.select(*by, F.inline(F.array(*sums)))


def best_permutation(scored: DataFrame, by: list[str]) -> DataFrame:
    """The permutation with the highest score (to nine decimals), the lowest number of equals."""
    return scored.groupBy(*by).agg(F.max_by("p", F.struct(F.round("score", 9), -F.col("p"))).alias("p"), F.max("score").alias("score"))


def clique_affinity(affinities: DataFrame, n: int, value: str = "logp") -> DataFrame:
    """(recording, frame, camera, keypoint, child_p, parent_p, logp, row_norm, col_norm).

    logp sums, over animals, the affinity of the child's instance to the parent's. row_norm is
    normalised over parent_p, col_norm over child_p; the normalisers come from the same row.
    """
    by = ["recording", "frame", "camera", "keypoint"]
    cells = [F.coalesce(F.max(F.when((F.col("instance") == i) & (F.col("parent_instance") == j), F.col(value))), F.lit(0.0)).alias(f"s{i}_{j}") for i in range(n) for j in range(n)]
    wide = affinities.groupBy(*by).agg(*cells)
    perms = all_permutations(n)
    pairs = [
        F.struct(F.lit(c).cast("long").alias("child_p"), F.lit(q).cast("long").alias("parent_p"), sum((F.col(f"s{child[a]}_{parent[a]}") for a in range(n)), F.lit(0.0)).alias("logp"))
        for c, child in enumerate(perms)
        for q, parent in enumerate(perms)
    ]
    long = wide.select(*by, F.inline(F.array(*pairs)))
    row, _ = log_normalized(F.col("logp"), [*by, "child_p"])
    col, _ = log_normalized(F.col("logp"), [*by, "parent_p"])
    return long.withColumn("row_norm", row).withColumn("col_norm", col)


def chosen(detections: DataFrame, choice: DataFrame, by: list[str], n: int) -> DataFrame:
    """Detections by animal under a permutation for each key: rows without a detection stay out."""
    table = F.broadcast(permutation_table(detections.sparkSession, n))
    return detections.join(choice.select(*by, "p"), by).join(table, ["p", "instance"]).drop("p")


def split_by_animal(detections: DataFrame, assignments: DataFrame) -> DataFrame:
    """Detections under assignments (..., animal, instance): one join serves scatter and gather alike."""
    keys = [c for c in assignments.columns if c not in ("animal",)]
    return detections.join(assignments.where("animal is not null"), keys)


def compose(first: DataFrame, second: DataFrame, by: list[str], n: int) -> DataFrame:
    """The product of two permutations for each key; beyond MOST animals from their numbers alone."""
    if n > MOST:
        from herdframe.operators.assignment import ranks, unranked

        @F.arrow_udf("long")
        def product(i: pa.Array, j: pa.Array) -> pa.Array:
            return pa.array(ranks(np.take_along_axis(*(unranked(c.to_numpy(), n) for c in (i, j)), 1)))

        both = first.select(*by, F.col("p").alias("i")).join(second.select(*by, F.col("p").alias("j")), by)
        return both.select(*by, product("i", "j").alias("p"))
    table = F.broadcast(permutation_products(first.sparkSession, n))
    both = first.select(*by, F.col("p").alias("i")).join(second.select(*by, F.col("p").alias("j")), by)
    return both.join(table, ["i", "j"]).select(*by, F.col("product").alias("p"))


def ranked(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "p")))
