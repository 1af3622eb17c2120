"""Hard negatives for contrastive training: unlike-labelled rows that score nearly as high as a positive.

Scores are inner products of whole numbers (components times SCALE, rounded down), so they are
exact and ties are real ties; those go to the smaller id. Anchors' positives are the best rows of
their own label; the negatives of a positive are the best rows of other labels with a
score between LOW and 100 per cent of the positive's.

Anchors meet candidates in tiles, a block of anchors and a block of candidates each. A tile's
scores are one product of int64 matrices by Strassen's recursion: seven products of half the
size instead of eight, sides padded by zeros, additions of integers. Small products go through floats
where a bound proves them exact. Integers that wrap around on the way are right again at the end, as long
as the scores fit 64 bits; otherwise the job stops with an error.

Two passes, as a window is only known with its positive: the first within labels, the second
over all rows of other labels. In each a task meets a block's anchors first and then streams
candidates past them, holding for each anchor (or window) a heap of the best so far; heaps of
different tasks are merged by rank. So rows move once for each block of ANCHORS anchors, anchors once for
each block of candidates, and nothing grows with a label's rows: a hot label is cut into more blocks.
Only counts, labels' among them, are joined by label.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herdframe.llm.common import partitions, tidied, written

#: Components are multiplied by it and rounded down.
SCALE = 256
#: Positives of an anchor, negatives of a positive, and the least share of its score in per cent.
POSITIVES, NEGATIVES, LOW = 5, 5, 80
#: Anchors of a block, candidates of a block at least, scores that a task holds at once.
ANCHORS, CANDIDATES, CELLS = 4096, 65_536, 1 << 22
#: Sides up to which matrices are multiplied at once.
LEAF = 64
NONE = np.iinfo(np.int64).min


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, modulo 2 ** 64: through floats where no sum can leave their whole numbers."""
    most = max(map(abs, (int(a.min(initial=0)), int(a.max(initial=0))))) * max(map(abs, (int(b.min(initial=0)), int(b.max(initial=0)))))
    if most * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by Strassen's recursion, modulo 2 ** 64."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return product(a, b)
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """All inner products of the rows of two matrices; rows of unlike lengths are padded by zeros."""
    k = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, k - x.shape[1]))) for x in (a, b))
    biggest = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, b)]
    if biggest[0] * biggest[1] * k >= 1 << 63:
        raise ValueError("scores don't fit 64 bits")
    return strassen(a, b.T, leaf)


def best(score: np.ndarray, ids: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, most) scores and ids of the allowed cells with the highest scores, ties by smaller id; NONE where there are fewer.

    ids ascend along the columns or, for a matrix, need not; the first of equals in order of ids counts.
    """
    left = np.where(allowed, score, NONE)
    found, named = np.full((len(score), most), NONE), np.zeros((len(score), most), np.int64)
    rows = np.arange(len(score))
    for k in range(min(most, score.shape[1])):
        at = left.argmax(1)
        found[:, k] = left[rows, at]
        named[:, k] = ids[at] if ids.ndim == 1 else ids[rows, at]
        left[rows, at] = NONE
    return found, named


class Heaps:
    """The best `most` (score, id) of each row so far."""

    def __init__(self, rows: int, most: int):
        self.score, self.id, self.most = np.full((rows, most), NONE), np.zeros((rows, most), np.int64), most

    def merge(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score], 1), np.concatenate([self.id, ids], 1)
        order = np.argsort(ids, axis=1, kind="stable")
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        self.score, self.id = best(score, ids, np.ones(score.shape, bool), self.most)

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, scores and ids of all that is held."""
        row, k = np.nonzero(self.score > NONE)
        return row, self.score[row, k], self.id[row, k]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Whole numbers, a row a vector, padded by zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * SCALE)
    if np.abs(whole).max(initial=0) >= 2.0**62:
        raise ValueError("components don't fit 64 bits")
    many = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(many.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < many[:, None]] = whole.astype(np.int64)
    return out


class Block:
    """The anchors of a block: keys, ids, labels, numbers, and the scores of their positives where those are known."""

    def __init__(self, batch: pa.RecordBatch):
        self.key, self.id, self.label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "vec_id", "label"))
        self.numbers = _matrix(batch.column("v"))
        limits = batch.column("limits").to_pylist()
        self.limit = np.full((len(limits), POSITIVES), NONE)
        for k, x in enumerate(limits):
            if x:
                self.limit[k, : len(x)] = x
        self.known = any(limits)
        self.heaps = [Heaps(len(self.id), NEGATIVES) for _ in range(POSITIVES)] if self.known else [Heaps(len(self.id), POSITIVES)]

    def meet(self, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> None:
        """Candidates pass by: the positives are looked for, or the negatives of each known positive."""
        order = np.argsort(ids, kind="stable")
        ids, labels, numbers = ids[order], labels[order], numbers[order]
        step = max(1, CELLS // max(1, len(self.id)))
        for k in range(0, len(ids), step):
            some = slice(k, k + step)
            score = scores(self.numbers, numbers[some])
            same = self.label[:, None] == labels[None, some]
            if not self.known:
                self.heaps[0].merge(*best(score, ids[some], same & (self.id[:, None] != ids[None, some]), POSITIVES))
                continue
            for p, heap in enumerate(self.heaps):
                top = self.limit[:, p, None]
                # in whole numbers of Python's size where products by 100 could wrap
                low = np.array([-(-LOW * x // 100) if x > NONE else 0 for x in self.limit[:, p].tolist()])[:, None]
                heap.merge(*best(score, ids[some], ~same & (top > NONE) & (score <= top) & (score >= low), NEGATIVES))

    def found(self) -> pa.RecordBatch | None:
        out = [(np.full(len(row), p), row, score, ids) for p, h in enumerate(self.heaps) for row, score, ids in [h.cells()]]
        p, row, score, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.key[row], p, ids, score)], names=["key", "p", "vec_id", "score"])


def tiles(anchors: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """(key, p, vec_id, score): what each block of anchors holds after its candidates went by; both have the keys `by` of their tile.

    anchors: (by, key, vec_id, label, v, limits); candidates: (by, vec_id, label, v).
    """
    empty = candidates.select(*by, F.lit(1).alias("side"), F.lit(0).cast("long").alias("key"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("limits"))
    both = anchors.select(*by, F.lit(0).alias("side"), "key", "vec_id", "label", "v", "limits").unionByName(empty)
    dealt = both.repartition(partitions(both), *by).sortWithinPartitions(*by, "side")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in tidied(batches):
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
            side = batch.column("side").to_numpy()
            new = side[1:] != side[:-1]
            for k in keys:
                new |= k[1:] != k[:-1]
            cuts = np.flatnonzero(np.concatenate([[True], new, [True]])).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                part, tile = batch.slice(a, b - a), tuple(int(k[a]) for k in keys)
                if tile != now:
                    if block:
                        yield block.found()
                    now, held, block = tile, [], None
                if side[a] == 0:
                    held.append(part)
                    continue
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()
                    block, held = Block(whole[0]), []
                if block:
                    block.meet(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v")))
        if block:
            yield block.found()

    return dealt.mapInArrow(stream, "key long, p long, vec_id long, score long")


def merged(found: DataFrame, most: int) -> DataFrame:
    """The first `most` of each (key, p) by rank from 1 on: heaps of all tiles as one."""
    rank = F.row_number().over(W.partitionBy("key", "p").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def _number(c: Column | str, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n) if isinstance(n, int) else n)


def hard_negatives(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: Column | str = "label", vector: str = "embedding") -> DataFrame:
    """Rows: anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Rows of
    one id are rows of their own but never each other's partners; a repeated anchor gives its rows
    as often. Shorter vectors are padded by zeros. Positives without a negative give no row.
    """
    numbers = F.col(vector)
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), numbers.alias("v"), is_anchor.alias("anchor"))
    used = used.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    anchors = written(used.where("anchor").select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "v"), "anchors")
    used = used.drop("anchor")

    # within labels: blocks of a label's anchors, and as many of its rows as its size asks for
    sizes = used.groupBy("label").agg(F.count("*").alias("many")).join(anchors.groupBy("label").agg(F.count("*").alias("asked")), "label")
    sizes = written(sizes.select("label", F.ceil(F.col("asked") / ANCHORS).alias("blocks"), F.ceil(F.col("many") / CANDIDATES).alias("parts")), "labels")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    first = anchors.join(sizes, "label").withColumn("block", _number("key", F.col("blocks"))).withColumn("part", every(F.col("parts"))).withColumn("limits", F.lit(None).cast("array<long>"))
    own = used.join(sizes, "label").withColumn("part", _number("vec_id", F.col("parts"))).withColumn("block", every(F.col("blocks")))
    by_label = F.col("label").alias("group")
    positives = merged(tiles(first.select(by_label, "block", "part", *anchors.columns, "limits"), own.select(by_label, "block", "part", *used.columns), ["group", "block", "part"]), POSITIVES)
    positives = positives.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("positives"))
    # `first` is a plain list of anchors from here on: their positives' scores are known
    known = written(anchors.join(positives, "key"), "positives")

    n = partitions(used)
    blocks = max(1, -(-known.count() // ANCHORS))
    parts = max(1, -(-n // blocks), -(-used.count() // (64 * CANDIDATES)))
    spread = known.withColumn("limits", F.col("positives.positive_score")).withColumn("block", _number("key", blocks)).withColumn("part", every(F.lit(parts)))
    others = used.withColumn("part", _number("vec_id", parts)).withColumn("block", every(F.lit(blocks)))
    found = merged(tiles(spread.select("block", "part", *anchors.columns, "limits"), others.select("block", "part", *used.columns), ["block", "part"]), NEGATIVES)
    found = found.select("key", "p", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = found.join(known.select("key", F.col("vec_id").alias("anchor_id"), "positives"), "key").withColumn("at", F.get("positives", F.col("p").cast("int")))
    return both.select("anchor_id", "at.positive_id", "rank", "negative_id", "at.positive_score", "negative_score")
