"""An exact similarity join on n-grams by a token-group matrix.

A document's set is its distinct shingles of WIDTH words (A-Z lower-cased; a text of fewer words is
one shingle, one without words has none and links with nothing), known by 64-bit hashes. Two documents
link if 100 * intersection >= percent * union; equal sets are one class, named by its smallest id.

Groups: classes with the same smallest hash and about the same size (to a power of two) are
likely alike and form groups of at most about GROUP members. The matrix has a row a
group: the union of its members' shingles as a bitmap, four to eight bits for each shingle of a
member, its columns being the low bits of hashes; wider rows are folded to compare them with narrower ones.

Which rows are looked at: all shingles have one order, rare ones first (those that many
documents hold, counted over all of them, come last), then by hash. Linked sets share one of their first
n - ceil(percent * n / 100) + 1 shingles, and under the first of all that they share neither has come too far in its own order
for what is left of it to be enough. So a query meets the groups of members that share one of
those with it, at such places. Bound: a query's bits that a group's row lacks are as many shingles at least that no
member shares, so if those leave too few for a link, the group stays closed. Opened groups give
pairs of classes, which must pass the same bound on their own bitmaps. Nothing is estimated: no
link is lost, but for equal 64-bit hashes.

What passes connects classes to clusters, and full sets are compared within clusters only, each
set going to its cluster's place once. A shingle among the first of more than CROWD classes
(a shared passage, or many copies) makes a crowd: its members meet as a star first, each against one leader of its
crowds, and only crowds of several clusters go on to tiles, where each
tile has a matrix of its own over two parts of the crowd. Clusters beyond PART classes are linked the way of
herdframe.llm.near_dedup: stars on full sets, then parts against parts. Frequent shingles only decide
the order and costs, never the result; their list has at most HOT_MOST entries.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdframe.llm.common import flat, mix, shingle_hashes, slices, tidied, whole, word_hashes, written
from herdframe.llm.components import components
from herdframe.llm.near_dedup import _A, _B, PART, WIDTH, confirmed, crowd_links, labelled, set_links, star_pairs, texts_of, united

PERCENT = 80
#: Members of a group, about, and classes under a shingle that meet in pairs.
GROUP, CROWD = 64, 8
#: A shingle is frequent if one in so many of a task's documents holds it, and HOT_LEAST of them; so many are told apart.
HOT_SHARE, HOT_LEAST, HOT_MOST = 256, 8, 1 << 17
#: Shingles that a task counts at once.
HELD = 1 << 20


def frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of the shingles that many documents (text) hold, ascending: the HOT_MOST most frequent of those that are so in some task's run of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def hot() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            n = np.diff(np.append(at, len(h)))
            use = n >= max(HOT_LEAST, len(held) // HOT_SHARE)
            return pa.RecordBatch.from_arrays([pa.array(h[at[use]].view(np.int64)), pa.array(n[use])], names=["h", "n"])

        for batch in tidied(batches):
            for _, part in slices(batch.column(0)):
                for s in shingle_hashes(*word_hashes(*flat(part)), WIDTH):
                    held.append(s)
                    many += len(s)
                if many >= HELD:
                    yield hot()
                    held, many = [], 0
        if many:
            yield hot()

    rows = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = rows.orderBy(F.desc("n"), "h").limit(HOT_MOST).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64))


def prefix(s: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first shingles of a sorted set in the common order, one of which any linked set shares, and how many of them aren't frequent."""
    p = len(s) + (-percent * len(s)) // 100 + 1 if len(s) else 0
    known = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
    cold = s[~known]
    return np.concatenate([cold, s[known]])[:p], min(p, len(cold))


def width_of(n: int) -> int:
    """Bits of a row of the matrix for sets of n shingles."""
    return max(64, 4 << (n.bit_length() - 1)) if n else 64


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(width_of(len(s)), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def missing(query: bytes, row: bytes) -> int:
    """Bits of the query that the row lacks: as many of its shingles, at least, aren't in the row's sets."""
    a, b = int.from_bytes(query, "little"), int.from_bytes(row, "little")
    p, q = 8 * len(query), 8 * len(row)
    while p > q:
        p //= 2
        a = (a >> p) | (a & ((1 << p) - 1))
    while q > p:
        q //= 2
        b = (b >> q) | (b & ((1 << q) - 1))
    return (a & ~b).bit_count()


@F.arrow_udf(T.LongType())
def _missing(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for query, row in batches:
        yield pa.array([missing(a, b) for a, b in zip(query.to_pylist(), row.to_pylist(), strict=True)], pa.int64())


@F.arrow_udf(T.BinaryType())
def _union(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Rows of one group are of one width."""
    for rows in batches:
        out = []
        for maps in rows.to_pylist():
            total = 0
            for m in maps:
                total |= int.from_bytes(m, "little")
            out.append(total.to_bytes(len(maps[0]), "little"))
        yield pa.array(out, pa.binary())


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n, c1, c2): the set's size and its hash of 128 bits."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for at, part in slices(batch.column(1)):
                sets = shingle_hashes(*word_hashes(*flat(part)), WIDTH)
                c1, c2 = (np.array([mix(s ^ x).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for x in (_A, _B))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(list(map(len, sets)), pa.int64()), pa.array(c1), pa.array(c2)], names=["doc_id", "n", "c1", "c2"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n long, c1 long, c2 long")


def described(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text) to (doc_id, n, c1, c2, least, first, cold, bits): also the smallest hash, the first shingles in the common order, and the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in tidied(batches):
            for at, part in slices(batch.column(1)):
                sets = shingle_hashes(*word_hashes(*flat(part)), WIDTH)
                c1, c2 = (np.array([mix(s ^ x).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for x in (_A, _B))
                firsts = [prefix(s, hot, percent) for s in sets]
                least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                ends = np.append(0, np.cumsum([len(f) for f, _ in firsts]))
                held = np.concatenate([f for f, _ in firsts]).view(np.int64) if firsts else np.zeros(0, np.int64)
                cells = [pa.array(list(map(len, sets)), pa.int64()), pa.array(c1), pa.array(c2), pa.array(least)]
                cells += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held)), pa.array([c for _, c in firsts], pa.int32()), pa.array([bitmap(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *cells], names=["doc_id", "n", "c1", "c2", "least", "first", "cold", "bits"])

    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, n long, c1 long, c2 long, least long, first array<long>, cold int, bits binary")


def grouped(classes: DataFrame) -> DataFrame:
    """(rep, n, grp): the group of each class."""
    size = F.length(F.bin("n"))
    rows = classes.select("rep", "n", "least", size.alias("size"))
    # small tables by key are written, so that a join with a crowd of any size can be split
    parts = written(rows.groupBy("least", "size").agg(F.ceil(F.count("*") / GROUP).alias("parts")).where("parts > 1"), "parts")
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))
    return rows.join(parts, ["least", "size"], "left").select("rep", "n", F.xxhash64("least", "size", part).alias("grp"))


def members_of(classes: DataFrame) -> DataFrame:
    """(key, rep, n, at, many): classes under each of their first shingles that others have, too, with its place in the class's order.

    Few hold a shingle that isn't frequent, so those are counted where they meet; frequent ones,
    which few texts have among their first, are counted with partial sums.
    """
    cold = classes.select("rep", F.col("n").cast("int").alias("n"), F.posexplode(F.slice("first", F.lit(1), F.col("cold"))).alias("at", "key"))
    cold = cold.withColumn("many", F.count("*").over(W.partitionBy("key"))).where("many > 1")
    rest = F.slice("first", F.col("cold") + 1, F.size("first") - F.col("cold"))
    hot = classes.where(F.size("first") > F.col("cold")).select("rep", F.col("n").cast("int").alias("n"), "cold", F.posexplode(rest).alias("at", "key"))
    counts = written(hot.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "keys")
    hot = hot.join(counts, "key").withColumn("at", F.col("at") + F.col("cold"))
    columns = ["key", "rep", F.col("n").cast("long").alias("n"), "at", "many"]
    return cold.select(*columns).union(hot.select(*columns))


def _enough(n: str, lost: str, other: str, percent: int):  # noqa: ANN202
    """Whether a set of n shingles that lacks `lost` of them elsewhere may be linked with one of `other` shingles there."""
    return (F.col(n) - F.col(lost)) * (100 + percent) >= percent * (F.col(n) + F.col(other))


def hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): every member (key, rep, component) of a crowd with one leader of its crowds in another component, the same one for as many as can be."""
    leaders = written(members.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("hub"), F.col("component").alias("of"))).alias("x")), "leaders")
    spokes = members.join(leaders, "key").where(F.col("component") != F.col("x.of"))
    return spokes.groupBy(F.col("rep").alias("b")).agg(F.min("x").alias("x")).select(F.col("x.hub").alias("a"), "b")


def bounded_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, like) of the pairs (a, b) whose sizes and bitmaps don't rule a link out."""
    one = classes.select(F.col("rep").alias("a"), F.col("bits").alias("ra"), F.col("n").alias("na"))
    two = classes.select(F.col("rep").alias("b"), F.col("bits").alias("rb"), F.col("n").alias("nb"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    both = both.select("a", "b", "na", "nb", _missing("ra", "rb").alias("la"), _missing("rb", "ra").alias("lb"))
    both = both.where(_enough("na", "la", "nb", percent) & _enough("nb", "lb", "na", percent))
    return both.select("a", "b", "na", "nb", (1 - (F.col("la") + F.col("lb")) / (F.col("na") + F.col("nb"))).alias("like"))


def opened(members: DataFrame, classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes and the members of the groups that open to them; members are (key, rep, n, at)."""
    placed = members.join(groups.select("rep", "grp"), "rep")
    to = placed.select("key", F.col("grp").alias("to"), F.col("rep").alias("other"), F.col("n").alias("m"), F.col("at").alias("there"))
    # where a shingle is the first that two sets share, what comes after it must be enough for a link
    fits = _enough("n", "at", "m", percent) & _enough("m", "there", "n", percent)
    asked = written(placed.join(to, "key").where((F.col("rep") != F.col("other")) & fits).select("rep", "to").distinct(), "asked")
    held = written(groups.join(asked.select(F.col("to").alias("grp")).distinct(), "grp", "left_semi"), "groups")
    each = held.select("rep", "grp").join(classes.select("rep", "n", "bits"), "rep").groupBy("grp").agg(F.collect_list("bits").alias("maps"), F.min("n").alias("m"))
    matrix = each.select(F.col("grp").alias("to"), _union("maps").alias("row"), "m")
    bound = asked.join(classes.select("rep", "n", "bits"), "rep").join(matrix, "to").select("rep", "n", "to", "m", _missing("bits", "row").alias("lost"))
    into = held.select(F.col("grp").alias("to"), F.col("rep").alias("other"))
    met = bound.where(_enough("n", "lost", "m", percent)).join(into, "to").where(F.col("rep") != F.col("other"))
    return met.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


class Matrix:
    """The members of a tile with bitmaps of one width or folded to it, and the rows of their groups."""

    def __init__(self, at: np.ndarray, n: np.ndarray, place: np.ndarray, grp: np.ndarray, maps: np.ndarray):
        order = np.argsort(grp, kind="stable")
        self.at, self.n, self.place, self.maps = at[order], n[order], place[order], maps[order]
        first = np.flatnonzero(np.append(True, grp[order][1:] != grp[order][:-1]))
        self.group = np.cumsum(np.isin(np.arange(len(at)), first)) - 1
        self.rows, self.least = np.bitwise_or.reduceat(self.maps, first, axis=0), np.minimum.reduceat(self.n, first)

    def open(self, n: int, place: int, bits: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
        """Which of the tile's members may be linked with a query of n shingles, the tile's own at `place`, of those that are `left`."""
        lost = np.bitwise_count(bits & ~self.rows).sum(1, dtype=np.int64)
        opens = (n - lost) * (100 + percent) >= percent * (n + self.least)
        k = np.flatnonzero(opens[self.group] & left[self.at])
        m = self.n[k]
        k = k[np.minimum(n - place, m - self.place[k]) * (100 + percent) >= percent * (n + m)]
        m, maps = self.n[k], self.maps[k]
        here, there = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (bits & ~maps, maps & ~bits))
        return self.at[k[(np.minimum(n - here, m - there) * (100 + percent) >= percent * (n + m))]]


def possible_links(ids: np.ndarray, n: np.ndarray, place: np.ndarray, grp: np.ndarray, maps: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A forest that connects what pairs that pass the bound connect: breadth first, so no member is looked for twice."""
    width = np.array(list(map(len, maps))) // 8  # in words
    own = [np.frombuffer(m, np.uint64) for m in maps]
    half = [m.reshape(2, -1) if len(m) > 1 else m for m in own]
    half = [m[0] | m[1] if m.ndim == 2 else m for m in half]
    matrices = {}
    for w in np.unique(width).tolist():
        a, b = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        both = np.append(a, b)
        matrices[w] = Matrix(both, n[both], place[both], grp[both], np.stack([*(own[k] for k in a.tolist()), *(half[k] for k in b.tolist())]))
    left, out = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo and left.any():
            k = todo.pop()
            w = int(width[k])
            near = [matrices[w].open(int(n[k]), int(place[k]), own[k], left, percent)]
            if w // 2 in matrices and w > 1:
                near.append(matrices[w // 2].open(int(n[k]), int(place[k]), half[k], left, percent))
            for other in np.unique(np.concatenate(near)).tolist():
                left[other] = False
                todo.append(other)
                out.append((int(ids[k]), int(ids[other])))
    return out


def bound_links(members: DataFrame, classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """crowd_links() by bitmaps: what pairs that pass the bound connect."""
    reps = members.select("rep").distinct()
    held = classes.select("rep", "n", "bits").join(reps, "rep", "left_semi").join(groups.select("rep", "grp"), "rep").withColumnRenamed("rep", "doc_id")

    def link(t: pa.Table) -> pa.Table:
        maps = [x.as_py() for c in t.column("bits").chunks for x in c]
        found = possible_links(*(t.column(c).to_numpy() for c in ("doc_id", "n", "at", "grp")), maps, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return crowd_links(members, written(held, "bitmaps"), link)


def clustered(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component): clusters of classes that may be linked; linked ones lie in one cluster."""
    members = written(members_of(classes), "members")
    groups = written(grouped(classes), "grouped")
    few = members.where(F.col("many") <= CROWD).select("key", "rep", "n", "at")
    near = bounded_pairs(opened(few, classes, groups, percent), classes, percent).drop("like").distinct()
    return united(near, members, lambda m, turn: bounded_pairs(hub_pairs(m, turn), classes, percent).drop("like"), lambda p: p.select("a", "b"), lambda m: bound_links(m, classes, groups, percent), CROWD)


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows: doc_id, n_shingles, component_id for every document.

    A row's set is that of its own text; rows of one id are one document to links, whatever their
    texts. A null id can't name a component: such rows link with nothing and have none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    sets = written(sketched(rows), "sets")
    named = described(rows, percent).where("doc_id is not null and n > 0")
    held = [F.first(c).alias(c) for c in ("least", "first", "cold", "bits")]
    classes = written(named.groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"), *held), "classes")
    clusters = clustered(classes, percent)
    sizes = written(clusters.groupBy("component").agg(F.count("*").alias("many")), "sizes")
    members = classes.select("rep", "n").join(clusters.withColumnRenamed("node", "rep"), "rep").join(sizes, "component")
    members = written(members.select(F.col("component").alias("key"), "rep", "n", "many"), "members")
    small = members.where(F.col("many") <= PART).select("key", "rep", "n", F.col("rep").alias("component"))
    links = set_links(small, rows, percent)
    large = members.where(F.col("many") > PART)
    if not large.isEmpty():
        none = classes.sparkSession.createDataFrame([], "a long, b long, na long, nb long")
        texts = written(texts_of(large, rows), "texts")
        found = united(none, large, lambda m, turn: star_pairs(m, lambda p: bounded_pairs(p, classes, percent), turn), lambda p: confirmed(p, texts, percent), lambda m: set_links(m, texts, percent), PART)
        links = links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    links = written(links.union(same_ids(sets, classes)), "links")
    return labelled(sets, classes, components(links))


def same_ids(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes in which one id occurs."""
    own = sets.where("doc_id is not null").join(classes.select("c1", "c2", "n", "rep"), ["c1", "c2", "n"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps"))
    return own.where("a < b").select("a", F.explode("reps").alias("b")).where("a <> b")
