"""MinHash near-dedup with HyperMinHash sketches.

A document's set is its distinct shingles of WIDTH words (A-Z lower-cased; a text of fewer
words is one shingle, one without words has none and links with nothing). Two documents are
linked if 100 * intersection >= percent * union; a component is what links reach.

Equal sets are one class, represented by its smallest id. A sketch has BUCKETS buckets;
each keeps, of the smallest hash that falls into it, the number of leading zeros and four
more bits, one byte in all. Empty buckets borrow from others in an order that depends on the
bucket only. Classes that agree in all buckets of a band meet. With bands of 6 buckets a pair of likeness
0.85 misses all 26 bands with a probability of 5e-6, with bands of 5 one of 0.8 all 31 with 5e-6.
Sets of up to SMALL shingles fill few buckets, which borrow alike, so they have a second sketch
from other hashes, and meet in its bands too.

Pairs from bands of up to CROWD classes pass if sizes allow a link and the likeness estimated
from the sketches, corrected for buckets that agree by chance, isn't over SIGMAS deviations
short; then full sets confirm them. A larger crowd first meets as a star: its members against one
of them, each member once a round, with the leader that its sketch is most like. Links of up to
STARS rounds unite most of a group of near copies at the cost of a text a member. What is left,
once it is at most TILED pairs or the rounds are over, is compared in full, crowd by crowd: members in parts of bounded size, every two parts as one
tile but those of one component, and a tile gives back no more links than it has members. So no
pair of a band is left out unless it is connected already, and none is a row before it has passed.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdframe.llm.common import flat, mix, partitions, removed, shingle_hashes, slices, tidied, whole, word_hashes, written
from herdframe.llm.components import components

WIDTH, PERCENT = 5, 85
BUCKETS, ROWS = 156, 6
#: Sets of up to so many shingles (and those that they may be linked with) have a second sketch.
SMALL = 64
#: Classes of a band whose pairs become rows, deviations of the estimate, classes and shingles in a part of a tile.
CROWD, SIGMAS, PART, PART_SHINGLES = 24, 4.5, 512, 250_000
#: Rounds of stars at most, texts that one task compares with a leader, and pairs of classes that go to tiles without another star.
STARS, POINTS, TILED = 4, 256, 1 << 24
#: Members of crowds up to which their ids go to every task (8 MB), so that other texts needn't move.
BROADCAST = 1 << 20
#: The chance that two unlike buckets agree: as many leading zeros, and the same four bits.
CHANCE = 1 / 3 / 16
_ORDERS = np.argsort(mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64)).reshape(BUCKETS, BUCKETS), axis=1)
_A, _B, _C = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def registers(sets: list[np.ndarray], salt: np.uint64 = _A) -> np.ndarray:
    """A row of BUCKETS bytes for each set."""
    n = np.array(list(map(len, sets)), np.int64)
    out = np.zeros((len(sets), BUCKETS), np.uint8)
    if not n.sum():
        return out
    h = mix(np.concatenate(sets) ^ salt)
    bucket = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(BUCKETS)) >> np.uint64(32)
    cell = np.repeat(np.arange(len(sets), dtype=np.uint64) * np.uint64(BUCKETS), n) + bucket
    least = np.sort((cell << np.uint64(32)) | (h >> np.uint64(32)))
    cell = (least >> np.uint64(32)).astype(np.int64)
    first = np.append(True, cell[1:] != cell[:-1])
    value = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5
    mantissa, exponent = np.frexp(value)  # value = mantissa * 2 ** exponent, 0.5 <= mantissa < 1
    zeros = np.minimum(32 - exponent, 14)
    out.reshape(-1)[cell[first]] = ((zeros + 1) << 4) | ((mantissa - 0.5) * 32).astype(np.int64)
    for k in np.flatnonzero((out == 0).any(1) & (n > 0)).tolist():
        row = out[k]
        gaps = np.flatnonzero(row == 0)
        order = _ORDERS[gaps]
        row[gaps] = row[order[np.arange(len(gaps)), np.argmax(row[order] > 0, axis=1)]]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of rows of registers, corrected for buckets that agree by chance."""
    return np.clip(((a == b).mean(1) - CHANCE) / (1 - CHANCE), 0, 1)


def sketched(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text) to (doc_id, n, c1, c2, registers, more): the set's size, its hash of 128 bits, its sketch, and the second one of small sets."""
    small = SMALL * 100 // percent

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for at, part in slices(batch.column(1)):
                sets = shingle_hashes(*word_hashes(*flat(part)), WIDTH)
                c1 = np.array([mix(s ^ _A).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                c2 = np.array([mix(s ^ _B).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                n = list(map(len, sets))
                few = [k for k, size in enumerate(n) if 0 < size <= small]
                more = dict(zip(few, registers([sets[k] for k in few], _C), strict=True)) if few else {}
                cells = [[r.tobytes() for r in registers(sets)], [more[k].tobytes() if k in more else None for k in range(len(n))]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(c1), pa.array(c2), *(pa.array(c, pa.binary()) for c in cells)], names=["doc_id", "n", "c1", "c2", "registers", "more"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n long, c1 long, c2 long, registers binary, more binary")


def banded(classes: DataFrame, width: int) -> DataFrame:
    """(key, rep, n): a row for each band of each sketch of a class."""

    def bands(sketch: str) -> list:
        return [F.substring(sketch, 1 + width * b, width) for b in range(BUCKETS // width)]

    both = F.concat(F.array(*bands("registers")), F.when(F.col("more").isNotNull(), F.array(*bands("more"))).otherwise(F.array().cast("array<binary>")))
    return classes.select("rep", "n", F.posexplode(both).alias("band", "bytes")).select(F.xxhash64("band", "bytes").alias("key"), "rep", "n")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, like) of the pairs (a, b) whose sizes and sketches don't rule a link out."""

    @F.arrow_udf("double")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(likeness(*(np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in (a, b))))

    share = 0.01 * percent
    one = classes.select(F.col("rep").alias("a"), F.col("registers").alias("ra"), F.col("n").alias("na"))
    two = classes.select(F.col("rep").alias("b"), F.col("registers").alias("rb"), F.col("n").alias("nb"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    spread = F.sqrt(share * (1 - share) / F.least("na", "nb", F.lit(BUCKETS)))
    return both.select("a", "b", "na", "nb", near("ra", "rb").alias("like")).where(F.col("like") >= share - SIGMAS * spread - 1 / BUCKETS)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that full sets link; texts has (doc_id, text) of every class.

    The text of the smaller set goes to the larger one's place, where a task reads the larger
    text and then those to compare it with, a few at a time. A text that many are compared
    with has a place for every POINTS of them or so.
    """
    n = partitions(pairs)
    larger = F.col("na") >= F.col("nb")
    pairs = pairs.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("at"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("doc_id"))
    places = pairs.groupBy("at").agg(F.ceil(F.count("*") / POINTS).alias("places"))
    pairs = pairs.join(places, "at").select("at", F.pmod(F.xxhash64("doc_id"), F.col("places")).alias("place"), "doc_id")
    pairs = pairs.union(pairs.select("at", "place", F.col("at").alias("doc_id")).distinct())
    rows = pairs.join(texts.hint("merge"), "doc_id").select("at", "place", (F.col("at") != F.col("doc_id")).alias("other"), "doc_id", "text")
    rows = rows.repartition(n, "at", "place").sortWithinPartitions("at", "place", "other")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []  # an id that occurs with several texts has several sets
        for batch in tidied(batches):
            for start, part in slices(batch.column(4)):
                found = []
                at, place, ids = (batch.column(c).slice(start, len(part)).to_pylist() for c in (0, 1, 3))
                for key, doc, s in zip(zip(at, place, strict=True), ids, shingle_hashes(*word_hashes(*flat(part)), WIDTH), strict=True):
                    if key[0] == doc:
                        own = [*own, s.copy()] if key == now else [s.copy()]
                        now = key
                        continue
                    both = [len(np.intersect1d(o, s, assume_unique=True)) for o in own]
                    if any(100 * n >= percent * (len(o) + len(s) - n) for n, o in zip(both, own, strict=True)):
                        found.append((key[0], doc))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def tile_links(ids: np.ndarray, right: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links within one part, or between the left and the right one if both occur, that connect what links connect."""
    both = right.any() and not right.all()
    sides = [~right, right] if both else [np.ones(len(ids), bool)] * 2
    n = np.array(list(map(len, sets)))
    live = n > 0
    for _ in range(4):  # drop what too few shared shingles can't link
        rows = np.flatnonzero(live)
        if len(rows) < 2:
            return []
        owner = np.repeat(rows, n[rows])
        column, size = np.unique(np.concatenate([sets[k] for k in rows.tolist()]), return_inverse=True)
        shared = np.bincount(size, minlength=len(column)) > 1
        if both:
            shared &= (np.bincount(size, sides[0][owner], len(column)) > 0) & (np.bincount(size, sides[1][owner], len(column)) > 0)
        use = shared[size]
        kept = np.bincount(owner[use], minlength=len(ids))
        still = live & (100 * kept >= percent * n)
        if still.sum() == live.sum():
            break
        live = still
    owner, column = owner[use & live[owner]], (np.cumsum(shared) - 1)[size[use & live[owner]]]
    left, rite = np.flatnonzero(live & sides[0]), np.flatnonzero(live & sides[1])
    if not len(left) or not len(rite):
        return []
    place = np.zeros((2, len(ids)), np.int64)
    place[0, left], place[1, rite] = np.arange(len(left)), np.arange(len(rite))
    both_n = np.zeros((len(left), len(rite)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(rite), 4096), np.float32)
        o, c = owner[a:b], column[a:b] - first
        on = sides[0][o]
        x[place[0, o[on]], c[on]] = 1
        on = sides[1][o]
        y[place[1, o[on]], c[on]] = 1
        both_n += x @ y.T
    union = n[left][:, None] + n[rite][None, :] - both_n
    linked = 100 * both_n >= percent * union
    # a forest of the links: breadth first over the rows of the matrix
    out, seen = [], np.zeros(len(ids), bool)
    row_of = {int(k): i for i, k in enumerate(left)}
    col_of = {int(k): i for i, k in enumerate(rite)}
    for root in np.flatnonzero(live).tolist():
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            k = todo.pop()
            near = []
            if k in row_of:
                near.append(rite[linked[row_of[k]]])
            if k in col_of:
                near.append(left[linked[:, col_of[k]]])
            for other in np.concatenate(near).tolist():
                if not seen[other]:
                    seen[other] = True
                    todo.append(other)
                    out.append((int(ids[k]), int(ids[other])))
    return out


def star_pairs(members: DataFrame, compared: Callable[[DataFrame], DataFrame], turn: int) -> DataFrame:
    """(a, b, na, nb): every member (key, rep, component) of a crowd with that leader of its crowds, in another component, which its sketch is most like."""
    leaders = written(members.groupBy("key").agg(F.min_by(F.struct("rep", "component"), F.xxhash64("rep", F.lit(turn))).alias("leader")), "leaders")
    spokes = members.join(leaders, "key").where(F.col("component") != F.col("leader.component"))
    like = compared(spokes.select(F.col("leader.rep").alias("a"), F.col("rep").alias("b")).distinct())
    best = like.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("like", "a")).alias("x"))
    return best.select("x.a", "b", "x.na", "x.nb")


def divided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, rep, component, ...) of the crowds that lie in several components; a class without a label is its own."""
    members = members.drop("component").join(labels, F.col("rep") == F.col("node"), "left")
    members = members.withColumn("component", F.coalesce("component", "rep")).drop("node")
    several = members.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one < other").select("key")
    return members.join(written(several, "several"), "key", "left_semi")


def unlike_pairs(members: DataFrame) -> int:
    """The number of pairs of members (key, component) of a crowd in different components."""
    each = members.groupBy("key", "component").agg(F.count("*").cast("double").alias("m"))
    sums = each.groupBy("key").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
    return int(sums.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()[0] or 0)


def crowd_links(members: DataFrame, held: DataFrame, link: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Links among the members (key, rep, n, component) of each crowd that connect what links between different components connect.

    A component with PART members in a crowd has parts of its own, which aren't compared with each other. held
    has what of each member (doc_id) a tile compares; link(tile) gives (a, b) of a tile's rows (doc_id, right, and the
    further columns of members and held): within one part, or between the left and the right one if both occur.
    """
    # small tables by key are written, so that a join with a crowd of any size can be split
    sizes = written(members.groupBy("key", "component").agg(F.count("*").alias("many")), "sizes")
    cell = F.when(F.col("many") >= PART, F.col("component").cast("string")).otherwise("")
    more = [c for c in members.columns if c not in ("key", "rep", "n", "component")]
    placed = members.join(sizes, ["key", "component"]).select("key", "rep", "n", cell.alias("cell"), *more)
    parts = written(placed.groupBy("key", "cell").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts")), "parts")
    placed = placed.join(parts, ["key", "cell"]).select("key", "rep", *more, F.struct("cell", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("k")).alias("part"))
    listed = parts.select("key", F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select("key", F.struct(F.col("c").alias("cell"), "k").alias("part"))
    tiles = listed.withColumnRenamed("part", "i").join(listed.withColumnRenamed("part", "j"), "key").where((F.col("i") <= F.col("j")) & ((F.col("i.cell") != F.col("j.cell")) | (F.col("i.cell") == "")))
    sides = tiles.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    dealt = placed.join(sides, ["key", "part"]).select("key", "i", "j", F.col("rep").alias("doc_id"), (F.col("part") > F.col("i")).alias("right"), *more).join(held, "doc_id")
    return dealt.groupBy("key", "i", "j").applyInArrow(link, "a long, b long")


def texts_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts (doc_id, text) of members (rep, ...); if those are few, no other text moves."""
    reps = members.select(F.col("rep").alias("doc_id")).distinct()
    return texts.join(F.broadcast(reps) if members.count() <= BROADCAST else reps, "doc_id", "left_semi")


def set_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """crowd_links() by full sets of the members' texts (doc_id, text)."""
    shingled = written(_shingled(texts_of(members, texts)), "shingles")

    def link(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("shingles").chunks for x in c]
        found = tile_links(table.column("doc_id").to_numpy(), table.column("right").to_numpy(), sets, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return crowd_links(members, shingled, link)


def _shingled(texts: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, shingles): the set's hashes as bytes, eight each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for at, part in slices(batch.column(1)):
                sets = shingle_hashes(*word_hashes(*flat(part)), WIDTH)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(make, "doc_id long, shingles binary")


def linked(classes: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, component) of the classes (rep, n, registers, more) that have links."""
    bands = banded(classes, width)
    crowds = written(bands.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "keys")
    members = written(bands.join(crowds, "key").select("key", "rep", "n", "many"), "members")
    few = members.where(F.col("many") <= CROWD)
    other = few.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"))
    sizes = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent
    pairs = few.select("key", F.col("rep").alias("a"), "n").join(other, "key").where((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct()
    near = estimated(pairs, classes, percent).drop("like")
    return united(near, members, lambda m, turn: star_pairs(m, lambda p: estimated(p, classes, percent), turn), lambda p: confirmed(p, texts, percent), lambda m: set_links(m, texts, percent), CROWD)


def united(near: DataFrame, members: DataFrame, stars: Callable[[DataFrame, int], DataFrame], confirm: Callable[[DataFrame], DataFrame], tiles: Callable[[DataFrame], DataFrame], crowd: int = CROWD) -> DataFrame:
    """(node, component) of what links unite: pairs (a, b, na, nb) that are to be confirmed, and those within crowds, keys of the members (key, rep, n, many) with more than `crowd` of them.

    stars(members, round) gives pairs of members with a leader of their crowds in another component, confirm(pairs) those
    that are linked, and tiles(members) connects what is linked between components of what is left of the crowds. Further columns of members stay with them.
    """
    left = members.where(F.col("many") > crowd).drop("many").withColumn("component", F.col("rep"))
    crowded = not left.isEmpty()
    if crowded:
        near = near.unionByName(stars(left, 0)).distinct()
    near = written(near, "pairs")
    links = written(confirm(near), "links")
    labels = components(links)
    removed(near, links)
    for turn in range(1, STARS + 1):
        if not crowded:
            break
        left = written(divided(left, labels), "crowds")
        if left.isEmpty():
            break
        last = turn == STARS or unlike_pairs(left) <= TILED
        found = tiles(left) if last else confirm(written(stars(left, turn), "pairs"))
        held = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        links = written(held.unionByName(found), "links")
        labels = components(links)
        removed(links)
        if last:
            break
    return labels


def labelled(sets: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Rows: doc_id, n_shingles, component_id for every row of sets (doc_id, n, c1, c2); a null id has no component."""
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.coalesce("component", "rep").alias("component"))
    known = F.col("doc_id").isNotNull()
    joined = sets.select("doc_id", "n", "c1", "c2").join(named, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & known & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = ROWS) -> DataFrame:
    """Rows: doc_id, n_shingles, component_id, kept, for every document; `width` is the number of buckets in a band.

    A row counts by its own text: rows of one id and different texts may have different
    components, and links of one reach the other through the id. A null id can't name a
    component: such rows link with nothing, have a null component and are kept.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    sets = written(sketched(rows, percent), "sketches")
    named = sets.where("doc_id is not null and n > 0")
    classes = written(named.groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"), F.first("more").alias("more")), "classes")
    found = linked(classes, rows, percent, width)
    rows = labelled(sets, classes, found)
    return rows.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
