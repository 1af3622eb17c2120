"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the K smallest distinct 64-bit hashes of a text's shingles (five words in a row,
A-Z lower-cased; a shorter text is one shingle, a text without words has none). Sketches of
parts merge into the sketch of the whole: the K smallest of the union. Two sketches estimate
resemblance (Jaccard), containment, and each the number of distinct shingles. Up to K
distinct shingles a sketch is the whole set and the estimates are exact.

As a string a sketch is the hashes in hexadecimal, ascending; equal texts have equal strings.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herdframe.llm.common import bounds_of, constant, flat, partitions, range_of, shingle_hashes, slices, tidied, whole, word_hashes

#: Hashes in a sketch: the standard error of a resemblance J is sqrt(J * (1 - J) / K).
K = 128
WIDTH = 5
#: Parts of a key when sketches of many rows merge.
SALTS = 64
#: Texts over this many bytes are sketched by parts, which overlap by WIDTH - 1 words, and merged.
PART = 4 << 20


def sketches(strings: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The sketch of every text."""
    out = []
    for _, part in slices(strings, PART):
        out += [h[:k].copy() for h in shingle_hashes(*word_hashes(*flat(part)), width)]
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness, 0 to 1; 1 for two empty sets, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    twice = both[:-1] == both[1:]
    union = both[np.append(True, ~twice)][:k]
    shared = both[:-1][twice]
    return int(np.searchsorted(shared, union[-1], side="right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    if not len(a):
        return 1.0
    union, like = merge(a, b, k), resemblance(a, b, k)
    return min(1.0, like * distinct(union, k) / distinct(a, k))


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def sketch_of(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """docs with a column `fingerprint`, which replaces one of that name. Null texts count as empty."""

    @F.arrow_udf("string")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidied(batches):
            yield pa.array(map(text_of, sketches(batch, k, width)), pa.string())

    return docs.withColumn("fingerprint", make(F.col(text)))


def merged(sketched: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One fingerprint for each value of `by`: that of all its rows' texts together.

    Hashes are made distinct, then the k smallest are kept twice: of each of SALTS parts of a key,
    then of the key. Both are row limits that Spark applies before it shuffles, so a key may hold
    any share of the rows and no task gathers more than k hashes of it from each other task.
    """
    hex_at = "transform(sequence(0, int(length(fingerprint) / 16) - 1), i -> substring(fingerprint, i * 16 + 1, 16))"
    hashes = sketched.where("fingerprint != ''").select(*by, F.explode(F.expr(hex_at)).alias("h")).distinct()
    for part in (F.pmod(F.xxhash64("h"), F.lit(SALTS)), F.lit(0)):
        rank = F.row_number().over(W.partitionBy(*by, part).orderBy("h"))
        hashes = hashes.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    made = hashes.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("fingerprint"))
    keys = sketched.select(*by).distinct()
    same = [keys[c].eqNullSafe(made[c]) for c in by]
    return keys.join(made, same, "left").select(*[keys[c] for c in by], F.coalesce(made["fingerprint"], F.lit("")).alias("fingerprint"))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Every document with its edited text: the last half replaced by as much of the beginning of the next document.

    Rows: doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, next_fingerprint.
    The next document is the next in (doc_id, text) order, and the first one after the last;
    a single document is its own next. Null ids come first, null texts are empty.

    Documents are dealt out by ranges of ids, whose bounds come from a sample of the ids. Each range
    is a task and also gets the first document of the following range, so every pair of neighbours meets in a
    task that reads its range once, in order, and holds two documents at a time.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    n = max(1, partitions(docs))
    ids = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    place = range_of(bounds_of(rows, n))
    firsts = {r.range: r.id for r in rows.select(place.alias("range"), ids.alias("id")).groupBy("range").agg(F.min("id").alias("id")).collect()}
    order = sorted(firsts)
    before = dict(zip(order, [*order[-1:], *order[:-1]], strict=True))
    first, back = ([x.get(r, -1) for r in range(n)] for x in (firsts, before))
    ahead = (F.get(constant(first), F.col("range")) == ids) & (F.get(constant(back), F.col("range")) >= 0)
    own = F.struct("range", F.lit(0).alias("ahead"))
    spare = F.struct(F.get(constant(back, "array<int>"), F.col("range")).alias("range"), F.lit(1).alias("ahead"))
    dealt = rows.withColumn("range", place).withColumn("to", F.explode(F.when(ahead, F.array(own, spare)).otherwise(F.array(own))))
    dealt = dealt.select("to.range", "to.ahead", "doc_id", "text").repartitionById(n, "range").sortWithinPartitions("range", "ahead", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, ahead, id, text, sketch) of the row before
        for batch in tidied(batches):
            for at, part in slices(batch.column(3), PART):
                keys = list(zip(*(batch.column(c).slice(at, len(part)).to_pylist() for c in (0, 1, 2)), strict=True))
                made, edits = [], []
                for key, text, sketch in zip(keys, part.to_pylist(), sketches(part, k, width), strict=True):
                    row = (*key, text, sketch)
                    if last is not None and last[0] == row[0] and not last[1]:
                        half = len(last[3]) // 2
                        made.append((last, row))
                        edits.append(last[3][: len(last[3]) - half] + text[:half])
                    last = row
                if made:
                    edited = pa.array(edits, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([a[2] for a, _ in made], pa.int64()),
                            pa.array([len(a[3]) for a, _ in made], pa.int64()),
                            edited,
                            pa.array([text_of(a[4]) for a, _ in made], pa.string()),
                            pa.array([text_of(s) for s in sketches(edited, k, width)], pa.string()),
                            pa.array([text_of(b[4]) for _, b in made], pa.string()),
                        ],
                        schema=schema,
                    )

    return dealt.mapInArrow(pair, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, next_fingerprint string")


def likeness(a: str, b: str, k: int = K):  # noqa: ANN201
    """Column with the estimated resemblance of two fingerprint columns."""

    @F.arrow_udf("double")
    def like(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else resemblance(sketch_of(x), sketch_of(y), k) for x, y in pairs], pa.float64())

    return like(F.col(a), F.col(b))
