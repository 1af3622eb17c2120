"""What repeats across documents: first holders of hashes, and documents that probe them.

Pass 1 reads the documents where they lie. Each task makes its hashes distinct by (hash,
block of documents) and Spark sums them up by hash, with partial sums: the smallest and the
largest id that hold it, how many documents do, and in which blocks. Hashes of one document
end there. Pass 2 deals documents out by block, one a task, and, in front of each block's documents, the
repeated hashes that occur in it. The task builds a minimal perfect hash over them with
arrays of fingerprints, counts and first holders, and the block's documents probe the arrays
as they stream by. A hash held by a third of all documents is one row a task in pass 1 and
one row a block in pass 2.

Hashes are 128 bits: the first 64 are the perfect hash's key, the others the fingerprint.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdframe.llm.common import partitions, slices, tidied, whole
from herdframe.llm.perfect_hash import PerfectHash

#: Hashes that a task makes distinct before it hands them on.
HELD = 400_000
#: The id that stands for a null one.
NULL_ID = -(2**63)


class Firsts:
    """The repeated hashes of one block: fingerprints, counts and first holders behind a minimal perfect hash."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, first: np.ndarray):
        self.hash = PerfectHash(np.unique(h1))
        # hashes equal in the first half only share a number: the arrays keep a layer for each
        self.layers = []
        at = self.hash.index(h1)
        while len(at):
            _, one = np.unique(at, return_index=True)
            prints, counts, ids = np.zeros(self.hash.n, np.uint64), np.zeros(self.hash.n, np.int64), np.zeros(self.hash.n, np.int64)
            prints[at[one]], counts[at[one]], ids[at[one]] = h2[one], count[one], first[one]
            self.layers.append((prints, counts, ids))
            at, h2, count, first = (np.delete(x, one) for x in (at, h2, count, first))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its number of documents and its first holder; 0 documents if it isn't repeated."""
        counts, ids = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        at = self.hash.index(h1)
        for prints, held, first in self.layers:
            hit = (at >= 0) & (prints[at] == h2) & (held[at] > 0)
            counts[hit], ids[hit] = held[at[hit]], first[at[hit]]
        return counts, ids


Hashes = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _block(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def repeated(docs: DataFrame, hashes: Hashes, n: int) -> DataFrame:
    """Pass 1 over (doc_id, text): rows (block, h1, h2, n_docs, first) of hashes that at least two documents hold.

    hashes(texts) gives two arrays of 64 bits and, for each hash, the number of its text.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def distinct() -> pa.RecordBatch:
            h1, h2, block, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, block, h2, h1))
            h1, h2, block, doc = h1[order], h2[order], block[order], doc[order]
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (block[1:] != block[:-1]))
            fresh = new.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(h1)) - 1
            n_docs = np.add.reduceat(fresh.astype(np.int64), at)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[at].view(np.int64), h2[at].view(np.int64), block[at], doc[at], doc[last], n_docs)], names=["h1", "h2", "block", "lo", "hi", "n"])

        for batch in tidied(batches):
            for at, part in slices(batch.column(2)):
                blocks, ids = (batch.column(c).slice(at, len(part)).to_numpy(zero_copy_only=False) for c in (0, 1))
                h1, h2, of = hashes(part)
                if len(h1):
                    held.append((h1, h2, blocks[of], ids[of]))
                    many += len(h1)
                if many >= HELD:
                    yield distinct()
                    held, many = [], 0
        if held:
            yield distinct()

    rows = docs.select(_block(F.col("doc_id"), n).alias("block"), "doc_id", "text").mapInArrow(local, "h1 long, h2 long, block int, lo long, hi long, n long")
    sums = rows.groupBy("h1", "h2").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.sum("n").alias("n_docs"), F.collect_set("block").alias("blocks"))
    return sums.where("first < last").select(F.explode("blocks").alias("block"), "h1", "h2", "n_docs", "first")


def probed(docs: DataFrame, hashes: Hashes, work: Callable[[pa.Array, np.ndarray, Firsts], dict], schema: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Both passes. work(texts, ids, firsts) returns columns for a run of texts, to which doc_id and those to keep are added.

    A null id counts as the smallest; rows of one id are one document. Null texts are empty.
    """
    n = partitions(docs)
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("int")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(doc_id).isNull().alias("no_id"), whole(text).alias("text"), kept.alias("kept"))
    firsts = repeated(rows, hashes, n)
    dealt = rows.select(_block(F.col("doc_id"), n).alias("block"), F.lit(1).alias("kind"), "doc_id", "no_id", "text", "kept", *[F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "n_docs")])
    ahead = firsts.select("block", F.lit(0).alias("kind"), F.col("first").alias("doc_id"), F.lit(False).alias("no_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(rows.schema["kept"].dataType).alias("kept"), "h1", "h2", "n_docs")
    both = dealt.unionByName(ahead).repartitionById(n, "block").sortWithinPartitions("block", "kind")
    names = [x.split()[0] for x in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, firsts = None, [], None
        for batch in tidied(batches):
            blocks, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)], strict=True):
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, held, firsts = blocks[a], [], None
                if kinds[a] == 0:
                    held.append([part.column(c).to_numpy(zero_copy_only=False) for c in (6, 7, 8, 2)])
                    continue
                if firsts is None:
                    cols = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 4
                    h1, h2, count, first = (x.astype(np.int64) for x in cols)
                    firsts, held = Firsts(h1.view(np.uint64), h2.view(np.uint64), count, first), []
                for at, texts in slices(part.column(4)):
                    ids = part.column(2).slice(at, len(texts))
                    made = work(texts, ids.to_numpy(), firsts)
                    ids = pa.compute.if_else(part.column(3).slice(at, len(texts)), pa.scalar(None, pa.int64()), ids)
                    rest = part.column(5).slice(at, len(texts))
                    rest = rest.flatten() if keep else []
                    yield pa.RecordBatch.from_arrays([ids, *[made[c] for c in names], *rest], names=["doc_id", *names, *keep])

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    return both.mapInArrow(stream, T.StructType([*T._parse_datatype_string(f"doc_id long, {schema}").fields, *fields]))
