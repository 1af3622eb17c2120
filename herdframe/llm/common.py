"""What the operators share: reading tables, batches of text as flat numpy arrays, word and shingle hashes.

A batch of strings reaches the kernels as one byte buffer with offsets, so a pass over a
batch is a pass over flat arrays; nothing here loops over characters.
"""

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdframe.sources.shared import removed, scratch, written  # noqa: F401  the operators take them from here

#: Bytes of text that a kernel handles at once; a longer text is a batch of its own.
SLICE_BYTES = 1 << 20
#: Ids that are sampled for each range of them.
SAMPLED = 64
#: The separators of words: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Bytes that Spark hands to a Python worker at a time, whatever the length of texts.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Batches for Python workers are bounded in bytes from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` of the folder."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(col: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def constant(values: Iterable[int], kind: str = "array<bigint>") -> Column:
    """An array of numbers as one constant of the plan, whose places are read without a search."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(kind)


def bounds_of(rows: DataFrame, n: int, col: str = "doc_id") -> list[int]:
    """At most n - 1 ids that cut the rows into ranges of about as many each, from a sample by hash of SAMPLED ids a range.

    They only say where rows go. Of the table only ids are read, and the driver gets as much for a
    range as Spark's own partitioning by range takes.
    """
    ids = rows.where(F.col(col).isNotNull()).select(F.col(col).cast("long").alias("id"))
    share = min(1.0, SAMPLED * n / max(1, ids.count()))
    found = ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else ids
    some = np.sort(np.array([r.id for r in found.collect()], np.int64))
    return np.unique(some[np.arange(1, n) * len(some) // n]).tolist() if len(some) else []


def range_of(bounds: list[int], col: str = "doc_id") -> Column:
    """The number of bounds below the id, by bisection over a constant; null counts as the least id."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held, key = constant(bounds), F.coalesce(F.col(col).cast("long"), F.lit(-(2**63) + 1))
    return F.aggregate(constant(steps, "array<int>"), F.lit(0), lambda low, step: F.when(F.get(held, low + step - 1) < key, low + step).otherwise(low))


def tidied(batches: Iterator) -> Iterator:
    """The batches; after the last one the worker hands freed memory back, as it stays for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
#: Places of a run of bytes that have random numbers of their own.
PLACES = 64


def _numbers(byte: np.ndarray) -> np.ndarray:
    """A random number for each byte at each of PLACES places, in a row."""
    return mix(byte[None, :] ^ mix(np.arange(PLACES, dtype=np.uint64) * _ODD)[:, None])


_PLAIN_BYTE = _numbers(_BYTE).reshape(-1)
#: The same for A-Z and a-z; 0 for separators.
_FOLD_BYTE = np.where(_IS_SPACE, np.uint64(0), _numbers(_BYTE[_FOLDED])).reshape(-1)


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings, and len + 1 offsets into them. Nulls are empty."""
    if strings.null_count:
        strings = strings.fill_null("")
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1]
    at = at.astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(strings: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """The array in runs of about `most` bytes, each with the place where it starts."""
    if not len(strings):
        return
    _, at = flat(strings)
    start = 0
    while start < len(strings):
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield start, strings.slice(start, end - start)
        start = end


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers ascending, a place of each, and for each number which of them it is."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(x)]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], order[new], which


def run_hashes(raw: np.ndarray, starts: np.ndarray, numbers: np.ndarray = _PLAIN_BYTE) -> np.ndarray:
    """A hash of each run of bytes; runs begin at the starts, the last one ends with the bytes.

    A hash mixes the sum of random numbers, one for each byte at its place; beyond PLACES the
    number of the place goes through the mixer too, so no two places have related numbers.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    inner = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    terms = numbers[((inner & (PLACES - 1)) << 8) | raw[starts[0] :]]
    far = np.flatnonzero((inner >= PLACES) & (terms != 0))
    if len(far):
        terms[far] = mix(terms[far] ^ mix(inner[far].astype(np.uint64)))
    return mix(np.add.reduceat(terms, starts - starts[0]))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and len + 1 offsets of each text's words."""
    inside = ~_IS_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    return run_hashes(raw, starts, _FOLD_BYTE), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `width` words in a row; of fewer words, the whole sequence as one; of none, nothing."""
    n = len(words)
    if n >= width:
        runs = words[: n - width + 1].copy()
        for k in range(1, width):
            runs = runs * _ODD + words[k : n - width + 1 + k]
        runs = mix(runs)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            h = np.sort(runs[a : b - width + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif b > a:
            h = b - a
            for w in words[a:b].tolist():
                h = (h * int(_ODD) + w) % (1 << 64)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
