"""Line dedup: lines that several documents hold stay only in the first of them.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at both ends and with A-Z in
lower case. Keys of at least `shortest` code points that at least two documents hold lose all
their lines except in the document with the smallest id; there all stay. Other lines stay.
The work is that of herdframe.llm.repeats: documents probe arrays behind a minimal perfect
hash instead of joining lines. A null or empty text is one empty line.
"""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from herdframe.llm.common import SPACES
from herdframe.llm.repeats import Firsts, probed

SHORTEST = 10


def _keys(lines: list[bytes], shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the keys that are long enough, two words each, and which lines they are of."""
    digests, which = [], []
    for k, line in enumerate(lines):
        if len(line) >= shortest:
            key = line.strip(SPACES).lower()
            if len(key) >= 4 * shortest or len(key) >= shortest and len(key.decode()) >= shortest:
                digests.append(blake2b(key, digest_size=16).digest())
                which.append(k)
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2), np.array(which, np.int64)


def _lines(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The lines of all texts in a row, and how many each text has."""
    split = [t.encode().split(b"\n") for t in texts.to_pylist()]
    return [line for lines in split for line in lines], np.array(list(map(len, split)), np.int64)


def deduped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows: doc_id, n_lines (before), n_dropped, text (the lines that stay, joined by line feeds), and the columns to keep."""

    def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lines, n = _lines(texts)
        keys, which = _keys(lines, shortest)
        return keys[:, 0].copy(), keys[:, 1].copy(), np.repeat(np.arange(len(n)), n)[which]

    def work(texts: pa.Array, ids: np.ndarray, firsts: Firsts) -> dict:
        lines, n = _lines(texts)
        keys, which = _keys(lines, shortest)
        counts, first = firsts.probe(keys[:, 0].copy(), keys[:, 1].copy())
        owner = np.repeat(np.arange(len(n)), n)
        drop = np.zeros(len(lines), bool)
        drop[which] = (counts > 0) & (first != ids[owner[which]])
        dropped = np.bincount(owner[drop], minlength=len(n))
        keep, kept, at = (~drop).tolist(), [], 0
        for long, lost in zip(n.tolist(), dropped.tolist(), strict=True):
            own = lines[at : at + long]
            if lost:
                own = [line for line, k in zip(own, keep[at : at + long], strict=True) if k]
            kept.append(b"\n".join(own).decode())
            at += long
        return {"n_lines": pa.array(n), "n_dropped": pa.array(dropped.astype(np.int64)), "text": pa.array(kept, pa.string())}

    return probed(docs, hashes, work, "n_lines long, n_dropped long, text string", doc_id, text, keep)
