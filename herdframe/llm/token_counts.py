"""Token counts without a shuffle: a broadcast table of frequent pre-token lengths, and worker caches for the rest.

Tier 1 is one compact hash table, an open-addressing array from the 64-bit hash of a pre-token to its
number of tokens, made from a bounded sample of the documents and broadcast. All pre-tokens of
a batch probe it at once. Tier 2 belongs to a Python worker: what tier 1 lacks is encoded once by
the tokenizer and remembered by its hash, up to CACHE entries, then afresh. Both only save
work; the count of a text is the same whatever they hold.

Texts are cut where no pre-token of the byte-level pattern can reach across: where white space
begins, and before the last white space in front of a word. What lies between two cuts is a
word with its punctuation, or white space. A text with control separators, on which libraries differ,
isn't cut.
"""

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from herdframe.llm.common import distinct, flat, run_hashes, slices, tidied
from herdframe.llm.pieces import _NONE, _Table

#: Bounds of tier 1: rows of the sample, characters of a sampled text at most, entries.
SAMPLE_ROWS, SAMPLE_CHARS, FREQUENT = 1000, 20_000, 50_000
#: Entries of tier 2 in one worker.
CACHE = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
#: White space beyond ASCII, as the bytes of UTF-8.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEADS = np.zeros(256, bool)
_LEADS[[w[0] for w in _WIDE]] = True
_tokenizers: dict[int, Tokenizer] = {}
_caches: dict[int, dict[int, int]] = {}


def _spaces(raw: np.ndarray) -> np.ndarray:
    """The number of bytes of the white space that begins at each place, 0 if none does."""
    size = _SPACE[raw].astype(np.int64)
    lead = np.flatnonzero(_LEADS[raw])
    for w in _WIDE if len(lead) else []:
        at = lead[lead + len(w) <= len(raw)]
        for k, byte in enumerate(w):
            at = at[raw[at + k] == byte]
        size[at] = len(w)
    return size


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the parts of all texts begin whose tokens add up to the texts'; at has len + 1 offsets of texts."""
    size = _spaces(raw)
    blank = size > 0
    for k in (1, 2):
        blank[k:] |= size[:-k] > k
    begins = np.zeros(len(raw) + 1, bool)
    ends = begins.copy()
    begins[at[:-1]] = ends[at[1:]] = True
    starts = np.flatnonzero(size)
    after = starts + size[starts]
    first = ~blank[starts - 1] | begins[starts]
    last = ~ends[after] & ~np.append(blank, False)[after]
    out = begins.copy()
    out[starts[first | last]] = True
    strange = np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))
    if len(strange):
        for t in np.unique(np.searchsorted(at, strange, side="right") - 1).tolist():
            out[at[t] + 1 : at[t + 1]] = False
    return np.flatnonzero(out[:-1])


def _tokenizer(source: str) -> Tokenizer:
    if (key := hash(source)) not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[key] = Tokenizer.from_str(source)
    return _tokenizers[key]


def _lengths(tok: Tokenizer, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    whole = raw.tobytes()
    texts = [whole[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return np.array([len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)], np.int64)


def _special(tok: Tokenizer) -> re.Pattern | None:
    names = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
    return re.compile(b"|".join(map(re.escape, names))) if names else None


def _split(raw: np.ndarray, at: np.ndarray, special: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    """Places where special strings begin and end, which cut texts."""
    whole = raw.tobytes()
    if special is None or not special.search(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [m.span() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for m in special.finditer(whole, a, b)]
    begin, end = zip(*found, strict=True) if found else ((), ())
    return np.array(begin, np.int64), np.array(end, np.int64)


def frequent_lengths(docs: DataFrame, source: str, text: str = "text") -> _Table:
    """Tier 1: the most frequent parts of SAMPLE_ROWS random texts at most, and their numbers of tokens."""
    short = docs.select(F.col(text).alias("t")).where(F.length("t").between(1, SAMPLE_CHARS))
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, docs.count()))
    rows = short.where(F.rand(7) <= share).limit(SAMPLE_ROWS).collect()
    tok = _tokenizer(source)
    special = _special(tok)
    raw, at = flat(pa.array([r.t for r in rows if not (special and special.search(r.t.encode()))], pa.string()))
    begin = cuts(raw, at)
    keys, first, which = distinct(run_hashes(raw, begin))
    top = np.argsort(-np.bincount(which, minlength=len(keys)), kind="stable")[:FREQUENT]
    begin, end = begin[first[top]], np.append(begin[1:], len(raw))[first[top]]
    n = _lengths(tok, raw, begin, end).astype(np.int32)
    return _Table(keys[top].view(np.int64), n, n)


def token_counts(docs: DataFrame, tokenizer_json: str, text: str = "text") -> Column:
    """Column with the number of tokens of `text` under a byte-level tokenizer file, by default handling of special strings.

    Null and empty texts count 0. Rows may repeat; other columns don't matter.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        source = f.read()
    sc = docs.sparkSession.sparkContext
    shared, model = sc.broadcast(frequent_lengths(docs, source, text)), sc.broadcast(source)

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counting(model.value, shared.value)
        for batch in tidied(batches):
            yield pa.array(np.concatenate([counter.count(part) for _, part in slices(batch)] or [np.zeros(0, np.int64)]))

    return count(F.col(text))


class Counting:
    """Counts one worker's texts."""

    def __init__(self, source: str, frequent: _Table):
        self.tok, self.frequent = _tokenizer(source), frequent
        self.special = _special(self.tok)
        self.cache = _caches.setdefault(hash(source), {})

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; nulls have none."""
        raw, at = flat(texts)
        if not len(raw):
            return np.zeros(len(texts), np.int64)
        opens, closes = _split(raw, at, self.special)
        edges = np.union1d(at, np.concatenate([opens, closes]))
        begin = cuts(raw, edges)
        begin = begin[~_within(begin, opens, closes)]
        end = np.append(begin[1:], len(raw))
        hashes = run_hashes(raw, begin)
        n, _ = self.frequent.find(hashes.view(np.int64))
        n = n.astype(np.int64)
        n[np.isin(begin, opens)] = 1
        rest = np.flatnonzero(n == _NONE)
        if len(rest):
            if len(self.cache) > CACHE:
                self.cache.clear()
            keys, first, which = distinct(hashes[rest])
            names = keys.tolist()
            new = [k for k, h in enumerate(names) if h not in self.cache]
            if new:
                spot = rest[first[new]]
                self.cache.update(zip((names[k] for k in new), _lengths(self.tok, raw, begin[spot], end[spot]).tolist(), strict=True))
            n[rest] = np.fromiter(map(self.cache.__getitem__, names), np.int64, len(names))[which]
        sums = np.append(0, np.cumsum(n))
        return np.diff(sums[np.searchsorted(begin, at)])


def _within(places: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Which places lie within a special string, behind its beginning."""
    if not len(opens):
        return np.zeros(len(places), bool)
    k = np.searchsorted(opens, places, side="left") - 1
    return (k >= 0) & (places < closes[np.maximum(k, 0)])
