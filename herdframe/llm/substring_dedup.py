"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in . ! or ?, or with a line feed. One of over LONGEST
words is cut into parts, which count as sentences: behind every word whose hash is a multiple of
CUT, and LONGEST words after the last cut. An edit so moves cuts only up to the next such word.
From every sentence the span of consecutive sentences that begins there is hashed: SENTENCES
of them at least, and as many more as make WORDS words (A-Z lower-cased, white space doesn't
count). A span that occurred before, in a document with a smaller id or earlier in its own,
is repeated, and every sentence that a repeated span covers goes, with the white space behind
it. First occurrences stay. The work is that of herdframe.llm.repeats; a null or empty text
has no sentences.

Cuts depend on the context of a passage, so spans alone can miss one. Runs of WORDS words are
hashed besides, wherever they lie in sentences: those whose hash is the least of any RUN - WORDS + 1
neighbouring ones. RUN equal words hold as many runs, and the least of them is taken in every text
that has these words, whatever is around them; so a passage of RUN words or more always has a common
run. Every sentence that lies wholly in a repeated run goes too. As sentences are of LONGEST words
at most and a run of twice as many, there is one at least.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from herdframe.llm.common import _IS_SPACE, flat, mix, word_hashes
from herdframe.llm.repeats import Firsts, probed

#: The least number of sentences and of words in a span; words in a sentence that isn't cut, and one in so many ends a part.
SENTENCES, WORDS, LONGEST, CUT = 3, 24, 12, 6
#: Words of a passage that is never missed.
RUN = 51
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


class Spans:
    """Sentences and spans of a run of texts, as arrays."""

    def __init__(self, texts: pa.Array, sentences: int, words: int, longest: int):
        self.raw, self.at = raw, at = flat(texts)
        hashes, word_at = word_hashes(raw, at)
        n = len(hashes)
        # first and last byte of every word
        inside = ~_IS_SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[at[:-1][at[:-1] < at[1:]]] = inside[at[:-1][at[:-1] < at[1:]]]
        starts = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        close = at[1:][at[:-1] < at[1:]] - 1
        ends[close] = inside[close]
        ends = np.flatnonzero(ends)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(word_at))
        feeds = np.append(0, np.cumsum(raw == 10))
        fresh = np.ones(n, bool)
        if n > 1:
            fresh[1:] = (owner[1:] != owner[:-1]) | _ENDS[raw[ends[:-1]]] | (feeds[starts[1:]] != feeds[ends[:-1]])
        first = np.flatnonzero(fresh)
        long = np.diff(np.append(first, n))
        cut = np.repeat(long > longest, long) & (hashes % np.uint64(CUT) == 0)
        fresh[1:] |= cut[:-1]
        first = np.flatnonzero(fresh)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        fresh |= place % longest == 0
        self.first = first = np.flatnonzero(fresh)  # words that begin a sentence
        self.owner = owner[first]
        self.begin = starts[first]
        m = len(first)
        # a span ends at a sentence (exclusive) within the same text
        last = np.searchsorted(self.owner, self.owner, side="right")
        word_end = np.append(first[1:], n)
        stop = np.maximum(np.arange(m) + sentences, np.searchsorted(word_end, first + words) + 1)
        ok = stop <= last
        self.span, self.stop = np.flatnonzero(ok), stop[ok]
        a, b = first[self.span], word_end[self.stop - 1]
        self.h1, self.h2 = (self._hash(hashes, a, b, p) for p in (_A, _B))
        self._runs(hashes, word_at, word_end, words)

    def _runs(self, hashes: np.ndarray, word_at: np.ndarray, word_end: np.ndarray, words: int) -> None:
        """Adds the least runs of words to the spans; a run stands for the sentences that lie wholly in it."""
        wide = RUN - words + 1
        n = len(hashes) - RUN + 1  # places where a passage can begin
        if wide < 1 or n < 1:
            return
        a = np.arange(n + wide - 1)
        h1 = ~self._hash(hashes, a, a + words, _A)  # never that of a span
        least = _sliding(np.minimum, h1, wide)
        close = np.repeat(word_at[1:], np.diff(word_at))
        least[np.arange(n) + RUN > close[:n]] = 0  # not in one text
        zeros = np.zeros(wide - 1, np.uint64)
        a = np.flatnonzero((h1 == _sliding(np.maximum, np.concatenate([zeros, least, zeros]), wide)) & (h1 > 0))
        span, stop = np.searchsorted(self.first, a), np.searchsorted(word_end, a + words, side="right")
        some = span < stop
        a = a[some]
        self.span, self.stop = np.append(self.span, span[some]), np.append(self.stop, stop[some])
        self.h1 = np.append(self.h1, h1[a])
        self.h2 = np.append(self.h2, ~self._hash(hashes, a, a + words, _B))

    @staticmethod
    def _hash(words: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.uint64) -> np.ndarray:
        """Polynomial hashes of the words from a to b, by differences of one running sum."""
        powers = np.full(len(words) + 1, p)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        back = np.full(len(words) + 1, np.uint64(pow(int(p), -1, 1 << 64)))
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(words * powers[:-1], dtype=np.uint64))
        return mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))


def _sliding(least: np.ufunc, x: np.ndarray, wide: int) -> np.ndarray:
    """The minimum or maximum of each wide neighbours."""
    out, have = x, 1
    while have < wide:
        step = min(have, wide - have)
        out, have = least(out[:-step], out[step:]), have + step
    return out


def deduped_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS, longest: int = LONGEST) -> DataFrame:
    """Rows: doc_id, n_sentences (before), n_removed, text (what stays). Every document has a row."""

    def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = Spans(texts, sentences, words, longest)
        return s.h1, s.h2, s.owner[s.span]

    def work(texts: pa.Array, ids: np.ndarray, firsts: Firsts) -> dict:
        s = Spans(texts, sentences, words, longest)
        counts, first = firsts.probe(s.h1, s.h2)
        own = s.owner[s.span]
        again = (counts > 0) & (first != ids[own])
        # later occurrences within a text
        order = np.lexsort((s.span, s.h2, s.h1, own))
        same = np.zeros(len(order), bool)
        same[1:] = (own[order[1:]] == own[order[:-1]]) & (s.h1[order[1:]] == s.h1[order[:-1]]) & (s.h2[order[1:]] == s.h2[order[:-1]])
        again[order] |= same
        steps = np.zeros(len(s.first) + 1, np.int64)
        np.add.at(steps, s.span[again], 1)
        np.add.at(steps, s.stop[again], -1)
        gone = np.cumsum(steps)[:-1] > 0
        n = len(texts)
        n_all, n_gone = np.bincount(s.owner, minlength=n), np.bincount(s.owner[gone], minlength=n)
        raw, kept = s.raw.tobytes(), []
        cut = np.searchsorted(s.owner, np.arange(n + 1))
        for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            start, end = int(s.at[k]), int(s.at[k + 1])
            if not n_gone[k]:
                kept.append(raw[start:end].decode())
                continue
            edges = [*s.begin[a:b].tolist(), end]
            stay = [raw[edges[i] : edges[i + 1]] for i, g in enumerate(gone[a:b].tolist()) if not g]
            kept.append((raw[start : edges[0]] + b"".join(stay)).decode())
        return {"n_sentences": pa.array(n_all.astype(np.int64)), "n_removed": pa.array(n_gone.astype(np.int64)), "text": pa.array(kept, pa.string())}

    return probed(docs, hashes, work, "n_sentences long, n_removed long, text string", doc_id, text)
