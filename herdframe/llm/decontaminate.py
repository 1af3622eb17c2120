"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared as normalised bytes: A-Z and accented Latin-1 capitals
in lower case, every run of other ASCII characters than letters and digits as one space. An
item of m bytes leaks into a document if some region is within k = rate * m edits of all of it.

Filter: such a region shares at least m + 1 - q * (k + 1) q-grams with the item, all within
k + 1 neighbouring diagonals (place in the text minus place in the item). Shared q-grams are
counted in bands of 2 * (k + 1) diagonals that overlap by half, so each such run of diagonals
lies within one band; bands with fewer are out. Verification: alignment of the item with the
band's region, the dynamic programme over the band's diagonals only, all candidates of a
batch at once; the byte that closes a text can't be taken, so no region reaches from one text
into the next. q is Q, or less for items whose bound would be under one q-gram (m // (k + 1) is
always at least one), so the filter is exact with the whole k.

The benchmark is handed to the tasks in blocks of about BLOCK bytes of text, one pass over the
documents for each, so what is broadcast has a bound whatever the benchmark's size; each worker builds
a block's index for itself, some 32 bytes for each byte of items, whatever their lengths. Items of
over LONG bytes are aligned alone, their rows as the bits of whole numbers. Items of
fewer than SHORTEST normalised bytes carry no passage and never match. Null texts are empty. Of an item's
regions in a text that with the fewest edits counts, and of equals the first.
"""

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdframe.llm.common import flat, slices, tidied

#: Length of q-grams, edits for each byte of an item, shortest item, bytes of items in a block, bytes of text at once.
Q, RATE, SHORTEST, BLOCK, SLICE = 8, 0.1, 24, 1 << 20, 1 << 20
#: Rows of one alignment at a time at least, and cells.
ALIGNED, CELLS = 256, 1 << 16
#: Bytes from which an item is aligned alone.
LONG = 2048

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58], _PLAIN[97:123], _PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_PLAIN[65:91] = np.arange(97, 123)


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, each closed by a 0; len + 1 offsets; the place of each byte in its own text."""
    raw, at = flat(texts)
    n = len(texts)
    low = _PLAIN[raw]
    if len(raw):
        accented = np.append(False, raw[:-1] == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        low[accented] += 32
    low = np.insert(low, at[1:], 0)
    owner = np.repeat(np.arange(n), np.diff(at) + 1)
    place = np.arange(len(low)) - (at[:-1] + np.arange(n))[owner] if n else np.zeros(0, np.int64)
    keep = low != 32
    keep[1:] |= (low[1:] == 32) & (low[:-1] != 32) & (low[:-1] != 0)  # the first of a run, unless a text begins with it
    keep[:-1] &= ~((low[:-1] == 32) & (low[1:] == 0))
    ends = np.append(0, np.cumsum(np.bincount(owner[keep], minlength=n)))
    return low[keep], ends, place[keep]


def _codes(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each place on, as one integer."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    data = np.append(data, np.zeros(Q - q, np.uint8))
    codes = np.ndarray((len(data) - Q + 1,), np.dtype("<u8"), np.ascontiguousarray(data).data, strides=(1,)).copy()
    return codes & np.uint64((1 << 8 * q) - 1)


class Grams:
    """The q-grams of those items of a block that have the same q."""

    def __init__(self, q: int, codes: np.ndarray, item: np.ndarray, place: np.ndarray):
        self.q = q
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(codes))
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def shared(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and diagonals of all q-grams that they share with the data."""
        codes = _codes(data, self.q)
        at = np.flatnonzero(self.seen[self._slot(codes)])
        slot = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        hit = self.codes[slot] == codes[at]
        at, slot = at[hit], slot[hit]
        many = self.first[slot + 1] - self.first[slot]
        post = np.repeat(self.first[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return self.item[post], np.repeat(at, many) - self.place[post]


class Index:
    """The q-grams of a block of items."""

    def __init__(self, ids: list[int], texts: list[str | None], rate: float):
        data, at, _ = normalised(pa.array([t or "" for t in texts], pa.string()))
        long = np.diff(at) - 1
        use = np.flatnonzero(long >= SHORTEST)
        self.ids = np.array(ids, np.int64)[use]
        self.m = long[use]
        self.k = (rate * self.m).astype(np.int64)
        q = np.clip(self.m // (self.k + 1), 1, Q)
        self.need = np.maximum(self.m + 1 - q * (self.k + 1), 1)
        self.longest = int(self.m.max(initial=0))
        self.start = np.append(0, np.cumsum(self.m))[:-1]
        self.items = np.concatenate([data[at[i] : at[i] + long[i]] for i in use.tolist()]) if len(use) else np.zeros(0, np.uint8)
        codes, item, place = [], [], []
        for row, (first, n) in enumerate(zip(self.start.tolist(), self.m.tolist(), strict=True)):
            c = _codes(self.items[first : first + n], int(q[row]))
            codes.append(c)
            item.append(np.full(len(c), row, np.int32))
            place.append(np.arange(len(c), dtype=np.int32))
        self.grams = []
        for each in np.unique(q).tolist():
            rows = np.flatnonzero(q == each)
            self.grams.append(Grams(each, *(np.concatenate([x[r] for r in rows]) for x in (codes, item, place))))

    def bands(self, data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and first diagonals of the bands that share enough q-grams with the data."""
        shared = [g.shared(data) for g in self.grams]
        if not sum(len(i) for i, _ in shared):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        item = np.concatenate([i for i, _ in shared]).astype(np.int64)
        diagonal = np.concatenate([d for _, d in shared]) + self.longest  # not negative
        wide = self.k[item] + 1
        band = diagonal // wide
        span = int(band.max()) + 2
        keys = np.concatenate([item * span + band, item * span + band - 1])
        keys, counts = np.unique(keys, return_counts=True)
        item, band = keys // span, keys % span
        ok = (counts >= self.need[item]) & (band < span - 1)
        return item[ok], band[ok] * (self.k[item[ok]] + 1) - self.longest

    def align(self, data: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fewest edits of each item within its band of diagonals, and where that region ends (exclusive).

        No region takes the byte that closes a text, so each lies in one text.
        """
        m = self.m[item]
        width = int(4 * (self.k[item].max() + 1))
        left = start - (self.k[item] + 1)
        closes = np.append(0, np.cumsum(data == 0))
        low, high = np.clip(left, 0, len(data)), np.clip(left + m + width, 0, len(data))
        best, end = np.full(len(item), 1 << 20, np.int64), np.zeros(len(item), np.int64)
        inside = (left >= 0) & (left + m + width <= len(data)) & (closes[low] == closes[high])
        for rows, barred in ((np.flatnonzero(inside), False), (np.flatnonzero(~inside), True)):
            if len(rows):
                best[rows], end[rows] = self._banded(data, item[rows], left[rows], width, barred)
        return best, end

    def along(self, data: np.ndarray, at: np.ndarray, item: int, left: int) -> tuple[int, int]:
        """align() for one long item: all its rows at once as the bits of whole numbers, a column of the table a byte of the text.

        Columns are those of the band's region that lie in one text; the text of a region with bytes of
        several is the one that holds its middle.
        """
        m, k = int(self.m[item]), int(self.k[item])
        width = 4 * (k + 1)
        own = int(np.searchsorted(at, min(max(left + (m + width) // 2, 0), len(data) - 1), side="right")) - 1
        low, high = max(left, int(at[own])), min(left + m + width, int(at[own + 1]) - 1)
        pattern = self.items[self.start[item] : self.start[item] + m]
        rows = {int(c): int.from_bytes(np.packbits(pattern == c, bitorder="little").tobytes(), "little") for c in np.unique(pattern)}
        every, last = (1 << m) - 1, 1 << (m - 1)
        up, down, score = every, 0, m
        best, end = 1 << 20, 0
        for place, c in enumerate(data[low:high].tolist(), low + 1):
            same = rows.get(c, 0)
            x = same | down
            same = (((same & up) + up) ^ up) | same
            more, less = down | (every ^ ((same | up) & every)), up & same
            if more & last:
                score += 1
            elif less & last:
                score -= 1
            more, less = (more << 1) & every, (less << 1) & every
            up, down = less | (every ^ ((x | more) & every)), more & x
            if score < best:
                best, end = score, place
            if score - (high - place) > min(k, best):
                break
        return best, end

    def _banded(self, data: np.ndarray, item: np.ndarray, left: np.ndarray, width: int, barred: bool) -> tuple[np.ndarray, np.ndarray]:
        m, first, steps = self.m[item], self.start[item], np.arange(width)
        bar = int(self.k[item].max()) + 2  # more edits than any item may have
        kind = np.int32 if width * bar < 1 << 30 else np.int64
        padded = np.concatenate([np.zeros(1, np.uint8), data])
        cells = np.zeros((len(item), width), kind)
        best, end = np.full(len(item), 1 << 20, np.int64), np.zeros(len(item), np.int64)
        along = steps.astype(kind)
        for i in range(int(m.max())):
            place = left[:, None] + i + steps
            text = padded[np.where((place >= 0) & (place < len(data)), place + 1, 0)] if barred else data[place]
            new = cells + (text != self.items[first + np.minimum(i, m - 1)][:, None])
            if barred:
                shut = text == 0
                new[shut] = bar
                along = np.cumsum(np.where(shut, bar, 1), axis=1, dtype=kind)
            new[:, :-1] = np.minimum(new[:, :-1], cells[:, 1:] + 1)
            # bytes of the text that the item lacks: a running minimum along the diagonals
            cells = (np.minimum.accumulate(new - along, axis=1) + along).astype(kind)
            if barred:
                cells = np.minimum(cells, bar)
            if len(done := np.flatnonzero(m == i + 1)):
                d = np.argmin(cells[done], axis=1)
                best[done], end[done] = cells[done, d], left[done] + i + 1 + d
                if not barred and (i + 1 < m.max()):  # what is done may run past the data
                    left[done] = 0
        return best, end

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, item id, edits, first byte, last byte + 1) of the best region of each item in each text."""
        data, at, place = normalised(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        item, start = self.bands(data, owner)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        order = np.argsort(self.m[item], kind="stable")  # alignments of like lengths together
        k = 0

        def keep(i: int, e: int, stop: int) -> None:
            if e <= self.k[i]:
                stop = min(max(stop, 1), len(data))
                text = int(owner[stop - 1])
                begin = max(int(at[text]), stop - int(self.m[i]))
                key, region = (text, i), (e, int(place[begin]), int(place[stop - 1]) + 1)
                if key not in found or region < found[key]:
                    found[key] = region

        alone = int(np.searchsorted(self.m[item[order]], LONG, side="right"))
        for r in order[alone:].tolist():
            keep(int(item[r]), *self.along(data, at, int(item[r]), int(start[r] - self.k[item[r]] - 1)))
        order = order[:alone]
        while k < len(order):
            rows = order[k : k + max(ALIGNED, CELLS // int(4 * (self.k[item[order[k]]] + 1)))]
            k += len(rows)
            edits, end = self.align(data, item[rows], start[rows])
            for each in zip(item[rows].tolist(), edits.tolist(), end.tolist(), strict=True):
                keep(*each)
        return [(t, int(self.ids[i]), *region) for (t, i), region in sorted(found.items())]


class Items:
    """A block of items; its index is built where it is used, once a worker."""

    def __init__(self, ids: list[int], texts: list[str], rate: float):
        self.ids, self.texts, self.rate = ids, texts, rate

    @cached_property
    def index(self) -> Index:
        return Index(self.ids, self.texts, self.rate)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """Rows (doc_id, item_id, n_edits, first_byte, end_byte): the best region of each item in each document that has one.

    The region is exact at its end; its first byte is an item's length before. Documents with
    the same id each give their rows. An empty table on either side gives none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = None
    for shared in _indexes(benchmark, item_id, item_text, rate):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in tidied(batches):
                for at, part in slices(batch.column(1), SLICE):
                    hits = shared.value.index.leaks(part)
                    if hits:
                        ids = batch.column(0).slice(at, len(part)).take(pa.array([h[0] for h in hits]))
                        cols = [pa.array(c, pa.int64()) for c in zip(*[h[1:] for h in hits], strict=True)]
                        yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "item_id", "n_edits", "first_byte", "end_byte"])

        part = rows.mapInArrow(search, "doc_id long, item_id long, n_edits long, first_byte long, end_byte long")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns; nothing is shuffled."""
    for shared in _indexes(benchmark, item_id, item_text, rate):
        docs = docs.where(~_leaky(shared)(F.coalesce(F.col(text), F.lit(""))))
    return docs


def _leaky(shared: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def leaky(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidied(batches):
            out = np.zeros(len(batch), bool)
            for at, part in slices(batch, SLICE):
                out[[at + h[0] for h in shared.value.index.leaks(part)]] = True
            yield pa.array(out)

    return leaky


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, rate: float) -> Iterator[Broadcast]:
    """The benchmark as broadcast blocks of about BLOCK bytes of items each."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.octet_length("t") >= SHORTEST)  # normalised bytes aren't more
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r.i for r in block], [r.t for r in block], rate))
