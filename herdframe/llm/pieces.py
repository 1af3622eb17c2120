"""SentencePiece BPE encoding and decoding as rounds over flat numpy arrays.

Encoding a batch: the new words of the batch lie one after another as an array of symbols.
In each round every word finds the smallest rank among its neighbouring pairs (a segmented
minimum) and merges the leftmost pair of that rank, all words at the same time; merged
symbols are squeezed out, and words without a pair leave. One merge a word and round is
what makes the result equal to the library's, whose queue also takes the best pair first
and the leftmost of equals. Words repeat, so their ids are kept in a bounded cache.

No piece holds a space mark behind another character, nor a line feed, so texts are cut
there; both are checked against the vocabulary when it is read. A word of over LONG
symbols (a text without spaces, say) takes a heap in place of the rounds, with equal result.
"""

import codecs
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdframe.llm.common import slices, tidied

MARK = "▁"
#: Symbols of a word that the rounds take, words that a worker remembers, words encoded in one go.
LONG, CACHE, GROUP = 512, 80_000, 20_000
_NONE = np.int32(2**31 - 1)
_PIECES = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_shared: dict[int, "Pieces"] = {}


class Vocabulary:
    """Pieces, byte pieces and the pairs that merge, from the bytes of a model file."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(MARK in names[i].lstrip(MARK) or "\n" in names[i] for i in normal):
            raise ValueError("a piece spans words: texts can't be cut at spaces")
        self.size, self.unknown = n, sp.unk_id()
        self.bytes = [-1] * 256
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(names[i][1:-1], 16)] = i
        ids = {names[i]: i for i in normal}
        symbols = dict(ids)  # single characters of pieces that are no pieces come after the ids
        for p in list(ids):
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.symbols = symbols
        self.chars = {c: s for c, s in symbols.items() if len(c) == 1}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        # the place of each piece in the order of scores; byte pieces come last, others have none
        self.order = np.array([len(order) if sp.is_byte(i) else -1 for i in range(n)])
        self.order[normal] = [order[sp.get_score(i)] for i in normal]
        width = max(symbols.values()) + 2
        keys, ranks, made = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None:
                    keys.append(a * width + b)
                    ranks.append(order[sp.get_score(i)])
                    made.append(i)
        self.width = np.int64(width)
        self.pairs = _Table(np.array(keys, np.int64), np.array(ranks, np.int32), np.array(made, np.int32))
        # what each id decodes to
        text = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.plain = np.array([not sp.is_byte(i) for i in range(n)])
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        self.marked = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and names[i].startswith(MARK) for i in range(n)])
        self.long = np.array(list(map(len, text)), np.int64)
        self.at = np.append(0, np.cumsum(self.long))[:-1]
        self.blob = np.frombuffer(b"".join(text), np.uint8)


class _Table:
    """An open-addressing hash table from int64 keys to two int32 arrays, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, second: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.first, self.second = np.full(1 << bits, _NONE, np.int32), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == -1
            _, one = np.unique(slot[left], return_index=True)
            one = one[free[one]]
            put = left[one]
            self.keys[slot[put]], self.first[slot[put]], self.second[slot[put]] = keys[put], first[put], second[put]
            left = np.delete(left, one)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values for each key; _NONE and -1 for keys that aren't there."""
        slot = self._slot(keys)
        got = self.keys[slot]
        first, second = self.first[slot], self.second[slot]
        left = np.flatnonzero((got != keys) & (got != -1))
        first[left] = _NONE
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            got = self.keys[slot[left]]
            hit = left[got == keys[left]]
            first[hit], second[hit] = self.first[slot[hit]], self.second[slot[hit]]
            left = left[(got != keys[left]) & (got != -1)]
        return first, second


class Pieces:
    """Encodes and decodes with one vocabulary; keeps the ids of words between batches."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model)
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def cut(self, text: str) -> list[str]:
        """The words of a text, each with its space marks in front; a line feed is a word, and so may be nothing."""
        if not text:
            return []
        if "  " in text or "\x00" in text or MARK in text or text[0] == " ":
            return _PIECES.findall((" " + text).replace(" ", MARK))
        return (MARK + text.replace(" ", "\x00" + MARK).replace("\n", "\x00\n\x00")).split("\x00")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and len + 1 offsets."""
        cut = [self.cut(t or "") for t in texts]
        if len(self.words) > CACHE:
            self._reset()
        known = self.words
        new = list(set(chain.from_iterable(cut)).difference(known))
        for k in range(0, len(new), GROUP):
            self._learn(new[k : k + GROUP])
        n = [len(ws) for ws in cut]
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, sum(n))
        lens, starts = self.lens[which], self.starts[which]
        ends = np.append(0, np.cumsum(lens))
        ids = self.ids[np.repeat(starts - ends[:-1], lens) + np.arange(ends[-1])]
        return ids, ends[np.append(0, np.cumsum(n)).astype(np.int64)]

    def _learn(self, new: list[str]) -> None:
        short = [w for w in new if len(w) <= LONG]
        ids, lens = self._output(*self._merge(short), len(short))
        names = short
        if len(short) < len(new):
            names = short + [w for w in new if len(w) > LONG]
            each = [self._output(*self._heap(w), 1) for w in names[len(short) :]]
            ids = np.concatenate([ids, *(i for i, _ in each)])
            lens = np.concatenate([lens, *(n for _, n in each)])
        at, had = self.used, len(self.words)
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(at + 2 * len(ids), np.int32)])
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        if had + len(names) > len(self.lens):
            more = np.zeros(had + 2 * len(names), np.int64)
            self.starts, self.lens = np.append(self.starts[:had], more), np.append(self.lens[:had], more)
        self.starts[had : had + len(names)] = at + np.cumsum(lens) - lens
        self.lens[had : had + len(names)] = lens
        self.words.update(zip(names, range(had, had + len(names)), strict=True))

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One symbol a character (its id, or -1 - code point if no piece has it), and its word's number."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not hasattr(self, "by_point"):
            self.by_point = np.full(0x110000, -1, np.int32)
            for c, s in self.v.chars.items():
                self.by_point[ord(c)] = s
        syms = self.by_point[points].astype(np.int64)
        syms = np.where(syms < 0, -1 - points, syms)
        return syms, np.repeat(np.arange(len(words)), list(map(len, words)))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (left >= 0) & (right >= 0)
        rank, made = self.v.pairs.find(np.where(ok, left * self.v.width + right, -2))
        return rank, made

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words and their words' numbers."""
        syms, word = self._symbols(words)
        done_s, done_w = [], []
        rank, made = np.full(len(syms), _NONE, np.int32), np.full(len(syms), -1, np.int32)
        if len(syms) > 1:
            rank[:-1], made[:-1] = self._ranks(syms[:-1], syms[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
        while len(syms):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lens = np.diff(np.append(starts, len(syms)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lens)
            ended = least == _NONE
            if ended.any():
                done_s.append(syms[ended])
                done_w.append(word[ended])
                go = ~ended
                syms, word, rank, made, least = syms[go], word[go], rank[go], made[go], least[go]
                if not len(syms):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            syms[at] = made[at]
            keep = np.ones(len(syms), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            syms, word, rank, made = syms[keep], word[keep], rank[keep], made[keep]
            for k in (at, at[at > 0] - 1):
                inner = k[k + 1 < len(syms)]
                rank[k] = _NONE
                inner = inner[word[inner] == word[inner + 1]]
                rank[inner], made[inner] = self._ranks(syms[inner], syms[inner + 1])
        if not done_s:
            return syms, word
        syms, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return syms[order], word[order]

    def _heap(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word: a heap of pairs over a linked list of symbols."""
        syms = self._symbols([text])[0].tolist()
        n = len(syms)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        table = {}

        def pair(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in table:
                rank, made = self._ranks(np.array([a]), np.array([b]))
                table[a, b] = int(rank[0]), int(made[0])
            return table[a, b]

        heap = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                rank, made = pair(syms[i], syms[after[i]])
                if rank != _NONE:
                    heap.append((rank, i, syms[i], syms[after[i]], made)) if fresh else heapq.heappush(heap, (rank, i, syms[i], syms[after[i]], made))

        fresh = True
        for i in range(n):
            push(i)
        heapq.heapify(heap)
        fresh, gone = False, bytearray(n)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or syms[i] != a or syms[j] != b:
                continue
            syms[i], gone[j], after[i] = made, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        left = np.array([s for s, g in zip(syms, gone, strict=True) if not g], np.int64)
        return left, np.zeros(len(left), np.int64)

    def _output(self, syms: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with bytes for what isn't in the vocabulary, and the number of ids of each of n words."""
        strange = np.flatnonzero((syms < 0) | (syms >= self.v.size))
        if not len(strange):
            return syms.astype(np.int32), np.bincount(word, minlength=n)
        back = {s: c for c, s in self.v.chars.items() if s >= self.v.size}
        parts = [[self.v.bytes[b] if self.v.bytes[b] >= 0 else self.v.unknown for b in (chr(-1 - s) if s < 0 else back[s]).encode()] for s in syms[strange].tolist()]
        long = np.ones(len(syms), np.int64)
        long[strange] = list(map(len, parts))
        out = np.repeat(syms, long)
        at = (np.cumsum(long) - long)[strange]
        for k, p in zip(at.tolist(), parts, strict=True):
            out[k : k + len(p)] = p
        return out.astype(np.int32), np.bincount(np.repeat(word, long), minlength=n)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids in a row with len + 1 offsets."""
        v = self.v
        if len(ids) and (ids.min() < 0 or ids.max() >= v.size):
            raise ValueError("an id is out of range")
        lens = v.long[ids]
        ends = np.append(0, np.cumsum(lens))
        raw = v.blob[np.repeat(v.at[ids] - ends[:-1], lens) + np.arange(ends[-1])].tobytes()
        # the mark of the first piece that isn't a control piece is the one that encoding put there
        loud = np.append(np.flatnonzero(~v.silent[ids]), len(ids))
        first = loud[np.searchsorted(loud, at[:-1])]
        strip = (first < at[1:]) & v.marked[ids[np.minimum(first, max(len(ids) - 1, 0))]] if len(ids) else np.zeros(len(at) - 1, bool)
        cut = ends[at]
        if len(loud) <= len(ids):  # a control piece ends a run of byte pieces
            return [self._split(ids[a:b], s) for a, b, s in zip(at[:-1], at[1:], strip, strict=True)]
        return [raw[a + s : b].decode("utf-8", "each_byte") for a, b, s in zip(cut[:-1].tolist(), cut[1:].tolist(), strip.tolist(), strict=True)]

    def _split(self, ids: np.ndarray, strip: bool) -> str:
        v, parts, run = self.v, [], b""
        for i in ids.tolist():
            if v.silent[i]:
                parts.append(run)
                run = b""
            else:
                run += v.blob[v.at[i] : v.at[i] + v.long[i]].tobytes()
        return "".join(p.decode("utf-8", "each_byte") for p in [*parts, run])[int(strip) :]


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("each_byte", _each_byte)


def _pieces(model: bytes) -> Pieces:
    if (key := hash(model)) not in _shared:
        _shared[key] = Pieces(model)
    return _shared[key]


def _encoded(pieces: Pieces, texts: pa.Array) -> pa.Array:
    parts = [pieces.encode(s.to_pylist()) for _, s in slices(texts)] or [(np.zeros(0, np.int32), np.zeros(1, np.int64))]
    values = np.concatenate([i for i, _ in parts])
    at = np.append(0, np.cumsum(np.concatenate([np.diff(a) for _, a in parts])))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def _decoded(pieces: Pieces, ids: pa.Array) -> pa.Array:
    ids = ids.fill_null([]) if ids.null_count else ids
    out = []
    for k in range(0, len(ids), 500):
        part = ids.slice(k, 500)
        at = part.offsets.to_numpy().astype(np.int64)
        out += pieces.decode(part.flatten().to_numpy(zero_copy_only=False), at - at[0])
    return pa.array(out, pa.string())


def _model(docs: DataFrame, model_file: str) -> Broadcast:
    with open(model_file, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_file: str, text: str = "text") -> Column:
    """Column with the ids of `text`, an array of int, as the library gives them without begin and end ids.

    Null and empty texts have no ids. Rows may repeat; other columns don't matter.
    """
    model = _model(docs, model_file)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(model.value)
        for batch in tidied(batches):
            yield _encoded(pieces, batch)

    return ids(F.col(text))


def decode(docs: DataFrame, model_file: str, ids: str = "ids") -> Column:
    """Column with the text of an array of ids, as the library decodes them. Null and empty arrays give an empty text."""
    model = _model(docs, model_file)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(model.value)
        for batch in tidied(batches):
            yield _decoded(pieces, batch)

    return texts(F.col(ids))


def coded(docs: DataFrame, model_file: str, text: str = "text") -> Column:
    """Column (ids, text): what encode() gives for `text` and what decode() gives for those ids, made by one worker a task.

    A column on top of the other would take two workers a task, each with the vocabulary, and send the ids out and in again.
    """
    model = _model(docs, model_file)

    @F.arrow_udf("ids array<int>, text string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(model.value)
        for batch in tidied(batches):
            ids = _encoded(pieces, batch)
            yield pa.StructArray.from_arrays([ids, _decoded(pieces, ids)], ["ids", "text"])

    return both(F.col(text))
