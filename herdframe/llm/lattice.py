"""Language-model scores by a subword lattice: the probability of a text over all its segmentations.

The vocabulary is that of a piece model file. Its scores only order the pieces (each is one less than
the one before), so as they are they weigh by a power law: log p of a piece is -POWER * log(place in
the order of scores), less a constant, with the power under which the training texts, cut by the
same scores, are the most probable. A word's lattice probability is the sum over all ways to write it
as pieces, by a forward recursion over its characters, for all words of a group at a time: in plain
numbers, and again in logs for words whose numbers get too small. Words of over LONG characters go
alone, so a word of megabytes takes seconds. A character without a piece is written as its byte pieces,
which come last in the order. A text is its words, each with a space mark in front, and one end, and
the probabilities of all texts sum to one at most.

The order of the file fits few texts, so the weights may be `learnt` from training: those of the pieces
by ROUNDS of expectation over all cuts of its distinct words (each counts once, as pieces are for words
that training lacks), from weights as 1 / place. The lattice of a token, a word or the end, then has
further arcs over all of it. Each stage below is a distribution and backs off to the one before:

- spelt: the end with a share h of its count, else the word by its pieces;
- known: (count - DISCOUNT) / N, and what all tokens give up so, times spelt;
- pair: (count behind the token before + m * known) / (count of that one + m), m = SPREAD * count of that one ** BEND;
- own: OWN of the share of the token in the text so far, the rest of pair.

With `word_arcs` the weights of the file and `known` are combined, nothing else.

Beside it a base score: words by add-one counts. Words are `[^\\x20\\x09-\\x0D]+` with A-Z
lower-cased and known by 64-bit hashes, and so are pairs.

Pass 1 makes the distinct words, and pairs if they are wanted, of a task's texts in each block of
documents, with counts, as arrays: a row for each range of hashes. Spark brings a range together, a
task sums it up and gives a row for each block. Of what is in training once and in no other
text nothing comes back: a training text that misses a count has the only one. Pass 2
deals the documents out by block and puts the counts of what occurs in a block in
front of it, so no task holds the whole vocabulary of words and none is broadcast. What is
broadcast is one number a piece. Distinct words of training are kept spelt for the rounds, each of which
is one pass over them.
"""

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdframe.llm.common import _FOLDED, _IS_SPACE, _ODD, bounds_of, distinct, flat, mix, partitions, range_of, slices, tidied, whole, word_hashes, written
from herdframe.llm.pieces import _NONE, MARK, Pieces, _Table

#: Added to the count of ends and of pieces; distinct words that pass 1 sums up in a task, and words whose scores a worker remembers.
SMOOTH, HELD, CACHE = 0.1, 600_000, 200_000
#: Taken from each word's count for the arcs of pieces.
DISCOUNT = 0.75
#: Rounds of expectation; weights of the stages, tried on sf0.001 to sf0.1, where anything near does about as well.
ROUNDS, SPREAD, BEND, OWN = 3, 3.0, 0.7, 1 / 9
#: Words of a group, and nodes of its table in the recursions.
GROUP, CELLS = 8192, 1 << 17
#: Bytes of text for each range of hashes, of which there are at most RANGES a partition.
RANGE_BYTES, RANGES = 4 << 20, 4
#: Characters from which a word goes alone, and the sum below which its recursion scales up or goes over to logs.
LONG, SMALL = 256, 1e-200
_STEP = np.int64(0x5851F42D4C957F2D)
#: Kinds of rows: counts of words and of pairs, spelt words, numbers of pieces, of ends, of words in all; texts.
WORD, PAIR, SPELT, PIECE, END, ALL, TEXT = range(7)
#: The hash of an end, which is also what is in front of a text.
_END = np.uint64(0x2545F4914F6CDD1D)
_pieces: dict[int, Pieces] = {}
_scores: dict[int, "Remembered"] = {}


def _place(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys stand or would stand among the ascending ones that are held, and whether they are there."""
    spot = np.searchsorted(held, keys)
    return spot, held[np.minimum(spot, len(held) - 1)] == keys if len(held) else np.zeros(len(keys), bool)


class Remembered:
    """Scores of words by hash: when full it goes on with those that were asked for again since it was last full."""

    def __init__(self):
        self.keys, self.scores, self.again = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)

    def of(self, keys: np.ndarray, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Scores of distinct ascending keys; `made` gives those at the places that it has no score of."""
        if len(self.keys) > 2 * CACHE:
            some = np.flatnonzero(self.again)[:CACHE]
            self.keys, self.scores, self.again = self.keys[some], self.scores[some], np.zeros(len(some), bool)
        spot, held = _place(self.keys, keys)
        out = np.empty(len(keys))
        out[held] = self.scores[spot[held]]
        self.again[spot[held]] = True
        new = np.flatnonzero(~held)
        if len(new):
            out[new] = made(new)
            at = spot[new]
            self.keys, self.scores, self.again = np.insert(self.keys, at, keys[new]), np.insert(self.scores, at, out[new]), np.insert(self.again, at, False)
        return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, len + 1 offsets of each text's words, and where each word's bytes begin and end."""
    raw, at = flat(texts)
    hashes, offsets = word_hashes(raw, at)
    inside = ~_IS_SPACE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    begins[at[:-1][full]] = inside[at[:-1][full]]
    ends[at[1:][full] - 1] = inside[at[1:][full] - 1]
    return hashes, offsets, np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _spelt(texts: pa.Array, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words between these bytes, A-Z lower-cased."""
    long = end - begin
    cuts = np.append(0, np.cumsum(long))
    raw = _FOLDED.astype(np.uint8)[flat(texts)[0][np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], long)]]
    return pa.StringArray.from_buffers(len(long), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw))


@dataclass
class Model:
    """log10 probabilities of pieces and of the end among them, and the sums over training tokens."""

    pieces: np.ndarray
    end: float
    tokens: int
    distinct: int
    ends: int
    word_arcs: bool = False
    learnt: bool = False

    def whole(self, counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens from their counts and those that the pieces give them."""
        if not (self.word_arcs and self.tokens):
            return logs
        arcs = logs + np.log10(DISCOUNT * self.distinct / self.tokens)
        words = np.log10(np.maximum(counts - DISCOUNT, 1e-300) / self.tokens)
        top = np.maximum(words, arcs)
        return top + np.log10(10.0 ** (words - top) + 10.0 ** (arcs - top))


    def token(self, spelt: np.ndarray, is_end: np.ndarray, counts: np.ndarray, pair: np.ndarray, before: np.ndarray, again: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens, with arcs over all of a token: from its count, that behind the token before
        and that one's count, and how often the text had it in the `place` tokens before."""
        share = (self.ends + SMOOTH) / (self.tokens + 2 * SMOOTH)
        spelt = np.where(is_end, math.log10(share), spelt + math.log10(1 - share))
        rest = DISCOUNT * self.distinct / self.tokens if self.tokens else 1.0
        m = SPREAD * np.maximum(before, 1.0) ** BEND
        back = np.where(place > 0, 1 - OWN, 1.0) * m / (before + m)  # how much of known counts
        arcs = OWN * again / np.maximum(place, 1) + np.where(place > 0, 1 - OWN, 1.0) * pair / (before + m)
        arcs += back * np.maximum(counts - DISCOUNT, 0) / max(self.tokens, 1)
        spelt = spelt + np.log10(back * rest)  # may be too small for a plain number
        with np.errstate(divide="ignore"):
            arcs = np.log10(arcs)
        top = np.maximum(arcs, spelt)
        return top + np.log10(10.0 ** (arcs - top) + 10.0 ** (spelt - top))


class Beginnings:
    """What the pieces of a vocabulary begin with: for each the piece that it is, or -1."""

    def __init__(self, vocabulary: Pieces):
        v = vocabulary.v
        self.single = np.full(0x110000, -1, np.int64)
        for c, s in v.chars.items():
            if s < v.size:
                self.single[ord(c)] = s
        many = [(p, i) for p, i in v.symbols.items() if i < v.size and len(p) > 1]
        self.longest = max((len(p) for p, _ in many), default=1)
        begun = {}
        with np.errstate(over="ignore"):
            for p, i in many:
                h = np.int64(ord(p[0]) + 1)
                for k, c in enumerate(p[1:], 2):
                    h = h * _STEP + np.int64(ord(c) + 1)
                    if k == len(p):
                        begun[h] = i
                    else:
                        begun.setdefault(h, -1)
        keys, ids = np.array(list(begun), np.int64), np.array(list(begun.values()), np.int32)
        self.table = _Table(keys, ids, ids)
        self.seen = np.zeros(1 << 20, bool)  # most substrings begin no piece: a small table says so first
        self.seen[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the keys that begin a piece, and what they are."""
        some = np.flatnonzero(self.seen[self._slot(keys)])
        found, _ = self.table.find(keys[some])
        held = found != _NONE
        return some[held], found[held]


#: They don't depend on weights, so a worker makes them once.
_beginnings = functools.lru_cache(maxsize=2)(Beginnings)


class Lattice:
    """Scores of words under a model."""

    def __init__(self, vocabulary: Pieces, model: Model):
        self.begun, self.logs, self.bytes = _beginnings(vocabulary), model.pieces, vocabulary.v.bytes
        self.natural = self.logs * np.log(10.0)

    def _groups(self, words: pa.Array) -> Iterator[tuple[np.ndarray, "Arcs", bool]]:
        """Places of words of about one length, their arcs, and whether it is one long word."""
        long = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        order = np.argsort(long, kind="stable")
        words, long = words.take(pa.array(order)), long[order]
        alone, a = int(np.searchsorted(long, LONG, side="right")), 0
        while a < len(order):
            b = a + 1
            if a < alone:
                wide = int(2 * long[a] + 8)
                b = max(b, min(alone, a + min(GROUP, CELLS // wide), int(np.searchsorted(long, wide, side="right"))))
            yield order[a:b], Arcs(self, words.slice(a, b - a), long[a:b]), a >= alone
            a = b

    def scores(self, words: pa.Array | list[str]) -> np.ndarray:
        """log10 of each word's probability, its space mark included."""
        out = np.zeros(len(words))
        for rows, arcs, alone in self._groups(_strings(words)):
            out[rows] = arcs.along() if alone else arcs.ahead()
        return out / np.log(10.0)

    def expected(self, words: pa.Array | list[str]) -> np.ndarray:
        """How often each piece is expected in the words, one of each: over all cuts, by their probability."""
        total = np.zeros(len(self.logs))
        for _, arcs, alone in self._groups(_strings(words)):
            total += arcs.shares_alone() if alone else arcs.shares()
        return total


class Arcs:
    """The arcs of all words of a group, which come in order of length, and the recursions over them.

    A word of k characters, its mark included, has k + 1 nodes; that of step s is s * (number of words) + word, so
    arcs of one size lie in order of their steps, and a step has at most one of a word. Pieces are found for all
    places at once, a size at a time, and only where what is read so far begins a piece.
    """

    def __init__(self, lattice: Lattice, words: pa.Array, long: np.ndarray):
        self.lattice, self.words, self.long = lattice, words, long
        self.n, self.wide = n, wide = len(long), int(long[-1])
        self.last = long * n + np.arange(n)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), words), MARK)[0].as_py()
        row = np.repeat(np.arange(n), long)
        column = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
        points = np.zeros(wide * n, np.int64)
        points[column * n + row] = np.frombuffer((MARK + joined).encode("utf-32-le"), np.uint32)
        at = np.flatnonzero(np.arange(wide)[:, None] < long)
        word, keys = at % n, points[at] + 1
        self.arcs = [(1, at, word, lattice.begun.single[points[at]])]
        for size in range(2, min(lattice.begun.longest, wide) + 1):
            inside = np.flatnonzero(at + size * n <= self.last[word])
            at, word = at[inside], word[inside]
            keys = keys[inside] * _STEP + points[at + (size - 1) * n] + 1
            more, found = lattice.begun.find(keys)
            if not len(more):
                break
            at, word, keys = at[more], word[more], keys[more]
            hit = np.flatnonzero(found >= 0)
            self.arcs.append((size, at[hit], word[hit], found[hit]))
        self.weights = [lattice.natural[piece] for _, _, _, piece in self.arcs]
        # characters without a piece: where they are, which, and the byte pieces of each
        self.strange = np.flatnonzero(self.arcs[0][3] < 0)
        chars, self.which = np.unique(points[self.arcs[0][1][self.strange]], return_inverse=True)
        self.spelt = [[lattice.bytes[b] for b in chr(c).encode()] for c in chars.tolist()]
        self.weights[0][self.strange] = np.array([sum(lattice.natural[ids]) for ids in self.spelt])[self.which]

    def _swept(self, back: bool = False, logs: bool = False) -> np.ndarray:
        """For each node the sum over all ways to it from the first one of its word, or (back) from it to the last one."""
        weights = self.weights if logs else [np.exp(w) for w in self.weights]
        starts = np.arange(self.wide + 1) * self.n
        arcs = [(size, at, np.searchsorted(at, starts).tolist(), w) for (size, at, _, _), w in zip(self.arcs, weights, strict=True)]
        value = np.full(len(starts) * self.n, -np.inf if logs else 0.0)
        value[self.last if back else slice(self.n)] = 0.0 if logs else 1.0
        for step in range(self.wide - 1, -1, -1) if back else range(1, self.wide + 1):
            for size, at, cuts, weight in arcs:
                if (begin := step if back else step - size) < 0:
                    break
                if (a := cuts[begin]) == (b := cuts[begin + 1]):
                    continue
                node, other = at[a:b], at[a:b] + size * self.n
                if not back:
                    node, other = other, node
                if logs:
                    value[node] = np.logaddexp(value[node], value[other] + weight[a:b])
                else:
                    value[node] += value[other] * weight[a:b]
        return value

    def _small(self, whole: np.ndarray) -> tuple[np.ndarray, "Arcs | None"]:
        """Where plain numbers got too small, and the arcs of those words alone."""
        small = np.flatnonzero(whole < SMALL)
        return small, Arcs(self.lattice, self.words.take(pa.array(small)), self.long[small]) if len(small) else None

    def ahead(self, logs: bool = False) -> np.ndarray:
        """log of each word's probability."""
        whole = self._swept(logs=logs)[self.last]
        if logs:
            return whole
        small, again = self._small(whole)
        out = np.log(np.maximum(whole, SMALL))
        if again:
            out[small] = again.ahead(logs=True)
        return out

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all arcs of one word: where they begin and end, and their weights."""
        sizes = np.repeat([size for size, _, _, _ in self.arcs], [len(at) for _, at, _, _ in self.arcs])
        source = np.concatenate([at for _, at, _, _ in self.arcs])
        return source, source + sizes, np.concatenate(self.weights)

    def along(self) -> float:
        """log of the probability of one long word: in plain numbers that are scaled up whenever they get small."""
        source, target, weight = self._flat()
        order = np.argsort(target, kind="stable")
        arcs = zip(source[order].tolist(), target[order].tolist(), np.exp(weight[order]).tolist(), strict=True)
        alpha, scale = [1.0] + [0.0] * self.wide, 0.0
        begin, stop, weight = next(arcs)
        for k in range(1, self.wide + 1):
            total = 0.0
            while stop == k:
                total += alpha[begin] * weight
                begin, stop, weight = next(arcs, (0, 0, 0.0))
            alpha[k] = total
            if total < SMALL:
                if total == 0.0:  # out of a float's range: the whole word in logs
                    return float(self.ahead(logs=True)[0])
                scale += math.log(total)
                for j in range(max(0, k - self.lattice.begun.longest), k + 1):
                    alpha[j] /= total
        return math.log(alpha[-1]) + scale

    def _counted(self, shares: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(self.lattice.logs))
        for ids, share in zip(self.spelt, np.bincount(self.which, shares[0][self.strange], len(self.spelt)).tolist(), strict=True):
            for i in ids:
                total[i] += share
        for (_, _, _, piece), share in zip(self.arcs, shares, strict=True):
            total += np.bincount(np.maximum(piece, 0), np.where(piece < 0, 0.0, share), len(total))
        return total

    def shares(self, logs: bool = False) -> np.ndarray:
        """How often each piece is expected."""
        ahead, behind = self._swept(logs=logs), self._swept(back=True, logs=logs)
        whole = ahead[self.last]
        ends = [(at, at + size * self.n, word, w) for (size, at, word, _), w in zip(self.arcs, self.weights, strict=True)]
        if logs:
            return self._counted([np.exp(ahead[a] + w + behind[b] - whole[word]) for a, b, word, w in ends])
        _, again = self._small(whole)
        part = np.divide(1.0, whole, out=np.zeros(self.n), where=whole >= SMALL)
        total = self._counted([ahead[a] * np.exp(w) * behind[b] * part[word] for a, b, word, w in ends])
        return total + again.shares(logs=True) if again else total

    def shares_alone(self) -> np.ndarray:
        """The same for one long word."""
        source, target, weight = self._flat()

        def swept(order: np.ndarray, other: np.ndarray, node: np.ndarray, start: int) -> np.ndarray:
            value = [-math.inf] * (self.wide + 1)
            value[start] = 0.0
            for o, k, w in zip(other[order].tolist(), node[order].tolist(), weight[order].tolist(), strict=True):
                x, y = value[o] + w, value[k]
                high, low = (x, y) if x > y else (y, x)
                value[k] = high + math.log1p(math.exp(low - high))
            return np.array(value)

        alpha = swept(np.argsort(target, kind="stable"), source, target, 0)
        beta = swept(np.argsort(-source, kind="stable"), target, source, self.wide)
        cuts = np.cumsum([len(at) for _, at, _, _ in self.arcs])[:-1]
        return self._counted(np.split(np.exp(alpha[source] + weight + beta[target] - alpha[-1]), cuts))


def _strings(words: pa.Array | list[str]) -> pa.Array:
    return words if isinstance(words, pa.Array) else pa.array(words, pa.string())


def _vocabulary(model: bytes) -> Pieces:
    if (key := hash(model)) not in _pieces:
        _pieces[key] = Pieces(model)
    return _pieces[key]


def _summed(keys: np.ndarray, blocks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each key and block, by key. A count is twice that of training, plus one if another text has the key."""
    order = np.lexsort((blocks, keys))
    keys, blocks, counts = keys[order], blocks[order], counts[order]
    at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])))
    return keys[at], blocks[at], 2 * np.add.reduceat(counts >> 1, at) + np.bitwise_or.reduceat(counts & 1, at)


def _lists(values: np.ndarray | pa.Array, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


_ARRAYS = "kind int, place int, keys array<long>, blocks array<int>, counts array<long>, words array<string>"


def _rows(kind: int, place: np.ndarray, cuts: np.ndarray, keys: np.ndarray | None = None, counts: np.ndarray | None = None, blocks: np.ndarray | None = None, words: pa.Array | None = None) -> pa.RecordBatch:
    """Rows of _ARRAYS, cut from flat arrays."""
    n = len(place)
    none = lambda kind: pa.nulls(n, pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, kind, np.int32)),
            pa.array(place.astype(np.int32)),
            none(pa.int64()) if keys is None else _lists(keys.view(np.int64), cuts, pa.int64()),
            none(pa.int32()) if blocks is None else _lists(blocks.astype(np.int32), cuts, pa.int32()),
            none(pa.int64()) if counts is None else _lists(counts, cuts, pa.int64()),
            none(pa.string()) if words is None else _lists(words, cuts, pa.string()),
        ],
        names=["kind", "place", "keys", "blocks", "counts", "words"],
    )


def _pairs(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts, an end behind each text's words, and of the pairs of each with the one before."""
    tokens = np.insert(hashes, offsets[1:], _END)
    return tokens, mix(np.append(_END, tokens[:-1]) * _ODD + tokens)


def counted(train: DataFrame, model_file: str, n: int, block: Column, learn: bool = False) -> DataFrame:
    """Pass 1 over (doc_id, text, training boolean): rows of _ARRAYS, with counts of words by block, and either
    counts of pieces of one cut, or (learn) counts of pairs and the distinct words of training as they are spelt."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(RANGES * n, size // RANGE_BYTES))
    with open(model_file, "rb") as f:
        shared = train.sparkSession.sparkContext.broadcast(None if learn else f.read())

    def place_of(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)

    def cut(kind: int, keys: np.ndarray, counts: np.ndarray | None = None, blocks: np.ndarray | None = None, words: pa.Array | None = None) -> pa.RecordBatch:
        """Rows from arrays in any order; like blocks and counts lie together, which shuffles as little."""
        places = place_of(keys)
        order = np.argsort(places, kind="stable") if blocks is None else np.argsort((places * n + blocks) * 4 + np.minimum(counts, 3))
        places, keys = places[order], keys[order]
        counts, blocks = (None if x is None else x[order] for x in (counts, blocks))
        words = None if words is None else words.take(pa.array(order))
        at = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        # words bring their hashes with them
        return _rows(kind, places[at], np.append(at, len(keys)), keys if words is None else None, counts, blocks, words)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None if learn else _vocabulary(shared.value)
        totals = np.zeros(0 if learn else vocabulary.v.size, np.int64)
        ends = 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {WORD: [], PAIR: []}
        told = np.zeros(0, np.uint64)
        names: list[tuple[np.ndarray, pa.Array]] = []

        def spelt() -> pa.RecordBatch:
            return cut(SPELT, np.concatenate([k for k, _ in names]), words=pa.concat_arrays([w for _, w in names]))

        def hold(kind: int, keys: np.ndarray, which: np.ndarray, blocks: np.ndarray, use: np.ndarray) -> None:
            pairs, _, spot = distinct(which * n + blocks)
            learnt = np.bincount(spot, use, len(pairs)).astype(np.int64)
            held[kind].append((keys[pairs // n], pairs % n, 2 * learnt + (np.bincount(spot, minlength=len(pairs)) > learnt)))

        for batch in tidied(batches):
            for at, part in slices(batch.column(1)):
                blocks = batch.column(0).slice(at, len(part)).to_numpy()
                train_too = batch.column(2).slice(at, len(part)).to_numpy(zero_copy_only=False)
                hashes, offsets, begin, end = _words(part)
                ends += int(train_too.sum())
                if learn:
                    long = np.diff(offsets) + 1
                    uniq, _, inverse = distinct(_pairs(hashes, offsets)[1])
                    hold(PAIR, uniq, inverse, np.repeat(blocks, long), np.repeat(train_too, long))
                if not len(hashes):
                    continue
                owner = np.repeat(np.arange(len(part)), np.diff(offsets))
                use = train_too[owner]
                uniq, first, inverse = distinct(hashes)
                hold(WORD, uniq, inverse, blocks[owner], use)
                times = np.bincount(inverse[use], minlength=len(uniq))
                new = np.flatnonzero(times)
                if learn:
                    spot, known = _place(told, uniq[new])
                    new = new[~known]
                    told = np.insert(told, spot[~known], uniq[new])
                    if len(new):
                        names.append((uniq[new], _spelt(part, begin[first[new]], end[first[new]])))
                    if len(told) > CACHE:
                        yield spelt()
                        told = told[:0]
                        names.clear()
                else:
                    words = [MARK + w for w in _spelt(part, begin[first[new]], end[first[new]]).to_pylist()]
                    if len(vocabulary.words) > CACHE:
                        vocabulary._reset()
                    fresh = [w for w in dict.fromkeys(words) if w not in vocabulary.words]
                    for k in range(0, len(fresh), GROUP):
                        vocabulary._learn(fresh[k : k + GROUP])
                    which = np.fromiter(map(vocabulary.words.__getitem__, words), np.int64, len(words))
                    lens, starts = vocabulary.lens[which], vocabulary.starts[which]
                    ids = vocabulary.ids[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
                    totals += np.bincount(ids, np.repeat(times[new], lens), minlength=len(totals)).astype(np.int64)
                for kind, some in held.items():
                    if sum(len(k) for k, _, _ in some) >= HELD:
                        keys, blk, cnt = _summed(*(np.concatenate(x) for x in zip(*some, strict=True)))
                        yield cut(kind, keys, cnt, blk)
                        some.clear()
        for kind, some in held.items():
            if some:
                keys, blk, cnt = _summed(*(np.concatenate(x) for x in zip(*some, strict=True)))
                yield cut(kind, keys, cnt, blk)
        if names:
            yield spelt()
        used = np.flatnonzero(totals)
        yield _rows(PIECE, np.zeros(1), np.array([0, len(used)]), used, totals[used])
        yield _rows(END, np.zeros(1), np.array([0, 1]), np.zeros(1, np.int64), np.array([ends]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one range and kind come in a row; what comes out has a block as its place."""
        now, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            kind = now[1]
            if kind == SPELT:
                words = pa.concat_arrays([p.column(5).flatten() for p in parts])
                _, at, _ = distinct(word_hashes(*flat(words))[0])
                yield _rows(SPELT, np.full(1, -1), np.array([0, len(at)]), words=words.take(pa.array(at)))
                return
            keys = np.concatenate([p.column(2).flatten().to_numpy(zero_copy_only=False) for p in parts]).view(np.uint64)
            counts = np.concatenate([p.column(4).flatten().to_numpy(zero_copy_only=False) for p in parts])
            if kind not in (WORD, PAIR):
                yield _rows(kind, np.full(1, -1), np.array([0, len(keys)]), keys, counts)
                return
            keys, blocks, counts = _summed(keys, np.concatenate([p.column(3).flatten().to_numpy(zero_copy_only=False) for p in parts]), counts)
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            total, other = np.add.reduceat(counts >> 1, at), np.bitwise_or.reduceat(counts & 1, at)
            if kind == WORD:
                yield _rows(ALL, np.full(1, -1), np.array([0, 2]), np.zeros(2, np.int64), np.array([total.sum(), (total > 0).sum()]))
            size = np.diff(np.append(at, len(keys)))
            keep = np.flatnonzero(np.repeat(total + other > 1, size) & np.repeat(total > 0, size))
            if len(keep):
                total = np.repeat(total, size)
                order = keep[np.lexsort((total[keep], blocks[keep]))]
                blocks = blocks[order]
                heads = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
                yield _rows(kind, blocks[heads], np.append(heads, len(blocks)), keys[order], total[order])

        for batch in tidied(batches):
            kinds, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (kinds[1:] != kinds[:-1]) | (places[1:] != places[:-1])))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(kinds)], strict=True):
                if (own := (int(places[a]), int(kinds[a]))) != now:
                    yield from done()
                    now, parts = own, []
                parts.append(batch.slice(a, b - a))
        yield from done()

    rows = train.select(block.alias("block"), "text", "training").mapInArrow(local, _ARRAYS)
    return rows.repartitionById(n, F.col("place") % n).sortWithinPartitions("place", "kind").mapInArrow(merged, _ARRAYS)


def power(places: np.ndarray, mean: float) -> float:
    """The exponent p for which numbers drawn as places ** -p have this mean logarithm: the most probable one."""
    logs = np.log(places)
    low, high = 0.0, 16.0
    for _ in range(60):
        middle = (low + high) / 2
        weights = np.exp(-middle * logs)
        low, high = (middle, high) if weights @ logs / weights.sum() > mean else (low, middle)
    return low


def _numbers(sums: DataFrame, kind: int) -> DataFrame:
    """(key, n): the sums of the counts of a kind."""
    pairs = sums.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("n"))


def expected(words: DataFrame, model_file: str, shares: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the spelt words, one of each, under these shares. What reaches the driver is a row a piece."""
    sc = words.sparkSession.sparkContext
    with open(model_file, "rb") as f:
        file = sc.broadcast(f.read())
    with np.errstate(divide="ignore"):
        shared = sc.broadcast(Model(np.log10(shares), 0.0, 0, 0, 0))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = None, np.zeros(0)
        for batch in tidied(batches):
            lattice = lattice or Lattice(_vocabulary(file.value), shared.value)
            found = lattice.expected(batch.column(0).flatten())
            total = total + found if len(total) else found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

    found = np.zeros(len(shares))
    for r in words.mapInArrow(local, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        found[r.piece] = r.n
    return found


def learnt(sums: DataFrame, vocabulary: Pieces, word_arcs: bool = False, model_file: str | None = None) -> Model:
    """The model from the sums of pass 1; with a model file the weights of its pieces are learnt from spelt words.
    What reaches the driver is a row for each piece of the vocabulary."""
    v = vocabulary.v
    live = v.order >= 0
    places = v.order[live] + 1.0
    row = sums.where(F.col("kind") == ALL).agg(F.sum(F.get("counts", F.lit(0))).alias("n"), F.sum(F.get("counts", F.lit(1))).alias("v")).first()
    words, kinds = row.n or 0, row.v or 0
    ends = sum(r.n for r in _numbers(sums, END).collect())
    shares = np.zeros(v.size)
    if model_file:
        shares[live] = 1 / places / (1 / places).sum()
        spelt = sums.where(F.col("kind") == SPELT).select("words")
        for _ in range(ROUNDS if kinds else 0):
            found = expected(spelt, model_file, shares)[live] + SMOOTH
            # rounded, as the order of sums must not show
            shares[live] = 10.0 ** np.round(np.log10(found / found.sum()), 9)
        with np.errstate(divide="ignore"):
            return Model(np.log10(shares / shares.sum()), 0.0, words + ends, kinds + (ends > 0), ends, learnt=True)
    counts = np.zeros(v.size)
    for r in _numbers(sums, PIECE).collect():
        counts[r.key] += r.n
    used = counts[live].sum()
    weights = places ** -(power(places, counts[live] @ np.log(places) / used) if used else 1.0)
    end = (ends + SMOOTH) / (used + SMOOTH)
    shares[live] = weights / weights.sum() / (1 + end)
    # after a word's first piece the others go on until the next mark or the end
    inner = shares[~v.marked].sum()
    with np.errstate(divide="ignore"):
        return Model(np.log10(shares), float(np.log10(end / (1 + end) / (1 - inner))), words + ends, kinds + (ends > 0), ends, word_arcs)


def _again(which: np.ndarray, owner: np.ndarray, kinds: int) -> np.ndarray:
    """How often each token's text had it before."""
    both = owner * kinds + which
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    out = np.empty(len(both), np.int64)
    out[order] = np.arange(len(both)) - np.repeat(heads, np.diff(np.append(heads, len(both))))
    return out


def _found(held: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The counts of keys; 0 for what isn't held."""
    known, counts = held
    if not len(known):
        return np.zeros(len(keys), np.int64)
    spot, held = _place(known, keys)
    return np.where(held, counts[np.minimum(spot, len(known) - 1)], 0)


def scored(docs: DataFrame, model_file: str, training: Column, doc_id: str = "doc_id", text: str = "text", word_arcs: bool = False, learn: bool = False) -> DataFrame:
    """Rows: doc_id, n_tokens, n_known, train_tokens, base_score, score for every document, learning from those where `training` holds.

    The weights are those of the file, with `word_arcs` if wanted, or with `learn` those learnt from the training texts.
    Null texts are empty: one token, the end. Null ids are kept. Without any training text all
    words are unknown and the power is one. Texts score with their own words' counts
    even if they were learnt from.
    """
    n = partitions(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    block = range_of(bounds_of(rows, n)).cast("int")
    with open(model_file, "rb") as f:
        vocabulary = f.read()
    sums = written(counted(rows, model_file, n, block, learn), "words")
    model = learnt(sums, Pieces(vocabulary), word_arcs, model_file if learn else None)
    sc = docs.sparkSession.sparkContext
    shared, file = sc.broadcast(model), sc.broadcast(vocabulary)
    ahead = sums.where(F.col("kind").isin(WORD, PAIR)).select(F.col("place").alias("block"), "kind", "keys", "counts", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("training"))
    dealt = rows.select(block.alias("block"), F.lit(TEXT).alias("kind"), F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("array<long>").alias("counts"), "doc_id", "text", "training")
    both = dealt.unionByName(ahead).repartitionById(n, "block").sortWithinPartitions("block", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        lattice = Lattice(_vocabulary(file.value), m)
        cache = _scores.setdefault(hash(m.pieces.tobytes()), Remembered())
        log_all = np.log10(m.tokens + m.distinct + 1.0)
        own_end = float(m.whole(np.array([m.ends]), np.array([m.end]))[0])
        now, held, ready = None, {}, {}

        def counts_of(kind: int) -> tuple[np.ndarray, np.ndarray]:
            if kind not in ready:
                some = held.pop(kind, [])
                keys, counts = (np.concatenate(x) for x in zip(*some, strict=True)) if some else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                order = np.argsort(keys)
                ready[kind] = keys[order], counts[order]
            return ready[kind]

        for batch in tidied(batches):
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)], strict=True):
                part = batch.slice(a, b - a)
                if blocks[a] != now:
                    now, held, ready = blocks[a], {}, {}
                if kinds[a] != TEXT:
                    # copies, as the batches themselves would stay
                    held.setdefault(int(kinds[a]), []).append((part.column(2).flatten().to_numpy().view(np.uint64).copy(), part.column(3).flatten().to_numpy().copy()))
                    continue
                for at, texts in slices(part.column(5)):
                    trained = part.column(6).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(bool)
                    hashes, offsets, begin, end = _words(texts)
                    uniq, first, inverse = distinct(hashes)
                    spelt = cache.of(uniq, lambda new: lattice.scores(_spelt(texts, begin[first[new]], end[first[new]])))  # noqa: B023
                    n_words = np.diff(offsets)
                    tokens = n_words + 1
                    owner = np.repeat(np.arange(len(texts)), tokens)
                    starts = np.cumsum(tokens) - tokens
                    # the end is one more kind of token
                    which = np.insert(inverse, offsets[1:], len(uniq))
                    is_end = which == len(uniq)
                    # training texts that miss a count have the only one
                    times = np.append(_found(counts_of(WORD), uniq), m.ends)[which]
                    times = np.where((times == 0) & trained[owner] & ~is_end, 1, times)
                    if m.learnt:
                        pairs, _, spot = distinct(_pairs(hashes, offsets)[1])
                        pair = _found(counts_of(PAIR), pairs)[spot]
                        pair = np.where((pair == 0) & trained[owner], 1, pair)
                        before = np.append(m.ends, times[:-1])
                        own = m.token(np.append(spelt, 0.0)[which], is_end, times, pair, before, _again(which, owner, len(uniq) + 1), np.arange(len(which)) - starts[owner])
                    else:
                        own = np.where(is_end, own_end, m.whole(times, np.append(spelt, own_end)[which]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(4).slice(at, len(texts)),
                            pa.array(tokens.astype(np.int64)),
                            pa.array(np.add.reduceat((times > 0).astype(np.int64), starts)),
                            pa.array(np.full(len(texts), m.tokens, np.int64)),
                            pa.array(np.add.reduceat(np.log10(times + 1.0) - log_all, starts)),
                            pa.array(np.add.reduceat(own, starts)),
                        ],
                        names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    return both.mapInArrow(stream, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
