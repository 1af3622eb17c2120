"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np

from herdframe.llm.common import word_hashes

SPACE = " \t\n\x0b\x0c\r"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", fold(text))


@cache
def word_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def deduped_lines(docs, shortest=10):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[fold(line.strip(SPACE))].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")

        def gone(line, i=i):
            key = fold(line.strip(SPACE))
            ids = holders[key]
            return len(key) >= shortest and len(ids) > 1 and i != min(ids, key=lambda x: (x is not None, x or 0))

        kept = [line for line in lines if not gone(line)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def deduped_spans(docs, sentences=3, least=24, longest=12):
    found, units_of, spans = {}, {}, defaultdict(list)
    for at, (i, t) in enumerate(docs):
        t, units = t or "", []
        sentence_of = [[]]
        for m in re.finditer("[^ \t\n\x0b\x0c\r]+", t):
            last = sentence_of[-1]
            if last and (last[-1][0][-1] in ".!?" or "\n" in t[last[-1][2] : m.start()]):
                sentence_of.append([])
            sentence_of[-1].append((fold(m[0]), m.start(), m.end()))
        for sentence in filter(None, sentence_of):
            units.append([])
            for k, w in enumerate(sentence):
                if k and len(sentence) > longest and (word_hash(sentence[k - 1][0]) % 6 == 0 or len(units[-1]) == longest):
                    units.append([])
                units[-1].append(w)
        units_of[at] = t, units
        for u in range(len(units)):
            j, n = u, 0
            while j < len(units) and (j - u < sentences or n < least):
                n += len(units[j])
                j += 1
            if j - u >= sentences and n >= least:
                spans[tuple(x[0] for q in units[u:j] for x in q)].append(((i is not None, i or 0), at, u, j))
    gone = defaultdict(set)
    for v in spans.values():
        first, seen = min(v)[0], set()
        for i, at, u, j in sorted(v, key=lambda x: (x[1], x[2])):
            if i != first or at in seen:
                gone[at] |= set(range(u, j))
            seen.add(at)
    for at, (t, units) in units_of.items():
        edge = [q[0][1] for q in units] + [len(t)]
        text = t[: edge[0]] + "".join(t[edge[k] : edge[k + 1]] for k in range(len(units)) if k not in gone[at])
        found[at] = docs[at][0], len(units), len(gone[at]), text
    return [found[at] for at in range(len(docs))]


def components(docs, percent=85):
    """doc_id to component; rows of one id are united."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_paths(leaves):
    """The root of a list of leaves, and for each leaf its siblings level by level: (left, right)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for i, k in enumerate(at):
            run = runs[k // 3]
            paths[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        level, at = [sha("".join(r)) for r in runs], [k // 3 for k in at]
    return level[0], paths


def folded(leaf, path):
    for left, right in path:
        leaf = sha(left + leaf + right)
    return leaf


def manifest(docs):
    """docs: (doc_id, text, lang, source, n_chars)."""

    def leaf(i, t, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))

    sources = defaultdict(list)
    for r in docs:
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_paths([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, above = tree_paths([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for (_, _, own, r), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            now = own
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = leaf(r[0], r[1].replace("\n", ""), *r[2:])
            got = folded(now, path + up)
            out.append((r[0], own, trees[s][0], root, sha("".join(a + b for a, b in path + up)), got, got == root))
    return out


def hard_negatives(rows, every=100, scale=256):
    used = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, [math.floor(scale * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in used:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, w, other in used)
            for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
                window = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
                out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(window)]
    return out
