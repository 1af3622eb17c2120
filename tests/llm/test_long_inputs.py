"""Very long texts, words and items: right, in bounded memory and time."""

import base64
import pickle
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from herdframe.llm import decontaminate, lattice
from herdframe.llm.pieces import Pieces


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        kind = rng.randrange(3)
        text[k : k + (kind != 1)] = [] if kind == 0 else ["z"]
    return "".join(text)


def test_the_index_grows_with_the_text_and_not_with_the_longest_item():
    rng = random.Random(1)
    items = [prose(rng, 20) for _ in range(2000)] + [prose(rng, 160_000)]
    assert len(items[-1]) > 1_000_000
    index = decontaminate.Index(list(range(len(items))), items, decontaminate.RATE)
    assert len(pickle.dumps(index)) < 32 * sum(map(len, items)) + 20_000_000 < 100_000_000
    hits = index.leaks(pa.array(["zz " + items[7] + " zz", "nothing of it"]))
    assert [h[:3] for h in hits] == [(0, 7, 0)]


def plain_edits(item, text):
    """The fewest edits of the item within the text."""
    row = np.arange(len(item) + 1)
    best = int(row[-1])
    for c in text:
        new = np.empty_like(row)
        new[0] = 0
        new[1:] = np.minimum(row[:-1] + (item != c), row[1:] + 1)
        row = np.minimum.accumulate(new - np.arange(len(row))) + np.arange(len(row))
        best = min(best, int(row[-1]))
    return best


def test_long_items_are_aligned_as_short_ones(monkeypatch):
    rng = random.Random(2)
    items = [prose(rng, 40) for _ in range(6)]
    texts = []
    for k in range(60):
        item = items[k % 6]
        texts.append(prose(rng, 9) + " " + edited(rng, item, rng.randrange(len(item) // 7)) + " " + prose(rng, rng.randrange(9)))
    texts += ["", None, *items]
    index = decontaminate.Index(list(range(6)), items, decontaminate.RATE)
    want = index.leaks(pa.array(texts))
    monkeypatch.setattr(decontaminate, "LONG", 10)
    found = index.leaks(pa.array(texts))
    assert [h[:3] for h in found] == [h[:3] for h in want] and len(want) > 30
    raw = [np.frombuffer(i.encode(), np.uint8) for i in items]
    edits = {h[:2]: h[2] for h in found}
    for t, text in enumerate(texts[:60]):
        n = plain_edits(raw[t % 6], np.frombuffer(text.encode(), np.uint8))
        assert edits.get((t, t % 6)) == (n if n <= index.k[t % 6] else None)


def test_a_long_item_takes_no_longer_than_a_second():
    rng = random.Random(3)
    item = prose(rng, 4600)
    assert len(item) > 29_000
    index = decontaminate.Index([1], [item], decontaminate.RATE)
    texts = pa.array(["x y z", "begin " + edited(rng, item, 1500) + " end " + prose(rng, 3000)])
    began = time.time()
    found = index.leaks(texts)
    assert time.time() - began < 3  # about half a second on a free core
    assert [h[:2] for h in found] == [(1, 1)] and 0 < found[0][2] <= 1500


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        vocabulary = Pieces(f.read())
    v = vocabulary.v
    live = v.order >= 0
    shares = np.zeros(v.size)
    shares[live] = (v.order[live] + 1.0) ** -0.9
    with np.errstate(divide="ignore"):
        logs = np.log10(shares / shares.sum())
    return lattice.Lattice(vocabulary, lattice.Model(logs, -1.0, 10, 5, 1, False))


def test_long_words_score_like_short_ones(model, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("thequickbrownfoxé漢🙂0123") for _ in range(n)) for n in (1, 2, 20, 255, 256, 300, 900)]
    words += ["a" * 500, "\x00" * 400, base64.b64encode(rng.randbytes(600)).decode()]
    monkeypatch.setattr(lattice, "LONG", 10**9)
    want = model.scores(words)
    monkeypatch.setattr(lattice, "LONG", 0)
    assert np.allclose(model.scores(words), want, rtol=1e-9, atol=0)


def test_a_word_of_a_megabyte_takes_seconds(model):
    rng = random.Random(5)
    word = base64.b64encode(rng.randbytes(750_000)).decode()
    began = time.time()
    score = model.scores(["a", word])[1]
    assert time.time() - began < 20 and np.isfinite(score) and score < -1e6
