"""The similarity join's bounds and crowds, trees of all sizes, exact products and windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdframe.llm import jaccard_join, merkle, negatives, queries
from tests.llm import brute, corpus


def sets_of(rng, n, share):
    """Two sorted sets with a likeness of about `share`."""
    both = rng.choice(1 << 62, n, replace=False).astype(np.uint64)
    own = rng.choice(1 << 62, 2 * round(n * (1 - share) / 2), replace=False).astype(np.uint64) | np.uint64(1 << 63)
    return np.sort(np.append(both, own[::2])), np.sort(np.append(both, own[1::2]))


def test_linked_sets_share_a_first_shingle_and_pass_the_bounds():
    rng = np.random.default_rng(1)
    linked = 0
    for k in range(600):
        a, b = sets_of(rng, int(rng.integers(1, 400)), rng.uniform(0.6, 1))
        both, percent = len(np.intersect1d(a, b)), [60, 80, 95][k % 3]
        # frequent are, at worst, all that the two share
        hot = np.sort(np.intersect1d(a, b)[:: int(rng.integers(1, 3))]) if k % 2 else np.zeros(0, np.uint64)
        lost = [jaccard_join.missing(jaccard_join.bitmap(x), jaccard_join.bitmap(y)) for x, y in ((a, b), (b, a))]
        assert lost[0] <= len(a) - both and lost[1] <= len(b) - both
        if 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            first = [jaccard_join.prefix(x, hot, percent)[0] for x in (a, b)]
            assert len(np.intersect1d(*first))
    assert linked > 200


def joined(spark, docs):
    found = jaccard_join.joined(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute.components([(i, t) for i, t in docs if i is not None], 80)
    assert {(r.doc_id, r.component_id) for r in found} == set(want.items())
    assert len(found) == len(docs)
    sizes = {}
    for i, t in docs:
        sizes.setdefault(i, set()).add(len(brute.shingles(t)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in found)
    return want


def test_crowds_and_chains_join_whole(spark):
    """A crowd beyond CROWD of near copies, a chain of edits, texts that are mostly one frequent passage, and texts that only share it."""
    rng = random.Random(4)
    base, passage = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(120)], [f"licence{k}" for k in range(40)]
    docs = []
    for k in range(60):  # near copies, some of them too far from each other
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(w)))
    chain = list(base[::-1])
    for k in range(60, 90):
        chain[(k - 60) * 4] = f"y{k}"
        docs.append((k, " ".join(chain)))
    docs += [(k, " ".join([*passage, *(f"z{k}{j}" for j in range(k % 14))])) for k in range(90, 150)]
    docs += [(k, " ".join([*(f"q{k}{j}" for j in range(200)), *passage])) for k in range(150, 200)]
    docs += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (203, "a b c d e f"), (204, "a b c d e f"), (205, docs[3][1])]
    want = joined(spark, docs)
    assert want[89] == 60 and 10 < len(set(want.values())) < 190


def test_one_long_text_and_its_copy(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(50_000)}" for _ in range(400_000)]
    near = [w if rng.random() < 0.99 else "edit" for w in long]
    docs = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[: len(long) // 2])), (4, "short text of no one else here")]
    joined(spark, docs)


@pytest.mark.parametrize("make", [queries.op11_jaccard_join, queries.op12_merkle_manifest, queries.op13_hard_negatives])
def test_empty_tables(spark, tmp_path, make):
    corpus.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], corpus.VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert make(spark, str(tmp_path)).collect() == []


def test_trees_of_all_sizes(spark):
    rows = []
    for s, n in enumerate([1, 2, 3, 4, 9, 10, 26, 27, 28, 81, 82, 730, 731]):
        rows += [(1000 * s + k, f"text {s} {k}", None, f"s{s}", 7) for k in range(n)]
    rows += [(5, "x", "en", None, 1), (6, "y", "en", "", 1), (None, "z", "en", "é", 1), (None, "z", "en", "é", 1), (None, None, "en", "é", 1)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = docs.select("doc_id", "source", merkle.digest(*[F.col(c) for c in fields]).alias("leaf"))
    found = merkle.manifest(leaves, "source", "doc_id", "leaf").withColumn("got", merkle.folded("leaf", "path"))
    assert found.where("got <> root").count() == 0
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in found.withColumn("proof", merkle.proof_digest("path")).collect()]
    want = sorted((r[:5] for r in brute.manifest([(r[0], r[1], r[2], r[3], r[4]) for r in rows])), key=str)
    assert sorted(got, key=str) == want
    # a changed leaf, or a path of another one, gives another root
    assert found.withColumn("other", merkle.folded(F.sha2("leaf", 256), "path")).where("other = root").count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for shape in ((1, 1, 1), (5, 3, 7), (17, 33, 9), (64, 64, 64), (130, 65, 131), (3, 0, 4)):
        for most in (10, 1 << 20, 1 << 29):
            a, b = rng.integers(-most, most, shape[:2]), rng.integers(-most, most, shape[1:])
            want = a.astype(object) @ b.astype(object) if shape[1] else np.zeros((shape[0], shape[2]), object)
            for leaf in (1, 4, 64):
                assert (negatives.strassen(a, b, leaf) == want).all()
    with pytest.raises(ValueError, match="64 bits"):
        negatives.scores(np.full((1, 2), 1 << 31), np.full((1, 2), 1 << 31))


def test_many_blocks_give_the_same_negatives(spark, monkeypatch):
    rows = corpus.vectors(3, 900)
    rows += [(2000 + k, [0.3] * k, k % 3) for k in range(9)]  # shorter ones count as padded by zeros
    frame = spark.createDataFrame(rows, corpus.VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = sorted(brute.hard_negatives(rows, 10))
    assert len(want) > 1000
    for anchors, candidates in ((negatives.ANCHORS, negatives.CANDIDATES), (16, 50)):
        monkeypatch.setattr(negatives, "ANCHORS", anchors)
        monkeypatch.setattr(negatives, "CANDIDATES", candidates)
        assert sorted(map(tuple, negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, label=label).collect())) == want
