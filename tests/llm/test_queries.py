"""The registered queries over a small folder with all odd cases, against libraries, DuckDB and plain versions."""

import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from herdframe.llm import queries
from tests.llm import brute, corpus

DOCS = [(r[0], r[1]) for r in corpus.documents()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    corpus.crowded(spark).write.parquet(f"{path}/documents.parquet")
    pages = [(i, f"http://x/{i}", t) for i, t in DOCS]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, corpus.ITEM), (2, None), (3, "Nothing of this kind is in any document of the corpus.")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    clashing = {c: F.lit("clash") for c in ("key", "v", "limits", "side", "part", "block", "p", "rank", "score", "anchor", "group", "positives")}
    spark.createDataFrame(corpus.vectors(), corpus.VECTORS).withColumns(clashing).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return {name: f(spark, folder).collect() for name, f in queries.queries().items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(i, mod):
    return zlib.crc32(b"" if i is None else str(i).encode()) % mod


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(folder, rows, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    found = rows[name]
    columns = sorted(found[0].asDict())
    want = db.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((v is not None, v) for v in r)
    got = [tuple(r[c] for c in columns) for r in found]
    assert len(got) == len(DOCS) or name == "op13_hard_negatives"
    assert sorted(got, key=key) == sorted(want, key=key)


def test_digests_against_libraries(rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, tokens = [], []
    for i, t in DOCS:
        ids = sp.encode(t or "")
        pieces.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
        n = len(tok.encode(t or "").ids)
        tokens.append((i, len((t or "").encode()), n, n > 512))
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in rows["op4_piece_encoding"]), key=order) == sorted(pieces, key=order)
    assert sorted((tuple(r) for r in rows["op7_token_counts"]), key=order) == sorted(tokens, key=order)


def test_fingerprints(rows):
    found = {r.doc_id: r for r in rows["op2_fingerprints"]}
    order = sorted(((i, t or "") for i, t in DOCS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(rows["op2_fingerprints"]) == len(DOCS)
    for k, (i, t) in enumerate(order[:-1]):
        if i is None or i == 117:
            continue
        after, half = order[k + 1][1], len(t) // 2
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(t[: len(t) - half] + after[:half]))
        a, b = brute.shingles(t), brute.shingles(after)
        edited = brute.shingles(t[: len(t) - half] + after[:half])
        for near, other in ((r.near_next, b), (r.near_edited, edited)):
            like = len(a & other) / len(a | other) if a | other else 1.0
            assert abs(near - like) < (1e-9 if len(a | other) <= 128 else 0.2)
        assert (r.fingerprint == r.edited_fingerprint) == (brute.shingles(t) == brute.shingles(t[: len(t) - half] + after[:half])) or len(a) > 128


def test_repeats_leaks_and_copies(rows):
    want = [(i, n, gone, sha(t)) for i, n, gone, t in brute.deduped_spans(DOCS) if gone]
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in rows["op3_substring_dedup"]), key=order) == sorted(want, key=order)
    assert {(r.doc_id, r.item_id) for r in rows["op5_benchmark_leaks"]} == {(i, 1) for i, t in DOCS if corpus.ITEM in (t or "")}
    component = brute.components(DOCS)
    for r in rows["op9_near_dedup"]:
        assert r.component_id == component.get(r.doc_id)
    component = brute.components(DOCS, 80)
    assert all(r.component_id == component.get(r.doc_id) for r in rows["op11_jaccard_join"])
    assert len(component) > len(set(component.values()))
    lines = [(i, n, gone, sha(t)) for i, n, gone, t in brute.deduped_lines(DOCS)]
    assert sorted((tuple(r) for r in rows["op10_line_dedup"]), key=order) == sorted(lines, key=order)


def test_manifest_and_negatives(rows):
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, rows["op12_merkle_manifest"]), key=order) == sorted(brute.manifest(corpus.documents()), key=order)
    assert sorted(map(tuple, rows["op13_hard_negatives"])) == sorted(brute.hard_negatives(corpus.vectors()))


def test_folds(rows):
    for name, mod, rest in (("op6_language_id", 3, 1), ("op8_lattice_scores", 7, 2)):
        assert len(rows[name]) == len(DOCS)
        assert all(r.held_out == (part(r.doc_id, mod) == rest) for r in rows[name])
    lang = {r[0]: r[2] for r in corpus.documents()}
    held = [r for r in rows["op6_language_id"] if r.held_out and r.doc_id is not None and r.doc_id < 60]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    assert {r.lang_pred for r in rows["op6_language_id"]} <= {*lang.values(), "und"}
