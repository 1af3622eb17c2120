import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm import brute, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    corpus.crowded(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, corpus.ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_against_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
        rows[name] = [(r.doc_id, r.text) for r in docs.collect()]
    by = lambda r: (r[0] is not None, r[0] or 0, r[1])
    start = [(r[0], r[1]) for r in corpus.documents()]
    told = [(i, t) for i, t in start if t and any(c.isalpha() for c in t)]
    assert sorted(rows["language_id"], key=by) == sorted(told, key=by)
    lines = [(i, t) for i, _, dropped, t in brute.deduped_lines(told) if not dropped or t.strip(brute.SPACE)]
    assert sorted(rows["line_dedup"], key=by) == sorted(lines, key=by)
    component = brute.components(lines, 80)
    kept = [(i, t) for i, t in lines if i is None or component[i] == i]
    assert sorted(rows["near_dedup"], key=by) == sorted(kept, key=by)
    clean = [(i, t) for i, t in kept if corpus.ITEM not in t]
    assert sorted(rows["decontamination"], key=by) == sorted(clean, key=by)
    assert len(clean) == len(kept) - 1
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(rows["encoding"], key=by) == sorted(((i, sp.decode(sp.encode(t))) for i, t in clean), key=by)
    for r in docs.collect():
        assert r.n_tokens == len(r.ids)
    found = corpus_pipeline.run(spark, folder)
    assert found.count() == len(clean)
    # each stage ends in a table: nothing of the others stands in the last one's plan
    plan = found._jdf.queryExecution().toString()
    assert "decontamination-" in plan and not any(x in plan for x in ("guess", "leaky", "line_dedup-", "Join"))


def test_empty_tables(spark, tmp_path):
    corpus.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
