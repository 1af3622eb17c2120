"""What the operators must find whatever is around it."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from herdframe.llm import decontaminate, substring_dedup
from tests.llm import corpus


def test_passages_of_51_words_always_share_a_span(spark):
    rng = random.Random(3)

    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]

    rows, missed = [], 0
    for k in range(600):
        passage = words(substring_dedup.RUN)
        if k % 3 == 1:  # in sentences
            passage = [w + rng.choice(["", "", "", "", ".", "?\n"]) for w in passage]
        texts = [" ".join([*words(rng.randint(0, 40)), *passage, *words(rng.randint(0, 40))]) + "." for _ in range(2)]
        rows += [(2 * k + i, t) for i, t in enumerate(texts)]
        s = substring_dedup.Spans(pa.array(texts), substring_dedup.SENTENCES, substring_dedup.WORDS, substring_dedup.LONGEST)
        own = s.owner[s.span]
        missed += not len(np.intersect1d(s.h1[own == 0], s.h1[own == 1]))
        assert (s.span < s.stop).all() and (s.owner[s.stop - 1] == own).all()
    assert not missed
    found = substring_dedup.deduped_spans(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0")
    assert sorted(r.doc_id for r in found.collect()) == list(range(1, 1200, 2))


def test_short_items_leak_with_the_whole_budget(spark):
    chinese, russian = "水星绕太阳一周要多少天时间", "Где течёт Волга"
    bench = spark.createDataFrame([(1, chinese), (2, russian), (3, "é" * 11), (4, chinese[:7])], "item_id long, text string")
    docs = spark.createDataFrame([(1, chinese), (2, "Вопрос: " + russian + "?"), (3, "é" * 11), (4, None), (5, "")], "doc_id long, text string")
    found = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_edits) for r in found} == {(1, 1, 0), (2, 2, 0)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {3, 4, 5}
    rng = random.Random(5)
    for m in range(24, 100):
        item = "".join(rng.choice("abcdefghijklm") for _ in range(m))
        index = decontaminate.Index([7], [item], decontaminate.RATE)
        k = m // 10
        assert index.k[0] == k
        for _ in range(4):
            for n in (k, k + 1):
                # changes spread out as evenly as can be leave the fewest common q-grams
                text = list(item)
                for j in range(n):
                    text[round((j + 1) * (m + 1) / (n + 1)) - 1] = "z"
                hits = index.leaks(pa.array(["zz zz", "zz " + "".join(text) + " zz"]))
                assert [h[2] for h in hits] == ([n] if n <= k else []), (m, n)


def test_language_stage_rejects_junk_and_unlearnt_languages(spark):
    rng = random.Random(2)

    def drawn(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    rows = [(k, " ".join(corpus.sentence(rng, lang, 9) for _ in range(6)), lang) for k, lang in enumerate(["en", "de", "fr", "es"] * 250)]
    clean = [(k, corpus.sentence(rng, "en", 3), None) for k in range(2000, 2020)]
    junk = [drawn("0123456789abcdef", 400), drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 400), " ".join(drawn("bcdfghjklmnpqvwxz", 6) for _ in range(60)), "x=1;y=22;z=333;\t" * 30]
    junk += ["Вулканы на Камчатке известны своими извержениями, и учёные следят за ними круглый год.", "Suomen kieli kuuluu uralilaisten kielten joukkoon ja sitä puhutaan pääasiassa Suomessa ja myös Ruotsissa."]
    docs = spark.createDataFrame([*rows, *clean, *[(3000 + k, t, None) for k, t in enumerate(junk)]], "doc_id long, text string, lang string")
    docs = docs.selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars")
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, docs, "").collect()}
    assert not kept & set(range(3000, 3100))
    assert kept >= {r[0] for r in clean}
    assert len(kept & set(range(1000))) >= 990
