import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from herdframe.llm import decontaminate, fingerprints, language_id, lattice, line_dedup, near_dedup, pieces, substring_dedup, token_counts, warc
from herdframe.llm.common import bounds_of, range_of, scratch, whole
from herdframe.llm.perfect_hash import PerfectHash
from tests.llm import brute, corpus

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ROWS = corpus.documents()
DOCS = [(r[0], r[1]) for r in ROWS]


def key(row):
    return tuple((v is not None, v) for v in row)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=key)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.crowded(spark).cache()


@pytest.mark.parametrize("held", [warc.HELD, 0])
def test_warc_round_trip(spark, monkeypatch, held):
    monkeypatch.setattr(warc, "HELD", held)
    big, small = "<p>same page</p>" * 20, "<p>"
    rows = [(1, "u1", big), (2, "u2", big), (3, None, small), (4, "u4", small), (5, "u5", None), (6, "u\r\nx: y", ""), (None, "u7", big), (8, "u8", "x" * 3_000_000), (9, "é", "é" * 60), (2, "u2", big)]
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, "id long, url string, html string").withColumn("payload", F.col("html").cast("binary")), path)
    found = ordered(warc.read(spark, path).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    first = {p: min((j for j, q in raw if q == p and j is not None), default=None) for _, p in raw}
    want = [(i, len(p), hashlib.sha256(p).hexdigest(), *(("revisit", first[p]) if len(p) >= 100 and i != first[p] else ("response", None))) for i, p in raw]
    assert found == ordered(want)
    one = warc.read(spark, path, ids=[8]).collect()
    assert len(one) == 1 and bytes(one[0].payload) == b"x" * 3_000_000


def test_warc_archives_are_seekable_and_exported(spark, tmp_path):
    rows = [(i, f"u{i}", random.Random(i).randbytes(50_000)) for i in range(40)]
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, "id long, url string, payload binary").coalesce(1), path)
    bundle = spark.read.parquet(path).first()
    table = warc.seek_table(bytes(bundle.archive))
    assert len(table) > 3 and sum(plain for _, _, plain in table) == sum(bundle.lengths)
    import zstandard

    start, packed, size = table[bundle.frames[20]]
    frame = zstandard.ZstdDecompressor().decompress(bytes(bundle.archive)[start : start + packed], max_output_size=size)
    record = warc.parse_record(frame[bundle.offsets[20] : bundle.offsets[20] + bundle.lengths[20]])
    assert record["payload"] == rows[bundle.ids[20]][2]
    files = [r.file for r in warc.export(spark, path, f"file://{tmp_path}").collect()]
    stream = zstandard.ZstdDecompressor().stream_reader((tmp_path / files[0]).read_bytes(), read_across_frames=True)
    assert stream.read(8) == b"WARC/1.1"
    empty = scratch(spark, "warc")
    warc.write(spark.createDataFrame([], "id long, url string, payload binary"), empty)
    assert warc.read(spark, empty).count() == 0


def test_fingerprints(spark, docs):
    found = {r.doc_id: r for r in fingerprints.edited_pairs(docs).withColumn("near", fingerprints.likeness("fingerprint", "edited_fingerprint")).collect() if r.doc_id is not None}
    order = sorted(((i, t or "") for i, t in DOCS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (i, t) in enumerate(order):
        if i is None or i == 117:
            continue
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert found[i].n_chars == len(t) and found[i].edited == edited
        a, b = brute.shingles(t), brute.shingles(edited)
        like = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(found[i].near - like) < (1e-9 if len(a | b) <= fingerprints.K else 0.2)
    assert found[100].fingerprint == found[101].fingerprint == found[4].fingerprint
    assert fingerprints.edited_pairs(corpus.empty(spark)).count() == 0
    alone = fingerprints.edited_pairs(corpus.frame(spark, [(7, "one two", None, None, 7)])).first()
    assert alone.edited == "one " + "one"


def test_fingerprints_merge(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(300)) for _ in range(6)]
    made = fingerprints.fingerprints(spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "part long, text string"))
    merged = {r.part: fingerprints.sketch_of(r.fingerprint) for r in fingerprints.merged(made, ["part"]).collect()}
    for part in (0, 1):
        own = [fingerprints.sketches(pa.array([t]), k=10**6)[0] for t in texts[part::2]]
        want = np.unique(np.concatenate(own))
        assert (merged[part] == want[: fingerprints.K]).all()
        assert abs(fingerprints.distinct(merged[part]) / len(want) - 1) < 0.3
    a, b = (fingerprints.sketches(pa.array([t]))[0] for t in (texts[0], texts[0] + " " + texts[1]))
    assert fingerprints.containment(a, b) > 0.8 > fingerprints.resemblance(a, b)


def test_substring_dedup(spark, docs):
    found = substring_dedup.deduped_spans(docs).select("doc_id", "n_sentences", "n_removed", "text").collect()
    want = brute.deduped_spans(DOCS)
    assert ordered(found) == ordered(want)
    by_id = {r[0]: r for r in want}
    assert "passage5" in by_id[107][3] and "passage5" not in by_id[108][3] and by_id[101][2] > 0 and by_id[4][2] == 0
    assert substring_dedup.deduped_spans(corpus.empty(spark)).count() == 0


def test_line_dedup(spark, docs):
    found = line_dedup.deduped_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert ordered(found) == ordered(brute.deduped_lines(DOCS))
    assert line_dedup.deduped_lines(corpus.empty(spark)).count() == 0
    kept = line_dedup.deduped_lines(docs, keep=("lang", "source"))
    assert kept.columns == ["doc_id", "n_lines", "n_dropped", "text", "lang", "source"] and kept.where("doc_id = 104").first().lang == "de"


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64))
    made = PerfectHash(keys)
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
    other = made.index(keys + np.uint64(1))
    assert other.max() < len(keys)
    assert PerfectHash(np.zeros(0, np.uint64)).index(keys[:3]).tolist() == [-1, -1, -1]


def test_pieces(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coded = docs.select("doc_id", whole("text").alias("text"), pieces.encode(docs, PIECES).alias("ids"))
    found = coded.withColumn("back", pieces.decode(coded, PIECES)).collect()
    once = docs.select("doc_id", pieces.coded(docs, PIECES).alias("c")).select("doc_id", "c.ids", "c.text")
    assert sorted(map(repr, once.toLocalIterator())) == sorted(repr(r) for r in once.sparkSession.createDataFrame([(r.doc_id, r.ids, r.back) for r in found], once.schema).toLocalIterator())
    assert once._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert len(found) == len(DOCS)
    for r in found:
        want = sp.encode(r.text)
        assert list(r.ids) == want and r.back == sp.decode(want)
    assert corpus.empty(spark).select(pieces.encode(docs, PIECES)).count() == 0


def test_ranges_of_ids(spark):
    rows = spark.range(5000).selectExpr("case when id % 10 = 0 then null else id * id end as doc_id").cache()
    for n in (1, 2, 7, 300):
        bounds = bounds_of(rows, n)
        found = rows.select("doc_id", range_of(bounds).alias("r")).collect()
        assert all(r.r == (0 if r.doc_id is None else sum(b < r.doc_id for b in bounds)) for r in found)
        assert len(bounds) <= n - 1 and max(Counter(r.r for r in found if r.doc_id is not None).values()) < 2 * 4500 / n + 40


def test_word_hashes_have_no_algebra():
    """Words in the order of Thue and Morse and their complement, longer ones too, and words that differ in one far letter."""
    from herdframe.llm.common import flat, word_hashes

    order = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << 14))
    other = order.translate(str.maketrans("ab", "ba"))
    words = [x[:k] for k in (64, 1024, 1 << 14) for x in (order, other)] + ["x" * 100 + c + "x" * 100 for c in "yz"]
    hashes, _ = word_hashes(*flat(pa.array([" ".join([*words, *map(str.upper, words)])])))
    assert len(set(hashes[: len(words)].tolist())) == len(words) and (hashes[: len(words)] == hashes[len(words) :]).all()


def test_pieces_rounds_and_heap_agree(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "漢", "▁", "ing", "1", "😀"]) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    want = sp.encode(texts)
    with open(PIECES, "rb") as f:
        model = f.read()
    for long in (512, 2):
        monkeypatch.setattr(pieces, "LONG", long)
        ids, at = pieces.Pieces(model).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    some = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(270) for _ in range(rng.randint(0, 9))] for _ in range(500)]
    at = np.append(0, np.cumsum(list(map(len, some))))
    assert pieces.Pieces(model).decode(np.array(sum(some, [])), at) == [sp.decode(x) for x in some]


def test_token_counts(spark, docs):
    tok = Tokenizer.from_file(BYTES)
    found = docs.select("text", token_counts.token_counts(docs, BYTES).alias("n_tokens")).collect()
    assert len(found) == len(DOCS)
    assert all(r.n_tokens == len(tok.encode(r.text or "").ids) for r in found)
    rng = random.Random(2)
    nothing = np.zeros(0, np.int64)
    counter = token_counts.Counting(tok.to_str(), pieces._Table(nothing, nothing.astype(np.int32), nothing.astype(np.int32)))
    parts = ["a", " the", " ", "  ", "\n", "\t", "\r", "é", "\u3000", "\xa0", "\x85", "\u2003", "\u200b", "’", "\x1c", "\x00", "'s", "12", "!", "<|endoftext|>", "<|endo", "ftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert counter.count(pa.array(texts)).tolist() == [len(e.ids) for e in tok.encode_batch(texts)]
    assert counter.count(pa.array([None, "", "a"])).tolist() == [0, 0, 1]
    empty = corpus.empty(spark)
    assert empty.select(token_counts.token_counts(empty, BYTES)).count() == 0


def test_language_id(spark, docs):
    model = language_id.fit(docs.where("doc_id % 3 <> 1"))
    found = language_id.predict(docs, model)
    assert found.columns[-2:] == ["lang_pred", "score"] and found.count() == len(DOCS)
    rows = found.select("doc_id", "text", "lang", "lang_pred", "score").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert language_id.fit(corpus.empty(spark)) is None
    assert language_id.predict(docs, None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_id_of_null_ids_and_copies(spark):
    """Neither null ids nor thousands of copies of a text hide a language."""
    rng = random.Random(8)
    rows = [(None, corpus.sentence(rng, "en", 9), "en") for _ in range(1500)] + [(None, "the same text of all these rows", "en")] * 1500
    rows += [(None, corpus.sentence(rng, "fr", 9), "fr") for _ in range(30)] + [(k, corpus.sentence(rng, "de", 9), "de") for k in range(30)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(labelled, per_language=20)
    assert {c for m in model.languages.values() for c in m.classes} == {"en", "fr", "de"}
    found = language_id.predict(labelled, model).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"))
    assert all(r.right > 0.9 for r in found.collect())


def test_language_id_against_plain_python(spark, docs):
    """Features, margins and the choice of family and language, text by text."""
    model = language_id.fit(docs)
    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.predict(docs, model).select("doc_id", "text", "lang_pred", "score").collect()}

    def features(text):
        counts, raw = Counter(), text.encode()
        low, k = [], 0
        for c in text:
            b = c.encode()
            if len(b) == 1:
                low.append(ord(c.lower()) if c.isalpha() else 32)
            else:
                low += (c.lower() if 0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7 else c).encode()
        for size in (1, 2, 3):
            for k in range(len(low) - size + 1):
                code = 0
                for b in low[k : k + size]:
                    code = code * 256 + b
                counts[(code * 2654435761 + size * 40503) % 2**32 >> 20] += 1
        assert len(low) == len(raw)
        total = sum(counts.values())
        return {f: math.sqrt(c / total) for f, c in counts.items()}

    def voted(machines, classes, x):
        wins, sums = [0] * len(classes), [0.0] * len(classes)
        for (i, j), m in machines.items():
            margin = sum(v * float(m.weights[f]) for f, v in x.items()) + m.bias
            p = 1 / (1 + math.exp(-(m.slope * margin + m.offset)))
            wins[i if p >= 0.5 else j] += 1
            sums[i] += p
            sums[j] += 1 - p
        if len(classes) == 1:
            return classes[0], 1.0
        best = max(range(len(classes)), key=lambda k: (wins[k], sums[k]))
        return classes[best], sums[best] / (len(classes) - 1)

    for i, t in DOCS:
        if t and any(c.isalpha() for c in t) and len(t) < 5000:
            x = features(t)
            family, p = voted(model.families.machines, model.families.classes, x)
            lang, q = voted(model.languages[family].machines, model.languages[family].classes, x)
            assert found[i, t][0] == lang and found[i, t][1] == pytest.approx(p * q, abs=1e-3)


def test_long_texts_have_the_same_features(monkeypatch):
    text = pa.array(["".join(random.Random(1).choice("abc é\n") for _ in range(5000)), "", "xyz"])
    whole_text = language_id.frequencies(text)
    monkeypatch.setattr(language_id, "PASS", 700)
    assert np.allclose(language_id.frequencies(text), whole_text)


def test_lattice_scores(spark, docs):
    def part(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 7

    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    found = lattice.scored(docs, PIECES, training).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts, ends = Counter(), 0
    for i, t in DOCS:
        if part(i) != 2:
            counts.update(brute.words(t))
            ends += 1
    with open(PIECES, "rb") as f:
        own = pieces.Pieces(f.read())
    piece = Counter()
    for w, k in counts.items():
        if "▁" not in w:
            for p in sp.encode(w):
                piece[p] += k
        else:
            own._learn(["▁" + w])
            at = own.words["▁" + w]
            for p in own.ids[own.starts[at] : own.starts[at] + own.lens[at]].tolist():
                piece[p] += k
    size, n, v = sp.get_piece_size(), sum(counts.values()) + ends, len(counts) + 1
    rank = {x: k for k, x in enumerate(sorted({sp.get_score(i) for i in range(259, size)}, reverse=True), 1)}
    place = {i: rank[sp.get_score(i)] for i in range(259, size)} | dict.fromkeys(range(3, 259), len(rank) + 1)
    used = sum(piece.values())

    def gain(power):
        """The log-likelihood of the training pieces for each of them."""
        return -power * sum(c * math.log(place[i]) for i, c in piece.items()) / used - math.log(sum(p**-power for p in place.values()))

    low, high = 0.0, 10.0
    while high - low > 1e-9:
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if gain(a) < gain(b) else (low, b)
    mass = sum(p**-low for p in place.values())
    assert lattice.power(np.array(list(place.values()), float), sum(c * math.log(place[i]) for i, c in piece.items()) / used) == pytest.approx(low, abs=1e-6)
    low = lattice.power(np.array([place[i] for i in range(3, size)], float), sum(c * math.log(place[i]) for i, c in piece.items()) / used)
    mass, end = sum(p**-low for p in place.values()), (ends + 0.1) / (used + 0.1)
    ids = {sp.id_to_piece(i): i for i in range(259, size)}
    logs = {i: math.log10(p**-low / mass / (1 + end)) for i, p in place.items()}
    inner = sum(10 ** logs[i] for i in logs if not sp.id_to_piece(i).startswith("▁"))
    own_end = math.log10(end / (1 + end) / (1 - inner))
    log = logs.__getitem__

    cache = {}

    def word(w):
        if w not in cache:
            s = "▁" + w
            a = [0.0] + [-math.inf] * len(s)
            for e in range(1, len(s) + 1):
                terms = []
                for size in range(1, min(e, 16) + 1):
                    x = s[e - size : e]
                    if x in ids:
                        terms.append(a[e - size] + log(ids[x]))
                    elif size == 1:
                        terms.append(a[e - 1] + sum(log(3 + b) for b in x.encode()))
                top = max(terms)
                a[e] = top + math.log10(sum(10 ** (t - top) for t in terms))
            cache[w] = a[-1]
        return cache[w]

    def token(count, arcs):
        b = math.log10(0.75 * v / n) + arcs
        if count <= 0:
            return b
        a = math.log10((count - 0.75) / n)
        return max(a, b) + math.log10(1 + 10 ** (min(a, b) - max(a, b)))

    want, mixed = [], []
    for i, t in DOCS:
        w = brute.words(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        first = (i, len(w) + 1, sum(x in counts for x in w) + 1, n, base)
        want.append((*first, sum(map(word, w)) + own_end))
        mixed.append((*first, sum(token(counts[x], word(x)) for x in w) + token(ends, own_end)))
    for rows, right in ((found, want), (lattice.scored(docs, PIECES, training, word_arcs=True).collect(), mixed)):
        for r, w in zip(ordered(rows), ordered(right), strict=True):
            assert r[:4] == w[:4]
            assert r[4:] == pytest.approx(w[4:], rel=1e-9)
    assert lattice.scored(corpus.empty(spark), PIECES, F.lit(True)).count() == 0
    untrained = lattice.scored(docs, PIECES, F.lit(False)).where("doc_id = 113").first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0 and untrained.score < 0


def test_near_dedup(spark, docs):
    for percent, width in ((85, 6), (80, 5)):
        found = near_dedup.near_duplicates(docs, percent=percent, width=width).collect()
        want = brute.components(DOCS, percent)
        assert len(found) == len(DOCS)
        for r in found:
            assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
            assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
        sizes = {(r.doc_id, r.n_shingles) for r in found}
        assert sizes == {(i, len(brute.shingles(t))) for i, t in DOCS}
    assert near_dedup.near_duplicates(corpus.empty(spark)).count() == 0


def test_near_dedup_of_an_id_with_several_texts(spark):
    rng = random.Random(1)
    a, b = (" ".join(f"{c}{rng.randint(0, 99)}" for _ in range(60)) for c in "ab")
    rows = [(5, a, None, None, 0), (5, b, None, None, 0), (8, a + " more", None, None, 0), (9, b + " more", None, None, 0)]
    found = near_dedup.near_duplicates(corpus.frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(5, 5, True), (5, 5, True), (8, 5, False), (9, 5, False)]


def test_near_dedup_of_a_crowd(spark, monkeypatch):
    """A large group of near copies goes through tiles, and the result is the same as by all pairs."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = f"edit{k}x{rng.randint(0, 9)}"
        rows.append((k, " ".join(w), None, None, 0))
    monkeypatch.setattr(near_dedup, "PART", 40)
    monkeypatch.setattr(near_dedup, "POINTS", 16)
    want = brute.components([(r[0], r[1]) for r in rows])
    for tiled in (0, near_dedup.TILED):
        monkeypatch.setattr(near_dedup, "TILED", tiled)
        found = near_dedup.near_duplicates(corpus.frame(spark, rows)).collect()
        assert {r.doc_id: r.component_id for r in found} == want


def test_near_dedup_of_a_crowd_without_a_centre(spark, monkeypatch):
    """Chains of copies of copies in one crowd, and texts that are just too unlike: tiles alone can connect them."""
    rng = random.Random(4)
    base, rows = [f"w{k}" for k in range(200)], []
    for chain in range(4):
        w = list(base)
        for k in range(24):
            for _ in range(2):
                w[rng.randrange(150)] = f"c{chain}e{k}x{rng.randint(0, 99)}"
            rows.append((100 * chain + k, " ".join(w), None, None, 0))
    monkeypatch.setattr(near_dedup, "CROWD", 2)
    monkeypatch.setattr(near_dedup, "PART", 8)
    want = brute.components([(r[0], r[1]) for r in rows])
    found = near_dedup.near_duplicates(corpus.frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == want and len(set(want.values())) > 1


def test_small_sets_meet_in_bands():
    """Pairs at the threshold, of sets of 5 to 40 shingles: none in 3000 misses all bands of both sketches."""
    rng = np.random.default_rng(0)
    for n in (7, 13, 20, 40):
        shared = -(-85 * n // 100)
        sets = rng.integers(0, 2**63, (3000, n + n - shared), dtype=np.uint64)
        one = [np.unique(r[:n]) for r in sets]
        two = [np.unique(r[:shared]) for r in sets]  # likeness shared / n
        met = np.zeros(len(sets), bool)
        for salt in (near_dedup._A, near_dedup._C):
            same = near_dedup.registers(one, salt) == near_dedup.registers(two, salt)
            met |= same[:, : 6 * 26].reshape(len(sets), 26, 6).all(2).any(1)
        assert met.all()


def test_sketches_estimate_likeness():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.85):
        errors = []
        for _ in range(40):
            n = 2000
            same = round(2 * n * share / (1 + share))
            a = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            x, y = near_dedup.registers([np.unique(a[:n]), np.unique(np.concatenate([a[:same], a[n : 2 * n - same]]))])
            errors.append(near_dedup.likeness(x[None], y[None])[0] - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, corpus.ITEM, "x"), (2, "Nothing like this is in any of the documents at all.", "x"), (3, None, "x"), (4, "too short", "x"), (1, corpus.ITEM, "x")], "item_id long, text string, doc_id string")
    found = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_edits) for r in found} == {(109, 1, 0)}
    text = dict(DOCS)[109].encode()
    assert text[found[0].first_byte : found[0].end_byte].decode().startswith("Which planet")
    assert decontaminate.clean(docs, bench).count() == len(DOCS) - 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == len(DOCS)
    assert decontaminate.leaks(corpus.empty(spark), bench).count() == 0


def test_decontamination_by_document(spark):
    """Halves of an item in two texts are no leak, and the rows don't depend on partitions."""
    cut = len(corpus.ITEM) // 2
    rows = [(1, "Some words. " + corpus.ITEM[:cut]), (2, corpus.ITEM[cut:] + " Some words."), (3, corpus.ITEM), (4, corpus.ITEM.replace("planet", "plamet")), (5, None), (6, corpus.ITEM[: cut + 40]), (7, corpus.ITEM[cut + 40 :]), (7, "xx " + corpus.ITEM[4:])]
    bench = spark.createDataFrame([(7, corpus.ITEM), (8, corpus.ITEM[20:90])], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").orderBy("doc_id")
    found = [ordered(decontaminate.leaks(docs.repartitionByRange(n, "doc_id"), bench).collect()) for n in (1, 2, 7)]
    assert found[0] == found[1] == found[2]
    assert {r[:3] for r in found[0]} == {(3, 7, 0), (3, 8, 0), (4, 7, 1), (4, 8, 0), (6, 8, 0), (7, 7, 4), (7, 8, 0)}
    for n in (1, 2, 7):
        assert sorted(r.doc_id for r in decontaminate.clean(docs.repartitionByRange(n, "doc_id"), bench).collect()) == [1, 2, 5, 7]


def test_decontamination_finds_edits_within_the_budget(monkeypatch):
    rng = random.Random(7)

    def distance(item, text):
        """The fewest edits of the item against any part of the text."""
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    items = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(60, 160))).strip() for _ in range(4)]
    index = decontaminate.Index(list(range(4)), items, 0.1)
    for _ in range(25):
        k = rng.randrange(4)
        item = list(items[k])
        for _ in range(rng.randint(0, int(0.16 * len(item)))):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [item[at], "q"]])
        text = "some words before " + "".join(item) + " and some after"
        norm = lambda t: decontaminate.normalised(pa.array([t]))[0][:-1].tobytes().decode()
        want = distance(norm(items[k]), norm(text))
        got = {i: e for _, i, e, _, _ in index.leaks(pa.array(["nothing", text]))}
        if want <= index.k[k]:
            assert got[k] == want
        else:
            assert k not in got


def test_benchmark_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    bench = spark.createDataFrame([(1, corpus.ITEM), (2, corpus.PASSAGE), (3, "x" * 90)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(109, 1), (107, 2), (108, 2)}


def test_lattice_scores_by_learnt_weights_reach_the_base(spark, monkeypatch):
    """Texts of phrases, some of whose words training lacks: scores by the file's order of pieces were far below the base."""
    rng = random.Random(8)
    seen = ["".join(rng.choice(("th", "er", "on", "ble", "ing", "re")) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    phrases = [rng.choices(seen, k=8) for _ in range(40)]
    texts = [(i, " ".join(w if rng.random() < 0.97 else "".join(rng.choices(("th", "er", "on", "ble"), k=6)) for _ in range(10) for w in rng.choice(phrases))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "é漢🙂 the The THE"), (63, "ab" * 400), (None, "ble on")]
    docs, training = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), F.col("doc_id") % 5 != 2
    found = {r.doc_id: r for r in lattice.scored(docs, PIECES, training, learn=True).collect()}
    assert len(found) == len(texts) and all(math.isfinite(r.score) and r.score < 0 for r in found.values())
    held = [r for i, r in found.items() if i is not None and i < 60 and i % 5 == 2]
    assert sum(r.score for r in held) >= sum(r.base_score for r in held)
    plain = {r.doc_id: r for r in lattice.scored(docs, PIECES, training).collect()}
    assert all(found[i][:5] == pytest.approx(plain[i][:5]) for i in found if i is not None)
    # the same whatever the ranges, blocks and flushes are
    monkeypatch.setattr(lattice, "RANGE_BYTES", 500)
    other = {r.doc_id: r for r in lattice.scored(docs.repartition(7), PIECES, training, learn=True).collect()}
    assert all(other[i].score == pytest.approx(r.score, rel=1e-7) for i, r in found.items())


def test_lattice_tokens_are_a_distribution():
    """Over all tokens that may come next the learnt model's probabilities sum to one; counts are those of training."""
    counts, behind, text = {"a": 6, "b": 2, "c": 1, None: 3}, {"a": {"b": 2, "a": 3, None: 1}, "d": {}}, ["a", "b", "a"]
    model = lattice.Model(np.zeros(1), 0.0, 12, 4, 3, learnt=True)
    tokens = ["a", "b", "c", "d", None]  # d is new, and spelt as likely as a word is spelt at all
    spelt = np.log10([0.3, 0.2, 0.1, 0.4, 1.0])
    for before in behind:
        for place in (0, 3):
            pair = np.array([behind[before].get(t, 0) for t in tokens], float)
            again = np.array([text[:place].count(t) for t in tokens])
            logs = model.token(spelt, np.array([t is None for t in tokens]), np.array([counts.get(t, 0) for t in tokens]), pair, np.full(5, counts.get(before, 0)), again, np.full(5, place))
            assert (10.0**logs).sum() == pytest.approx(1)


def test_expected_pieces_are_those_of_all_cuts():
    """By listing every cut of a word; also for a word that goes alone."""
    with open(PIECES, "rb") as f:
        own = pieces.Pieces(f.read())
    v, logs = own.v, np.full(own.v.size, -np.inf)
    live = v.order >= 0
    logs[live] = -np.log10(v.order[live] + 1.0)
    words, want = ["thing", "é漢", "on"], np.zeros(v.size)
    for w in words:
        s, cuts = "▁" + w, []
        for mask in range(1 << (len(s) - 1)):
            at = [0, *(k + 1 for k in range(len(s) - 1) if mask >> k & 1), len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:], strict=False)]
            if all(len(p) == 1 or v.symbols.get(p, v.size) < v.size for p in parts):
                ids = [i for p in parts for i in ([v.symbols[p]] if v.symbols.get(p, v.size) < v.size else [v.bytes[b] for b in p.encode()])]
                cuts.append((ids, 10.0 ** logs[ids].sum()))
        for ids, p in cuts:
            np.add.at(want, ids, p / sum(p for _, p in cuts))
    for most in (lattice.LONG, 1):
        lattice.LONG, before = most, lattice.LONG
        try:
            assert np.allclose(lattice.Lattice(own, lattice.Model(logs, 0.0, 0, 0, 0)).expected(words), want, atol=1e-12)
        finally:
            lattice.LONG = before


def by_order():
    """The vocabulary, and a model by the order of its pieces."""
    with open(PIECES, "rb") as f:
        own = pieces.Pieces(f.read())
    live = own.v.order >= 0
    logs = np.full(own.v.size, -np.inf)
    logs[live] = -np.log10((own.v.order[live] + 1.0) * (1 / (own.v.order[live] + 1.0)).sum())
    return own, lattice.Model(logs, 0.0, 0, 0, 0)


def test_lattices_of_a_vocabulary_share_their_tables():
    """Each task and round of learning made them anew, a third of a second each."""
    own, model = by_order()
    first, second = lattice.Lattice(own, model), lattice.Lattice(own, lattice.Model(model.pieces - 1, 0.0, 0, 0, 0))
    assert first.begun is second.begun
    assert second.scores(["a"])[0] < first.scores(["a"])[0]


def test_plain_recursions_go_over_to_logs_where_numbers_are_too_small(monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("thequickbrownfoxé漢🙂0") for _ in range(rng.randint(1, 200))) for _ in range(300)] + ["", "漢" * 250, "a" * 255]
    found = lattice.Lattice(*by_order())
    plain, shares = found.scores(words), found.expected(words)
    assert (plain < np.log10(lattice.SMALL)).any() and (plain > np.log10(lattice.SMALL)).any()
    monkeypatch.setattr(lattice, "SMALL", np.inf)
    assert np.allclose(found.scores(words), plain, rtol=1e-12, atol=0)
    assert np.allclose(found.expected(words), shares, rtol=1e-9, atol=1e-300)


def test_remembered_scores_are_bounded_and_right(monkeypatch):
    monkeypatch.setattr(lattice, "CACHE", 50)
    rng, cache, made = np.random.default_rng(3), lattice.Remembered(), []
    for _ in range(60):
        keys = np.unique(np.append(rng.integers(0, 30, 20), rng.integers(0, 1 << 40, 20))).astype(np.uint64)
        keys[-1] = 2**64 - 1
        got = cache.of(keys, lambda new, keys=keys: made.extend(keys[new].tolist()) or np.sqrt(keys[new]))
        assert (got == np.sqrt(keys)).all() and len(cache.keys) <= 2 * 50 + len(keys)
    assert made.count(2**64 - 1) == 1 and len(made) < 60 * 25


def test_spelt_words_travel_once_without_their_hashes(spark, docs):
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("training"))
    found = lattice.counted(rows, PIECES, 3, F.lit(0), learn=True).where(F.col("kind") == lattice.SPELT).collect()
    assert all(r["keys"] is None for r in found)
    words = [w for r in found for w in r.words]
    assert sorted(words) == sorted({w for _, t in DOCS for w in brute.words(t)})
